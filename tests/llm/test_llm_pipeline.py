import random

import public_tokenizers as P

import corpus_pipeline
from cohortspark.llm import langid, pii, simhash


def test_each_stage_does_its_work_on_what_the_last_one_kept(spark, small, documents):
    docs = documents
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_copies", "repeated_passages", "personal_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["language"](spark, docs, small)
    net = langid.fit(docs)
    plain = {r.doc_id for r in docs.collect() for lang, score in [[x[0] for x in langid.predictions(net, [r.text])]] if lang != "und" and score >= 0.3}
    assert {r.doc_id for r in kept.collect()} == plain and len(plain) > 0.95 * docs.count()

    single = stages["near_copies"](spark, kept, small)
    texts = [r.text for r in single.collect()]
    assert len(set(texts)) == len(texts) < kept.count()
    narrow = {simhash.fingerprint(t) for t in texts}
    assert len(narrow) == len(texts)

    cut = stages["repeated_passages"](spark, single, small)
    rows = cut.collect()
    assert len(rows) == len(texts) and all(r.n_chars == len(r.text) for r in rows)
    seen = set()
    for r in rows:
        data = r.text.encode()
        for i in range(0, len(data) - 399):
            assert data[i : i + 400] not in seen
        seen |= {data[i : i + 400] for i in range(0, len(data) - 399)}

    masked = stages["personal_data"](spark, cut, small)
    assert masked.columns == docs.columns and masked.count() == cut.count()
    assert all(not pii.base_spans(r.text) for r in masked.collect())

    pieces = stages["packing"](spark, masked, small).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in masked.collect()}
    assert P.path("byte_bpe_50k.json")


def test_run_is_the_stages_in_a_row(spark, small):
    whole = corpus_pipeline.run(spark, small)
    assert whole.count() > 0 and "sequence_id" in whole.columns


def test_near_copies_are_the_groups_of_the_fingerprints(spark, docs, small):
    rows = [(7, "a b c d"), (3, "A B c d"), (None, "a b c d"), (9, "quite another text than that"), (5, None), (4, ""), (11, "x y z"), (11, "x y z")]
    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows += [(100 + i, " ".join(words[:j] + [f"x{i}"] + words[j:])) for i, j in enumerate(range(0, 400, 20))]
    frame = docs(*rows)
    best = {}
    for r in simhash.groups(frame).collect():
        best.setdefault(r.component_id, []).append(r.doc_id)
    wanted = sorted(min(d for d in some if d is not None) for some in best.values())
    kept = corpus_pipeline.near_copies(spark, frame, small)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == wanted
    assert corpus_pipeline.near_copies(spark, frame.limit(0), small).count() == 0
    unknown = corpus_pipeline.near_copies(spark, docs((None, "same text"), (None, "same text")), small).collect()
    assert [(r.doc_id, r.text) for r in unknown] == [(None, "same text")]


def test_passages_of_over_fifty_words_go_from_all_documents(spark, docs, small):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("aeioulmnrst", k=rng.randint(2, 7))) for _ in range(n))
    passage, alone = prose(55), [(prose(120), prose(90)) for _ in range(3)]
    assert 200 < len(passage) < 400
    texts = [f"{a} {passage} {b}" for a, b in alone] + [prose(200), f"{prose(60)} {passage[:150]} {prose(60)}"]
    rows = sorted(corpus_pipeline.repeated_passages(spark, docs(*texts), small).collect())
    for (a, b), r in zip(alone, rows):
        assert passage not in r.text and r.text.startswith(a) and r.text.endswith(b) and r.n_chars == len(r.text) < len(a + b) + 3
    assert [r.text for r in rows[3:]] == texts[3:]
