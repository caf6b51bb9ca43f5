import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortspark.llm import bwt_dedup, queries


def plain(texts, span):
    """Bytes covered by strings that start more than once, as spans of each text."""
    counts = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - span + 1):
            if counts[t[i : i + span]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + span
                else:
                    spans.append([i, i + span])
        out.append([tuple(s) for s in spans])
    return out


def mixture(rng, span):
    alphabet = rng.choice(["ab", "abcdefgh \u00e9\u4f60"])
    parts = ["".join(rng.choices(alphabet, k=rng.randint(0, 4 * span))) for _ in range(3)]
    texts = []
    for _ in range(rng.randint(1, 8)):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(parts)
            a, b = sorted((rng.randint(0, len(part)), rng.randint(0, len(part))))
            text += part[a:b] + "".join(rng.choices(alphabet, k=rng.randint(0, 4)))
        texts.append(text)
    return texts + rng.choice([[], ["a" * 3 * span], ["abc" * span], [texts[0], texts[0]], [None, ""]])


def check(docs, texts, span, crowd=bwt_dedup.CROWD):
    data = [(t or "").encode() for t in texts]
    found = {r.doc_id: r for r in bwt_dedup.remove_repeats(docs(*texts), span=span, crowd=crowd).collect()}
    for i, (t, spans) in enumerate(zip(data, plain(data, span))):
        kept = b"".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(t), len(t) - len(kept), len(spans), kept)


def test_merged_orders_equal_a_plain_count(docs):
    rng = random.Random(7)
    for case in range(4):
        span = (60, 100)[case % 2]
        texts = [t for _ in range(6) for t in mixture(rng, span)]
        check(docs, texts, span)
        check(docs, texts, span, crowd=1)


def test_many_mixtures_of_anchors():
    rng = random.Random(2)
    for _ in range(150):
        span = rng.choice([50, 60, 120])
        texts = [(t or "").encode() for t in mixture(rng, span)]
        rows = []
        for n, t in enumerate(texts):
            with np.errstate(over="ignore"):
                a, lo, hi, h = bwt_dedup.anchors(np.frombuffer(t, np.uint8), span)
            rows += [(h, n, a, lo, t[lo : hi + span]) for h, a, lo, hi in zip(h.tolist(), a.tolist(), lo.tolist(), hi.tolist())]
        rows.sort()
        found = [[] for _ in texts]
        if rows:
            group = np.cumsum(np.append(0, np.diff(np.array([r[0] for r in rows])) != 0))
            shift = np.array([r[2] - r[3] for r in rows])
            for r, runs in zip(rows, bwt_dedup.merge_orders(group, [r[4] for r in rows], shift, span)):
                found[r[1]] += [(r[2] - far, r[2] - near + span) for near, far in runs]
        assert [bwt_dedup.cut_out(t, f)[1] for t, f in zip(texts, found)] == plain(texts, span)


def test_hot_passage_and_copies(docs):
    rng = random.Random(3)
    passage = "".join(rng.choices("abcdefgh ", k=500))
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + passage + "".join(rng.choices("xyz", k=200)) for _ in range(40)]
    texts += [texts[0]] * 5 + [passage[:399], passage[:400]]
    check(docs, texts, 400)
    check(docs, texts, 400, crowd=3)


def test_the_table_as_sql_would(documents):
    rows = sorted(documents.select("doc_id", "text").collect())
    data = [(r.text or "").encode() for r in rows]
    found = {r.doc_id: r for r in bwt_dedup.remove_repeats(documents).collect()}
    for r, t, spans in zip(rows, data, plain(data, 400)):
        kept, _ = bwt_dedup.cut_out(t, spans)
        assert hashlib.sha256(kept).digest() == hashlib.sha256(found[r.doc_id].kept).digest()
    assert sum(x.n_removed for x in found.values()) > 0


def test_texts_longer_than_a_step(docs, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "STEP", 100)
    rng = random.Random(5)
    part = "".join(rng.choices("abc", k=700))
    data = [(part + "x" * i + part[50:600]).encode() for i in range(3)]
    for t in data:
        with np.errstate(over="ignore"):
            a, lo, hi, _ = bwt_dedup.anchors(np.frombuffer(t, np.uint8), 80)
        assert lo[0] == 0 and hi[-1] == len(t) - 80 and (lo[1:] == hi[:-1] + 1).all() and (a >= hi).all() and (a - lo <= 32).all()


def test_stripped_texts_stay_text(docs):
    text = "\u4f60\u597d" * 200
    rows = {r.doc_id: r.text for r in bwt_dedup.stripped(docs(text + "end", "x" + text, None, "short")).collect()}
    assert rows[3] == "short" and rows[2] is None and rows[0].endswith("end") and len(rows[0]) < 10


def test_what_is_shuffled_is_small(docs):
    """Three longs for each anchor, and texts that are compressed, whatever characters they have."""
    rows = bwt_dedup.keyed(docs("a plain text " * 60, "\u00e9\u4f60" * 300), "doc_id", "text").select("k", "d", "t")
    shards = bwt_dedup._shards(rows, 400)
    lists = {f.name: f.dataType.simpleString() for f in shards.schema if f.dataType.typeName() == "array"}
    assert lists == dict.fromkeys(("place", "anchor", "ctx"), "array<bigint>")
    for r in shards.select("size", F.explode("place").alias("place")).select("size", *bwt_dedup._ends()).collect():
        assert 0 <= r.lo <= r.hi <= r.size - 400 and r.hi <= r.a <= r.lo + 352
    for text in ("", "x", "\u00e9\u4f60\U0001f600" * 500, "words that come again " * 900):
        packed = bwt_dedup.squeezed(text)
        assert bwt_dedup.unsqueezed(packed) == text.encode()
    assert len(packed) < 200


def test_finer_anchors_cover_the_same_strings():
    """Each string of a crowded anchor has one finer anchor, equal strings have equal ones; other anchors are left out."""
    rng = random.Random(4)
    part = "".join(rng.choices("abcdefgh ", k=150))
    for width in (1, 7, 32, 60):
        anchor_of = {}
        for _ in range(6):
            noise = ["".join(rng.choices("abcdefgh ", k=rng.randint(0, 90))) for _ in range(2)]
            text = (noise[0] + part + noise[1]).encode()
            with np.errstate(over="ignore"):
                found = bwt_dedup.anchors(np.frombuffer(text, np.uint8), 60)
            crowded = found[3][::2]
            covered = []
            for a, lo, hi, h in zip(*(x.tolist() for x in bwt_dedup.finer(text, found, [(crowded, width)], 60))):
                assert a in found[0][::2] and 0 <= a - hi and a - lo <= 12 and hi - lo < width
                covered += range(lo, hi + 1)
                for s in range(lo, hi + 1):
                    assert anchor_of.setdefault(text[s : s + 60], h) == h
            assert sorted(covered) == [s for lo, hi in zip(found[1][::2], found[2][::2]) for s in range(lo, hi + 1)]


def test_crowded_anchors_shuffle_no_text_again(docs, monkeypatch):
    """Nor are their strings written one by one, though the passage has far more contexts than one task merges."""
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=420))
    texts = ["".join(rng.choices("abcdefgh ", k=300)) + passage + "".join(rng.choices("abcdefgh ", k=300)) for _ in range(40)]
    shuffled, stored = [], []
    contexts, store = bwt_dedup._contexts, bwt_dedup.store

    def counted(frame, label, *codec):
        out = store(frame, label, *codec)
        each = F.size("place") if dict(out.dtypes).get("place", "").startswith("array") else F.lit(1)
        stored.append(out.agg(F.sum(each)).first()[0] or 0)
        return out

    monkeypatch.setattr(bwt_dedup, "_contexts", lambda *given: shuffled.append(1) or contexts(*given))
    monkeypatch.setattr(bwt_dedup, "store", counted)
    check(docs, texts, 400, crowd=3)
    assert len(shuffled) == 1
    assert max(stored) < 40 * 150  # strings of an anchor in the passage: over 300 a text


def test_two_lengths_at_once_equal_plain_counts(docs, monkeypatch):
    """The removed bytes are those of the longer strings alone; the shorter ones are counted beside them, in the same passes."""
    rng = random.Random(8)
    passes, shards = [], bwt_dedup._shards
    monkeypatch.setattr(bwt_dedup, "_shards", lambda *given: passes.append(1) or shards(*given))
    for span in (100, 140):
        texts = [t for _ in range(6) for t in mixture(rng, span)]
        data = [(t or "").encode() for t in texts]
        for crowd in (bwt_dedup.CROWD, 2, 1):
            rows = bwt_dedup.remove_repeats(docs(*texts), span=span, crowd=crowd, passage=60).collect()
            found = {r.doc_id: r for r in rows}
            for i, (t, spans, runs) in enumerate(zip(data, plain(data, span), plain(data, 60))):
                kept, _ = bwt_dedup.cut_out(t, spans)
                r = found[i]
                assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(t), len(t) - len(kept), len(spans), kept)
                words = [len([w for w in t[a:b].replace(b"\n", b" ").split(b" ") if w]) for a, b in runs]
                assert (r.n_repeated, r.n_passages) == (sum(b - a for a, b in runs), sum(n > 50 for n in words))
            assert sum(r.n_removed for r in rows) < sum(r.n_repeated for r in rows)
            assert len(passes) <= 3
            passes.clear()


def test_passages_of_51_words_are_found(spark, tmp_path):
    """They have fewer than 400 bytes, so no byte of them is removed."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(51)
    texts = [f"{words(70)} {passage} {words(30)}", f"{words(20)} {passage}", words(150), None, f"{words(90)} {passage[:240]} {words(9)}"]
    folder = f"{tmp_path}/tables"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: r for r in queries.op10_suffix_dedup(spark, folder).collect()}
    assert [found[i].n_passages for i in range(5)] == [1, 1, 0, 0, 0]
    assert found[0].n_repeated >= len(passage) and found[2].n_repeated == 0 and found[4].n_repeated >= 240
    assert all(r.n_removed == 0 and r.n_spans == 0 for r in found.values())
