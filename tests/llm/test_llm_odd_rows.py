"""Every operator over odd rows, over an empty table, and over columns whose names clash."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from cohortspark.llm import bpe, bwt_dedup, html_extract, iblt, langid, packing, pii, quality_rules, simhash, url_rules

MULTI, BPE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ROWWISE = {
    "rules": quality_rules.judge,
    "encode": lambda d: bpe.encode_texts(d, MULTI, P.PATTERN),
    "decode": lambda d: bpe.decode_ids(bpe.encode_texts(d, MULTI, P.PATTERN), MULTI, P.PATTERN),
    "simhash": simhash.groups,
    "sketch": iblt.fingerprints,
    "versions": iblt.versions,
    "pii": lambda d: pii.find(d, pii.fit(d)),
    "masked": lambda d: pii.masked(d, pii.fit(d)),
    "language": lambda d: langid.predict(d, langid.fit(d)),
    "repeats": bwt_dedup.remove_repeats,
    "stripped": bwt_dedup.stripped,
}


@pytest.mark.parametrize("name", ROWWISE)
def test_one_row_for_each_document(name, docs, odd_texts):
    odd = docs(*odd_texts, (None, "an id is missing"), extra=True)
    assert ROWWISE[name](odd).count() == len(odd_texts) + 1


@pytest.mark.parametrize("name", [*ROWWISE, "packing", "keep_one"])
def test_empty_table(name, docs):
    others = {"packing": lambda d: packing.pack(d, BPE, P.PATTERN), "keep_one": simhash.keep_one}
    empty = docs("x").where("false")
    assert (ROWWISE | others)[name](empty).count() == 0


def test_packing_takes_odd_rows(docs, odd_texts):
    pieces = packing.pack(docs(*odd_texts, (None, "an id is missing"), extra=True), BPE, P.PATTERN)
    assert pieces.groupBy("doc_id").count().count() == len(odd_texts) + 1


def test_pages(spark):
    schema = "page_id bigint, url string, html string, path string, score double"
    rows = [(1, None, None, "x", 1.0), (2, "", "", "x", 1.0), (2, "", "", "x", 1.0), (3, "http://a.net/x", "<p>one", "x", 1.0)]
    pages = spark.createDataFrame(rows, schema)
    assert sorted(r.text for r in html_extract.extract(pages).collect()) == ["", "", "", "one"]
    assert html_extract.extract(pages.where("false")).count() == 0
    labelled = spark.createDataFrame([("http://a.net/x", None), (None, True)], "url string, bad boolean")
    judged = url_rules.judge(pages, labelled, [("net", "/", "block")]).collect()
    assert sorted((r.page_id, r.verdict) for r in judged) == [(1, "allow"), (2, "allow"), (2, "allow"), (3, "block")]
    assert url_rules.judge(pages.where("false"), labelled, []).count() == 0


def test_pipeline_stages_take_odd_rows(spark, docs, odd_texts, tmp_path):
    odd = docs(*odd_texts, (None, "an id is missing here in the text"), extra=True)
    columns = odd.columns
    for name, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, str(tmp_path))
        if name != "packing":
            assert odd.columns == columns
    assert odd.count() > 0
