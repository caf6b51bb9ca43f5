"""Named queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (
    bpe, bwt_dedup, feistel, html_extract, iblt, langid, orchard, packing, pii, quality_rules, simhash, spelling, url_rules,
)
from cohortspark.llm.common import table


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules by document and by host; here the host of a document is its source."""
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encodes and decodes every text."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode_texts(table(spark, folder, "documents"), path, pattern)
    decoded = bpe.decode_ids(encoded, path, pattern, keep_ids=True)
    return decoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text_bytes", 256).alias("decoded_sha256"),
    )


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html_extract.extract(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


# The rules of the URL filter (host, path, verdict).
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose path names a labelled document; bad if its quality is 0 or it is toxic."""
    named = F.try_element_at(F.regexp_extract_all(html_path(), F.lit(r"/(\d{1,18})(?=[./]|$)"), 1), F.lit(-1))
    urls = pages.select("url", named.cast("bigint").alias("doc_id"))
    judged = labels.select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urls.join(judged, "doc_id").select("url", "bad")


def html_path():
    return url_rules.url_path(F.col("url"))


def op4_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Judges every page's URL."""
    pages = table(spark, folder, "pages")
    labelled = labelled_urls(pages, table(spark, folder, "labels"))
    judged = url_rules.judge(pages, labelled, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Packs every document along the curve."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pieces = packing.pack(table(spark, folder, "documents"), path, pattern)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every document and of its edited version."""
    return iblt.versions(table(spark, folder, "documents"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.fit(docs))
    spans = F.arrays_zip("kinds", "starts", "ends", "by_pattern")
    written = lambda some: F.array_join(
        F.transform(some, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ","
    )
    base = F.filter(spans, lambda x: x["by_pattern"])
    of_kind = lambda kind: F.size(F.filter(base, lambda x: x["kinds"] == kind)).cast("long")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents")
    held = langid.held_out(F.col("doc_id"))
    net = langid.fit(docs.where(~held))
    return langid.predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Removes every 400-byte string that is not unique; counts repeated passages of over 50 words, most of them shorter."""
    found = bwt_dedup.remove_repeats(table(spark, folder, "documents"), passage=bwt_dedup.PASSAGE)
    sha = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", sha, "n_repeated", "n_passages")


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    """Eight clusters of all vectors."""
    return orchard.cluster(table(spark, folder, "embeddings"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The more frequent form of every word of all documents."""
    return spelling.variants(table(spark, folder, "documents"))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 40 shards."""
    return feistel.shard(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_byte_bpe, op3_html_extraction, op4_url_rules, op5_packing, op6_simhash, op7_fingerprints,
        op8_pii, op9_language_id, op10_suffix_dedup, op11_centroid_clustering, op12_spelling_variants, op13_sharding,
    )
}
