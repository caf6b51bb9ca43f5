"""URL filter: fixed rules by host and path, and association rules mined from labelled URLs.

A labelled URL is a transaction of its tokens. Spark's FP-growth finds frequent combinations; those that imply a bad
label with enough confidence and support become block rules. Rules are
matched through an inverted index: each stands under its rarest token only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import parts, store
from cohortspark.llm.html_extract import url_host


def url_path(url: Column) -> Column:
    """What follows the host, up to ? or #; empty for a URL without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: the host's labels and their words, and the words of the path; numbers say nothing."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(host, r"[^a-z0-9]+"), lambda x: F.concat(F.lit("w:"), x))
    steps = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.filter(F.array_distinct(F.concat(labels, words, steps)), lambda x: x.rlike(r"^\w:.*\p{L}"))


BAD = "bad"  # the item of a bad label; no token looks like it


def lower_bound(bad: Column, n: Column, z: float = 1.645) -> Column:
    """The lower end of Wilson's interval for bad / n."""
    share = bad / n
    middle = share + z * z / (2 * n)
    return (middle - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _classes(rows: DataFrame, least: int, total: int) -> DataFrame:
    """(item, token): tokens in `least` bad URLs or more but not in all URLs; item is the first of the tokens that stand
    in the same URLs.

    Every part of a frequent set with the bad label is frequent with it, so no other token can be in a rule. Tokens of
    the same URLs are told by the number of URLs and two sums of hashes of them.
    """
    spread = rows.select(F.explode("items").alias("token"), "b", F.xxhash64("url").alias("x"), F.xxhash64("url", F.lit(1)).alias("y"))
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("x", "y")]
    found = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), *sums)
    found = store(found.where((F.col("b") >= least) & (F.col("n") < total)), "tokens")
    firsts = found.groupBy("n", "b", "x", "y").agg(F.min("token").alias("item"))
    return store(found.join(firsts, ["n", "b", "x", "y"]).select("item", "token"), "token-classes")


def mine(
    labelled: DataFrame,
    url: str = "url",
    bad: str = "bad",
    support: float = 0.002,
    confidence: float = 0.8,
    floor: int = 5,
    sure: float = 0.5,
) -> DataFrame:
    """(antecedent array, confidence, support): rules that imply the bad label, but those that hold a shorter one.

    Spark's FP-growth mines sets of tokens, all of a URL's, with the bad label as one more item. Rules need `support` of
    all labelled URLs and `floor` bad URLs at least, `confidence`, and a lower bound of it (Wilson) above `sure`.
    Tokens that stand in the same URLs are one item while mining, so that they don't multiply; each of them gives a
    rule of its own after it. Rules may have any length. Rows with a null label or URL are left out; without bad rows
    there is no rule.
    """
    spark = labelled.sparkSession
    schema = "antecedent array<string>, confidence double, support double"
    rows = labelled.where(F.col(bad).isNotNull() & F.col(url).isNotNull())
    words = tokens(url_host(F.col(url)), url_path(F.col(url)))
    rows = rows.select(F.monotonically_increasing_id().alias("url"), words.alias("items"), F.col(bad).cast("long").alias("b"))
    rows = store(rows, "transactions")
    total, total_bad = rows.agg(F.count(F.lit(1)), F.sum("b")).first()
    if not total_bad:
        return spark.createDataFrame([], schema)
    least = max(floor, math.ceil(support * total))
    classes = _classes(rows, least, total)
    if classes.isEmpty():
        return spark.createDataFrame([], schema)

    spread = rows.select("url", F.explode("items").alias("token")).join(classes, "token")
    known = spread.groupBy("url").agg(F.collect_set("item").alias("known"))
    marked = F.when(F.col("b") == 1, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = rows.join(known, "url", "left").select(
        F.concat(F.coalesce("known", F.array().cast("array<string>")), marked).alias("items")
    )
    baskets = store(baskets, "baskets")
    growth = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=confidence, numPartitions=parts(spark))
    found = growth.fit(baskets).associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    hits = F.round(F.col("support") * total)
    found = found.where(lower_bound(hits, F.round(hits / F.col("confidence"))) > sure)
    found = found.where(~F.array_contains("antecedent", BAD) & (F.size("antecedent") > 0))
    found = store(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "rules")
    return store(_written_out(_shortest(found), classes), "written-rules")


def _shortest(rules: DataFrame) -> DataFrame:
    """The rules that hold no other whole; a shorter one is looked up through its first item."""
    first = rules.select(F.col("antecedent").alias("shorter"), F.element_at("antecedent", 1).alias("item"))
    held = rules.select("antecedent", F.explode("antecedent").alias("item")).join(first, "item")
    inside = (F.size(F.array_except("shorter", "antecedent")) == 0) & (F.size("shorter") < F.size("antecedent"))
    return rules.join(held.where(inside).select("antecedent").distinct(), "antecedent", "left_anti")


def _written_out(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Each rule once for every choice of one token from the class of each of its items."""
    members = classes.groupBy("item").agg(F.collect_list("token").alias("members"))
    spread = rules.select("antecedent", "confidence", "support", F.explode("antecedent").alias("item")).join(members, "item")
    whole = spread.groupBy("antecedent", "confidence", "support").agg(F.collect_list("members").alias("choices"))
    start = F.array(F.array().cast("array<string>"))
    grow = lambda sets, some: F.flatten(F.transform(sets, lambda x: F.transform(some, lambda y: F.array_append(x, y))))
    every = whole.select(F.explode(F.aggregate("choices", start, grow)).alias("antecedent"), "confidence", "support")
    return every.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")


def held_out(labelled: DataFrame, url: str = "url", bad: str = "bad", **mining) -> DataFrame:
    """One row (n_judged, n_blocked, n_right): rules mined from four fifths of the labelled URLs, applied to the others.

    The fifth is told by crc32 of the URL, so that equal URLs are on one side.
    """
    rows = labelled.where(F.col(bad).isNotNull() & F.col(url).isNotNull())
    rows = rows.select(F.col(url).alias("url"), F.col(bad).cast("boolean").alias("bad"))
    mine_from, judged = (rows.where(x) for x in (F.crc32("url") % 5 != 0, F.crc32("url") % 5 == 0))
    rules = mine(mine_from, **mining)
    urls = judged.select("url", tokens(url_host(F.col("url")), url_path(F.col("url"))).alias("tokens")).distinct()
    blocked = judged.join(matches(urls, rules), "url", "left")
    hit = F.col("confidence").isNotNull()
    return blocked.agg(
        F.count(F.lit(1)).alias("n_judged"), F.count_if(hit).alias("n_blocked"), F.count_if(hit & F.col("bad")).alias("n_right")
    )


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence): the URLs that a rule fits, with the best rule's confidence. urls: (url, tokens).

    A URL's tokens look up rules, and a rule found must be there whole. Spark chooses by the index's size whether it
    is broadcast; only rows that a rule fits are shuffled if it is.
    """
    spread = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    rarity = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = spread.join(rarity, "token", "left").groupBy("antecedent", "confidence")
    index = rare.agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    looked = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    whole = looked.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return whole.groupBy("url").agg(F.max("confidence").alias("confidence"))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule (host, path, verdict) that fits, else nulls. The list is a parameter."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: list[tuple[str, str, str]],
    id_column: str = "page_id",
    url: str = "url",
    **mining,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page; labelled: (url, bad boolean).

    A fixed rule decides where one fits; else a page is blocked if a mined rule fits and allowed if none does.
    A null URL or one without :// has an empty host and path and is allowed. Repeated rows stay; an empty table
    gives none.
    """
    mined = mine(labelled, **mining)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = rows.where("url is not null").select("url", tokens(F.col("host"), F.col("path")).alias("tokens"))
    found = matches(urls, mined).withColumnRenamed("url", "matched")
    joined = rows.join(found, rows.url == found.matched, "left")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "confidence"
    )
