"""Quality rules per document, and per host with shrunken failure rates. DataFrame functions only.

A document fails a rule by itself (too short, too repetitive). Hosts are judged on the share of their documents
that fail: a host with few documents says little, so its rate is drawn towards that of all hosts by a beta prior
whose two parameters are fitted to the hosts' own rates (by their mean and variance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import store

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>")
    )


def _paired(column: str, step: int) -> Column:
    """Hashes of each element with the one that many places on."""
    return F.transform(column, lambda x, i: F.xxhash64(x, F.get(column, i + step)))


def measures(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text.

    A null text has no word and no line. n_repeat_words: words covered by a window of eight words that occurs at
    least twice in the text. Windows are compared by their 64-bit hash; of each text's windows, those with a hash
    that a sort brings together with an equal one are the repeated ones, so the cost is n log n for any text.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.withColumn("w", _words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)
    rows = rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
    )
    for step in (1, 2, 4):  # hashes of one word, then of two, four and eight
        rows = rows.withColumn(f"h{2 * step}", _paired(f"h{step}", step)).drop(f"h{step}")
    windows = F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")
    rows = rows.withColumn("hashes", F.slice("h8", F.lit(1), windows))
    rows = rows.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("hashes") > F.size(F.array_distinct("hashes")),
            F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    near = lambda k, step: F.get("sorted", k + step)["h"]  # noqa: E731  null beyond either end
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    repeated = F.filter("sorted", lambda x, k: same(x["h"], near(k, -1)) | same(x["h"], near(k, 1)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    reach = lambda start, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - start, F.lit(WINDOW)))
    covered = F.aggregate(F.transform("starts", reach), F.lit(0), lambda total, x: total + x)
    return rows.select(
        "doc_id", "host", *MEASURES[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def fails(measured: DataFrame) -> dict[str, Column]:
    """The rules by name; each is true where the document fails it."""
    return {
        "short": F.col("n_words") < 20,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "symbols": F.col("n_symbols") * 10 > F.col("word_chars") * 3,
        "lines": F.col("n_dup_lines") * 10 > F.col("n_words"),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, docs, then for each rule its failures fail_x and its shrunken rate rate_x); a null host is a host.

    The beta prior of a rule: with m the mean and v the variance of the hosts' rates, weighted by documents, and
    s = m (1 - m) / v - 1 bounded to [1, 1000], the rate is (failures + s m) / (docs + s). Hosts that all agree
    (v = 0) get the strongest prior. The hosts' totals are summed within each input task first, so a host with a
    third of all rows costs one row a task; the prior needs one row of totals, which is a scalar.
    """
    rules = fails(measured)
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(rule.cast("long")).alias(f"fail_{name}") for name, rule in rules.items()]
    )
    rate = lambda name: F.col(f"fail_{name}") / F.col("docs")
    total = hosts.agg(
        F.sum("docs").alias("all_docs"),
        *[F.sum(f"fail_{name}").alias(f"all_{name}") for name in rules],
        *[F.sum(rate(name) * rate(name) * F.col("docs")).alias(f"square_{name}") for name in rules],
    )
    both = hosts.withColumn("of", total.select(F.struct("*")).scalar())
    out = ["host", "docs"]
    for name in rules:
        mean = F.col(f"of.all_{name}") / F.col("of.all_docs")
        variance = F.greatest(F.col(f"of.square_{name}") / F.col("of.all_docs") - mean * mean, F.lit(0.0))
        strength = F.when(variance > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), mean * (1 - mean) / variance - 1)))
        strength = F.coalesce(strength, F.lit(1000.0))
        rate_of = (F.col(f"fail_{name}") + strength * mean) / (F.col("docs") + strength)
        out += [f"fail_{name}", rate_of.alias(f"rate_{name}")]
    return both.select(*out)


def judge(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", worst: float = 0.5
) -> DataFrame:
    """(doc_id, host, the measures, base_failed, host_rate, host_failed, kept) for every document.

    A host fails if its shrunken rate of any rule is above `worst`; a document is kept if neither itself nor its
    host fails. Measures are computed once and stored; verdicts join back by host, and adaptive execution splits
    a host with very many documents. Null texts count as empty and fail; repeated rows stay; an empty table gives
    no row. Columns other than the three named are not read.
    """
    measured = store(measures(docs, id_column, text, host), "quality")
    rates = host_rates(measured)
    rates = rates.select(
        F.col("host").alias("judged"), F.greatest(*[F.col(f"rate_{name}") for name in fails(measured)]).alias("host_rate")
    )
    joined = measured.join(rates, measured.host.eqNullSafe(rates.judged), "left")
    rules = fails(measured)
    base = rules["short"] | rules["repeats"]
    host_failed = F.coalesce(F.col("host_rate") > worst, F.lit(False))
    return joined.select(
        "doc_id", "host", *MEASURES, base.alias("base_failed"), "host_rate", host_failed.alias("host_failed"),
        (~base & ~host_failed).alias("kept"),
    )
