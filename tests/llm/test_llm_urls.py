import random

from pyspark.sql import functions as F

from cohortspark.llm import url_rules
from cohortspark.llm.html_extract import url_host
from cohortspark.llm.queries import URL_RULES


def test_hosts_and_paths(spark):
    cases = {
        "HTTP://Ex.NET/a/B?q#f": ("ex.net", "/a/B"), "x://a?b/c": ("a", ""), "x://a#b": ("a", ""), "nothing": ("", ""),
        None: ("", ""), "a://b://c/d": ("b:", "//c/d"), "http://u@h:80/": ("u@h:80", "/"), "://h": ("h", ""), "": ("", ""),
        "x\n://\u00c9.De/\np": ("\u00c9.de", "/\np"),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    for r in frame.select("url", url_host(F.col("url")).alias("h"), url_rules.url_path(F.col("url")).alias("p")).collect():
        assert (r.h, r.p) == cases[r.url]


def test_longest_fixed_rule_wins(spark):
    cases = {
        "a.net/": ("net/", "block"), "example.net/en/1": ("example.net/en/", "allow"), "x.example.net/en/": ("example.net/en/", "allow"),
        "example.net/de/": ("net/", "block"), "example.com/de/1": ("example.com/de/", "block"), "badexample.com/de/": (None, "allow"),
        "q.org/fr/": ("org/fr/", "allow"), "q.org/": (None, "allow"), "a.net": (None, "allow"), "internet/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(cases)], "page_id bigint, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    found = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, none, URL_RULES).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())


def test_mined_rules_equal_a_count_of_all_combinations(spark):
    from itertools import combinations

    rng = random.Random(2)
    urls = [f"http://{rng.choice(['spam', 'good', 'news'])}.{rng.choice(['x', 'y'])}.com/{rng.choice(['buy', 'read'])}/{i}" for i in range(400)]
    bad = [("spam" in u and "buy" in u) or rng.random() < 0.02 for u in urls]
    labelled = spark.createDataFrame(list(zip(urls, bad)), "url string, bad boolean")
    rows = labelled.select(url_rules.tokens(url_host(F.col("url")), url_rules.url_path(F.col("url"))).alias("t"), "bad").collect()
    plain = set()
    for size in (1, 2, 3):
        for some in combinations(sorted({x for r in rows for x in r.t}), size):
            fits = [r.bad for r in rows if set(some) <= set(r.t)]
            if sum(fits) >= 0.01 * len(rows) and sum(fits) >= 0.8 * len(fits):
                if not any(set(p) < set(some) for p in plain):
                    plain.add(some)
    mined = url_rules.mine(labelled, support=0.01)
    assert {tuple(r.antecedent) for r in mined.collect()} == plain and plain
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    judged = url_rules.judge(pages, labelled, [], support=0.01).collect()
    fits = {i: any(set(p) <= set(r.t) for p in plain) for i, r in enumerate(rows)}
    assert {r.page_id: r.verdict == "block" for r in judged} == fits


def test_words_deep_in_a_path_and_rules_of_four_tokens(spark):
    deep = "http://www.news.example.co.uk/a/b/c/d/e/f/g/{}/x"
    four = lambda n: "http://h.com/" + "/".join(w for i, w in enumerate(("one", "two", "six", "ten")) if n >> i & 1)
    rows = [(deep.format("casino"), True)] * 20 + [(deep.format("reading"), False)] * 20
    rows += [(four(15), True)] * 20 + [(four(15 - (1 << i)), False) for i in range(4)] * 20
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), support=0.05).collect()
    assert {tuple(r.antecedent): r.confidence for r in mined} == {("p:casino",): 1.0, ("p:one", "p:six", "p:ten", "p:two"): 1.0}


def test_few_urls_make_no_rule_and_common_tokens_do_not_multiply(spark):
    rows = [(f"http://rare.com/{i}", True) for i in range(4)] + [(f"http://other.com/{i}", False) for i in range(40)]
    assert url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0
    long = "/".join(f"step{chr(97 + i)}" for i in range(26))
    rows = [(f"http://spam.com/{long}/{i}", True) for i in range(30)] + [(f"http://other.com/{i}", False) for i in range(40)]
    mined = {tuple(r.antecedent) for r in url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert mined == {(f"p:step{chr(97 + i)}",) for i in range(26)} | {("h:spam",), ("w:spam",)}


def test_held_out_urls_are_judged_by_the_other_ones(spark):
    rows = [(f"http://{'spam' if i % 2 else 'good'}.com/{i}", bool(i % 2)) for i in range(400)] + [(None, True), ("x://y", None)]
    found = url_rules.held_out(spark.createDataFrame(rows, "url string, bad boolean")).first()
    assert 40 < found.n_judged < 120 and found.n_blocked == found.n_right > 0


def test_lower_bound(spark):
    row = spark.range(1).select(url_rules.lower_bound(F.lit(5), F.lit(5)).alias("a"), url_rules.lower_bound(F.lit(1), F.lit(1)).alias("b")).first()
    assert abs(row.a - 5 / (5 + 1.645**2)) < 1e-12 and row.b < 0.5
