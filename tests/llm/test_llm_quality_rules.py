import re
from collections import Counter

import pytest

from cohortspark.llm import quality_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_measures_equal_a_plain_count(documents, docs, odd_texts):
    repeats = "a b c d e f g h i j " * 5 + "x y " + "a b c d e f g h"
    for frame in (documents, docs(*odd_texts, repeats, "same line\nsame line\n same line\n\n\n")):
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in quality_rules.judge(frame).collect():
            found = tuple(r[c] for c in quality_rules.MEASURES)
            assert found == plain(texts[r.doc_id]), r.doc_id
            n = plain(texts[r.doc_id])
            assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_host_rates_are_drawn_to_the_mean_and_join_back(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, good if i % 10 else bad, "large") for i in range(100)]
    rows += [(100 + i, good if i > 17 else bad, "awful") for i in range(20)] + [(200, bad, "tiny"), (201, good, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    judged = {r.doc_id: r for r in quality_rules.judge(frame).collect()}
    measured = quality_rules.measures(frame)
    rates = {r.host: r for r in quality_rules.host_rates(measured).collect()}
    hosts = {"large": (10, 100), "awful": (18, 20), "tiny": (1, 1), None: (0, 1)}
    mean = 29 / 122
    variance = sum(k * k / n for k, n in hosts.values()) / 122 - mean * mean
    strength = min(1000, max(1, mean * (1 - mean) / variance - 1))
    for host, (k, n) in hosts.items():
        assert rates[host].rate_short == pytest.approx((k + strength * mean) / (n + strength))
    assert rates["tiny"].rate_short < 1
    assert not judged[118].base_failed and judged[118].host_failed and not judged[118].kept
    assert judged[1].kept and judged[201].kept and not judged[0].kept


def test_main_path_has_no_python(documents):
    plan = quality_rules.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
