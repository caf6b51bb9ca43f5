import hashlib
import random

import numpy as np

from cohortspark.llm import iblt


def plain_near(a, b):
    x, y = set(iblt.digests(a).tolist()), set(iblt.digests(b).tolist())
    return 1.0 if a == b or not x | y else len(x & y) / len(x | y)


def test_versions_equal_a_plain_count(documents, docs, odd_texts):
    for frame in (documents, docs(*odd_texts), docs("alone in the table"), docs((3, "c" * 9), (1, "a" * 9), (2, ""))):
        rows = sorted((r.doc_id, r.text or "") for r in frame.collect())
        found = {r.doc_id: r for r in iblt.versions(frame).collect()}
        assert len(found) == len(rows)
        for k, (key, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            n = len(text)
            edited = text[: n - n // 4] + following[: n // 4]
            r = found[key]
            assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == iblt.Fingerprint(text).hex() and r.edited_fingerprint == iblt.Fingerprint(edited).hex()
            assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
            assert r.near_edited == plain_near(text, edited) and r.near_next == plain_near(text, following)


def test_peeling_brings_back_what_differs():
    rng = random.Random(6)
    for common, mine, theirs in ((0, 0, 0), (50, 1, 0), (50, 2, 2), (500, 40, 60), (0, 3000, 2000), (5000, 0, 1)):
        keys = [rng.getrandbits(64) for _ in range(common + mine + theirs)]
        a = np.array(keys[: common + mine], np.uint64)
        b = np.array(keys[:common] + keys[common + mine :], np.uint64)
        only_a, only_b = iblt.difference(a, b)
        assert sorted(only_a.tolist()) == sorted(keys[common : common + mine])
        assert sorted(only_b.tolist()) == sorted(keys[common + mine :])


def test_a_small_table_gets_stuck_and_says_so():
    keys = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    none = np.zeros(0, np.uint64)
    assert iblt.peel(iblt.sketch(keys), iblt.sketch(none)) is None
    assert len(iblt.peel(iblt.sketch(keys, 600), iblt.sketch(none, 600))[0]) == 199


def test_repeated_pieces_and_their_order_count():
    assert iblt.Fingerprint("a\nb").hex() != iblt.Fingerprint("b\na").hex()
    assert iblt.Fingerprint("a\na").near(iblt.Fingerprint("a")) == (0.5, 1)


def test_one_row_is_copied_for_each_part(spark, docs):
    frame = docs(*[(None, f"text {i}") for i in range(30)], *[(7, f"seven {i}") for i in range(30)], *[(i, str(i)) for i in range(8, 60)])
    rows = iblt.with_next(frame, "doc_id", "text").collect()
    last = max(r.part for r in rows)
    assert sum(r.copy for r in rows) == last + 1 and len(rows) == frame.count() + last + 1
    closing = {r.part: (r.doc_id, r.t) for r in rows if r.copy}
    own = [sorted(((r.doc_id is not None, r.doc_id or 0), r.t) for r in rows if r.part == p and not r.copy) for p in range(last + 1)]
    for p in range(last + 1):
        key, text = own[(p + 1) % (last + 1)][0]
        assert closing[p] == ((key[1] if key[0] else None), text)
