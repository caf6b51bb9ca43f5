import random
import re

import numpy as np
import xxhash

from cohortspark.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    some = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(bits):
    """The smallest position that links of at most three bits reach, by comparing all."""
    out = list(range(len(bits)))
    changed = True
    while changed:
        changed = False
        for i in range(len(bits)):
            near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3)
            least = min(out[j] for j in near)
            for j in near:
                if out[j] != least:
                    out[j], changed = least, True
    return out


def test_groups_equal_a_comparison_of_all(documents, docs, odd_texts):
    for frame in (documents, docs(*odd_texts, "word ", "WORD")):
        rows = sorted(frame.select("doc_id", "text").collect())
        bits = np.array([plain_fingerprint(r.text) for r in rows], np.uint64)
        found = {r.doc_id: (r.bits, r.component_id) for r in simhash.groups(frame).collect()}
        for r, b, c in zip(rows, bits, plain_groups(bits)):
            assert found[r.doc_id] == (int(b.view(np.int64)), rows[c].doc_id)


def near_bits(rng, count):
    """Clouds and chains of fingerprints around a few centres."""
    out = set()
    for _ in range(count // 40):
        centre = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.randint(0, 3)):
                centre ^= 1 << rng.randrange(64)
            out.add(centre)
    return sorted(out)


def test_crowded_keys_give_the_same_groups(spark):
    rng = random.Random(4)
    bits = np.array(near_bits(rng, 1200), np.uint64)
    cloud = np.array([0x123456789ABCDEF ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(a)], np.uint64)
    bits = np.unique(np.concatenate([bits, cloud]))
    frame = spark.createDataFrame([(int(b.view(np.int64)), i) for i, b in enumerate(bits)], "bits bigint, node bigint")
    wanted = plain_groups(bits)
    for crowd in (simhash.CROWD, 20):
        found = {r.node: r.component for r in simhash.components(simhash.links(frame, 3, crowd)).collect()}
        assert [found.get(i, i) for i in range(len(bits))] == wanted


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.component for r in simhash.components(frame).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 300)} | {2001: 2000}


def test_pivot_tables_never_discard_a_link():
    rng = np.random.default_rng(5)
    bits = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0xFFFF))
    table = np.bitwise_count(bits[:, None] ^ simhash.references()).astype(np.int8)
    apart = np.bitwise_count(bits[:, None] ^ bits[None])
    assert (np.abs(table[:, None].astype(int) - table[None]).max(axis=2) <= apart).all()


def test_one_document_of_each_group_of_near_copies(docs):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ano", "ire", "olu", "ende")]
    texts, families = [], []
    for family in range(30):
        base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(150)]
        for copy in range(4):
            changed = list(base)
            if copy:
                changed[rng.randrange(150)] = "other"
            texts.append(" ".join(changed))
            families.append(family)
    texts += [texts[0]] * 3
    families += [0] * 3
    kept = [r.doc_id for r in simhash.keep_one(docs(*texts)).collect()]
    assert {families[i] for i in kept} == set(range(30))
    assert len(kept) <= 31 and 0 in kept


def test_repeated_rows_leave_one(docs):
    assert simhash.keep_one(docs((1, "same text"), (1, "same text"), (None, "same text"))).collect()[0].doc_id == 1
    assert simhash.keep_one(docs((None, ""), (None, None))).count() == 1


def alike_texts(rng, families=60):
    """Texts with variants of a similarity between about 0.7 and 0.9 on five words."""
    texts = []
    for family in range(families):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for _ in range(max(1, round(len(base) * rng.uniform(0.01, 0.045)))):
                changed[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
    return texts


def plain_kept(texts):
    """The first text of each group that exact similarities of 0.8 connect, by comparing all."""
    sets = []
    for t in texts:
        words = t.split()
        sets.append({" ".join(words[i : i + 5]) for i in range(len(words) - 4)})
    out = list(range(len(texts)))
    near = []
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                near.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in near:
            least = min(out[i], out[j])
            if out[i] != least or out[j] != least:
                out[i] = out[j] = least
                changed = True
    return {i for i, c in enumerate(out) if i == c}


def test_near_copies_by_the_exact_similarity(docs):
    texts = alike_texts(random.Random(21))
    wanted = plain_kept(texts)
    assert 70 < len(wanted) < 200
    assert {r.doc_id for r in simhash.keep_one(docs(*texts)).collect()} == wanted


def test_crowded_keys_of_near_copies_lose_none(docs, monkeypatch):
    from cohortspark.llm import nearcopies

    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(90):
        changed = list(base)
        for _ in range(rng.randint(1, 7)):
            changed[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    texts += alike_texts(rng, 5)
    wanted = plain_kept(texts)
    for hubs in (0, nearcopies.HUBS):
        monkeypatch.setattr(nearcopies, "HUBS", hubs)
        assert {r.doc_id for r in simhash.keep_one(docs(*texts), crowd=8).collect()} == wanted
