import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours(a, b):
    """Whether two words differ by exactly one letter inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
    by = {}
    for w in words:  # words at a distance of one share themselves, or what is left without one letter
        for key in {w, *[w[:i] + w[i + 1 :] for i in range(len(w))]}:
            by.setdefault(key, []).append(w)
    near = {w: set() for w in words}
    for some in by.values():
        for a in some:
            near[a] |= {b for b in some if neighbours(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=lambda r: r[0])


def found(frame):
    return sorted(map(tuple, spelling.variants(frame).collect()), key=lambda r: r[0])


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = plain(rows)
    assert found(documents) == want
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_short_words_of_few_letters(spark, docs):
    some = random.Random(3)
    words = ["".join(some.choice("abcé") for _ in range(some.randint(4, 7))) for _ in range(600)]
    texts = [" ".join(some.choices(words, weights=[1 / (i + 1) for i in range(600)], k=400)) for _ in range(30)]
    want = plain(list(enumerate(texts)))
    assert found(docs(*texts)) == want
    assert max(r[4] for r in want) > 5


def test_odd_rows(spark, docs, odd_texts):
    rows = [*odd_texts, "x" * 3000 + " " + "x" * 3001 + " " + "x" * 2999 + "y", "École école ÉCOLE ecole"] * 3
    texts = [*rows, (None, "nulls nulls nulls nulle nulle nulle"), (None, None)]
    given_rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert found(docs(*texts, extra=True)) == plain(given_rows)
    assert spelling.variants(docs("x").where("false")).count() == 0


@given(st.text("abàz", min_size=4, max_size=9), st.integers(0, 8), st.sampled_from("abàz"), st.sampled_from("idr"))
@settings(max_examples=300, deadline=None)
def test_near_words_share_a_signature(word, at, letter, how):
    at = min(at, len(word) - 1)
    other = {"i": word[:at] + letter + word[at:], "d": word[:at] + word[at + 1 :], "r": word[:at] + letter + word[at + 1 :]}[how]
    if other != word:
        shared = set(spelling.signatures(word)) & set(spelling.signatures(other))
        assert {same for _, same in shared} == {len(word) == len(other)} or (len(word) == len(other) and (True in {s for _, s in shared}))


def test_a_chain_of_forms_is_followed_to_its_end(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "e")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "e") for w in "abcdx"}
    assert spelling.roots(forms.where("false")).count() == 0
