import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(PATH, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


TEXT = st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85\u00a0\u3000'abst!1"), st.characters(exclude_categories=["Cs"])))


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_as_the_library_and_back(text):
    packed = CODEC.encode(text)
    assert ids(packed) == THEIRS.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


def test_every_blank_next_to_words():
    for point in [*range(0x20), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]:
        for text in (f"a {chr(point)}b c", f"a{chr(point)} b", f"{chr(point)}a b ", f"a {chr(point)} b"):
            assert ids(CODEC.encode(text)) == THEIRS.encode_ordinary(text), hex(point)


def test_merges_of_long_words_as_the_library():
    rng = random.Random(3)
    for n in (1, 2, 3, 17, 400, 20_000):
        word = "".join(rng.choices("aeinrstth\u00e9\u4f60", k=n))
        assert bpe.merge(word.encode(), CODEC.ranks) == THEIRS.encode_ordinary(word)


def test_frames(documents):
    rows = {r.doc_id: r for r in bpe.encode_texts(documents, PATH, P.PATTERN).collect()}
    for r in documents.collect():
        assert ids(rows[r.doc_id].ids) == THEIRS.encode_ordinary(r.text or "")
    back = bpe.decode_ids(bpe.encode_texts(documents, PATH, P.PATTERN), PATH, P.PATTERN)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert all(bytes(r.text_bytes).decode() == (texts[r.doc_id] or "") for r in back.collect())


def test_unknown_id():
    with pytest.raises(KeyError):
        CODEC.decode(struct.pack("<I", 60_000))
