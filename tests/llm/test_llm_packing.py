import json
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from cohortspark.llm import packing

PATH = P.path("byte_bpe_50k.json")


def test_every_id_lies_in_one_piece_and_sequences_are_full(documents, docs, odd_texts):
    theirs = Tokenizer.from_file(PATH)
    spelled = ["a<|endoftext|>b", "<|endoftext|> <|endoftext|><|endoftext", " <|endoftext|>\n"]
    for frame in (documents, docs(*odd_texts, *spelled)):
        pieces = packing.pack(frame, PATH, P.PATTERN).collect()
        of_doc, of_sequence = defaultdict(list), defaultdict(list)
        for p in pieces:
            of_doc[p.doc_id].append(p)
            of_sequence[p.sequence_id].append(p)
        for r in frame.collect():
            wanted = theirs.encode(r.text or "", add_special_tokens=False).ids + [1]
            mine = sorted(of_doc[r.doc_id], key=lambda p: p.start)
            assert [x for p in mine for x in np.frombuffer(p.ids, "<u4").tolist()] == wanted
            at = 0
            for p in mine:
                assert p.start == at and p.doc_tokens == len(wanted) and p.length == len(p.ids) // 4
                at += p.length
        for some in of_sequence.values():
            at = 0
            for p in sorted(some, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048 and at & (at - 1) == 0


def test_hilbert_places_are_a_walk_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        axes = np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")
        points = np.stack([a.ravel() for a in axes], axis=1)
        places = packing.hilbert(points, bits)
        assert sorted(places) == list(range(len(points)))
        walk = points[np.argsort(places)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_cut_splits_the_rest_into_powers_of_two():
    for sizes in ([5], [2048], [3000, 1, 1, 7], [1] * 13, [4096]):
        out = list(packing.cut([(i, n) for i, n in enumerate(sizes)], 2048))
        assert [sum(x[2] for x in out if x[0] == i) for i in range(len(sizes))] == sizes
        fill = defaultdict(int)
        for _, _, size, sequence, offset in out:
            assert offset == fill[sequence]
            fill[sequence] += size
        assert all(n & (n - 1) == 0 and n <= 2048 for n in fill.values())


def test_alike_documents_are_neighbours(docs):
    texts = ["alpha beta gamma delta epsilon " * 40, "eins zwei drei vier " * 50] * 10
    pieces = packing.tokenized(docs(*texts), PATH, P.PATTERN).collect()
    order = [r.doc_id % 2 for r in sorted(pieces, key=lambda r: r.place)]
    assert order in ([0] * 10 + [1] * 10, [1] * 10 + [0] * 10)


def test_a_file_whose_ids_do_not_follow_its_merges(tmp_path):
    with open(PATH) as file:
        said = json.load(file)
    merges = said["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(said))
    other, text = packing.Merges(str(path), P.PATTERN), "the theme of the tenth thin thing"
    assert not hasattr(other, "merges") and hasattr(packing.Merges(PATH, P.PATTERN), "merges")
    assert other.encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
