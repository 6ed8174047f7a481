import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rangescan.llm.pieces import PieceModel, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_backtracking_equals_merging(library, docs):
    m, rng = PieceModel(PATH), random.Random(5)
    letters = "aabbeett  ▁▁\n\t.,'<>0x1A12 éßñ漢字🎉́s/\\_-#{}()ABTHEing\x00"
    pieces = [p for p in m.piece if len(p) > 2]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces)[: rng.randint(1, 6)] for _ in range(rng.randint(1, 7))).replace("▁", rng.choice([" ", "", "▁"])) for _ in range(3000)]
    texts += [r.text for r in docs.select("text").collect()] + ["", " ", "  a", "x" * 5000, "<s></s><unk><0x0A>"]
    for t in texts:
        got = m.encode(t)
        assert got == library.encode(t, add_bos=True, add_eos=True), t
        assert m.decode(got) == library.decode(got), t


def test_whole_runs_equal_merges_too():
    m = PieceModel(PATH)
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("aeioustrnlhd▁") for _ in range(rng.randint(1, 25)))
        assert m._backtrack(t) == m._merge(t)


def test_rows(odd, none, library):
    got = encode_pieces(odd, PATH, with_ids=True).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(list(r.ids)) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    texts = sorted((r.text or "") for r in odd.collect())
    assert sorted(library.encode(t, add_bos=True, add_eos=True) for t in texts) == sorted(list(r.ids) for r in got)
    assert encode_pieces(none, PATH).count() == 0
