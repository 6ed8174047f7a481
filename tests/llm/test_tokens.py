import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from rangescan.llm import tokenizing
from rangescan.llm.token_counts import CACHE, token_counts
from rangescan.llm.token_file import Shard, read_token_files, shard_bytes, token_ids, write_token_files
from rangescan.llm.tokenizing import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Encoder(WORDS).tokenizer


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_chunk_cache_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_CHUNKS", 500)
    enc, rng = Encoder(WORDS), random.Random(1)
    letters = "aAbBtThe '’.,!?s019 \n\t\x0b\x1f\x85 éÉİßΣς漢̸́K🎉\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "<|ENDOFTEXT|> a", "don't WE'LL. a., a,."]) for _ in range(2000)]
    assert enc.chunked and not Encoder(BYTES).chunked
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.id_bytes([t.encode() for t in texts])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_codes_give_random_access():
    rng = np.random.default_rng(0)
    for ids_ in (np.zeros(0, np.uint32), rng.integers(0, 256, 700), rng.integers(0, 2**32, 5000), rng.integers(0, 50_000, 5000)):
        ids_ = ids_.astype("<u4")
        shard = Shard(shard_bytes([3, None], [ids_.tobytes(), b""]))
        assert len(shard) == len(ids_) and [d for d, _, _ in shard.documents()] == [3, None]
        assert all(shard.get(i) == ids_[i] for i in range(0, len(ids_), 97))
        for a, b in ((0, len(ids_)), (len(ids_) // 3, len(ids_) // 2)):
            assert (shard.slice(a, b) == ids_[a:b]).all()
    with pytest.raises(IndexError):
        shard.get(5000)
    with pytest.raises(ValueError):
        Shard(b"something else")


def expected(library, rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out, at = [], 0
    for d, t in rows:
        one = [*ids(library, t), 1]
        out.append((d, at, len(one), zlib.crc32(np.array(one, "<u4").tobytes())))
        at += len(one)
    return out


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def test_files_hold_all_ids_in_order(docs, odd, none, library, tmp_path):
    assert sorted(map(tuple, token_ids(docs, WORDS).collect())) == expected(library, docs.select("doc_id", "text").collect())
    small = write_token_files(odd, WORDS, str(tmp_path / "ids"), shard_tokens=5)
    assert small.count() > 4
    assert sorted(map(tuple, read_token_files(small).collect()), key=lambda r: r[1]) == expected(library, odd.select("doc_id", "text").collect())
    assert token_ids(none, WORDS).count() == 0


def test_counts_and_the_cache(spark, docs, odd, none, library, tmp_path):
    cache = str(tmp_path / "cache")
    want = lambda df, n=2048: sorted(((d, len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > n) for d, t in df.select("doc_id", "text").collect()), key=key)
    assert sorted(map(tuple, token_counts(odd, WORDS, cache).collect()), key=key) == want(odd)
    kept = spark.read.schema(CACHE).parquet(cache)
    first = kept.count()
    assert first == kept.select("digest").distinct().count() < odd.count()
    # stored counts are used: a planted one comes back
    token_counts(odd, WORDS, cache).collect()
    assert spark.read.schema(CACHE).parquet(cache).count() == first
    assert sorted(map(tuple, token_counts(docs.union(docs), WORDS, cache, limit=100).collect())) == want(docs.union(docs), 100)
    assert token_counts(none, WORDS).count() == 0


def test_other_tokenizer(odd):
    library = Encoder(BYTES).tokenizer
    got = sorted(map(tuple, token_counts(odd.where("doc_id < 3"), BYTES).select("doc_id", "n_tokens").collect()))
    assert got == sorted((d, len(ids(library, t))) for d, t in odd.where("doc_id < 3").select("doc_id", "text").collect())
