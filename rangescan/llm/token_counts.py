"""Token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer file.
Documents are joined to the stored counts, only distinct misses are encoded, and their counts are
appended to the cache, which later runs read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangescan.llm.common import cut, doc_frame, fresh_dir, ids_of, sliced, texts_of
from rangescan.llm.tokenizing import encoder

#: Digests that a task remembers before it starts anew.
SEEN = 500_000
CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: bytes) -> bytes:
    """Content as far as the count can depend on it: white space at the ends is dropped by every tokenizer read here."""
    return text.strip()


def _digests(batches, strip: bool):
    for batch in sliced(batches):
        texts = texts_of(batch)
        keys = [hashlib.blake2b(normalised(t) if strip else t, digest_size=16).digest() for t in texts]
        yield pa.record_batch([ids_of(batch), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "n_bytes", "digest"])


def _first_texts(batches, strip: bool):
    """Each content once per task (or per SEEN contents of it), so a hot group of copies is not moved row by row."""
    seen: set[bytes] = set()
    for batch in sliced(batches):
        if len(seen) > SEEN:
            seen.clear()
        texts, keys, kept = texts_of(batch), [], []
        for t in texts:
            t = normalised(t) if strip else t
            k = hashlib.blake2b(t, digest_size=16).digest()
            if k not in seen:
                seen.add(k)
                keys.append(k)
                kept.append(t)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(kept, pa.binary()).cast(pa.string())], ["digest", "text"])


def _counts(batches, path: str):
    seen: set[bytes] = set()
    enc = encoder(path)
    for batch in sliced(batches):
        if len(seen) > SEEN:
            seen.clear()
        keys, texts = [], []
        for k, t in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            if k not in seen:
                seen.add(k)
                keys.append(k)
                texts.append(t)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([len(x) // 4 for x in enc.id_bytes(texts)], pa.int64())], ["digest", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, cache_dir: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated, a null id stays null,
    an empty table gives an empty table, other columns are ignored. ``cache_dir`` holds the counts
    between runs; without it the run starts an empty cache in the shared folder.
    """
    spark = docs.sparkSession
    frame, version = doc_frame(docs, id_col, text_col), tokenizer_version(tokenizer_path)
    strip = encoder(tokenizer_path).chunked
    cache_dir = cache_dir or fresh_dir(spark, "token-cache")
    try:
        cache = spark.read.schema(CACHE).parquet(cache_dir)
    except AnalysisException:
        cache = spark.createDataFrame([], CACHE)
    known = cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")

    keyed = cut(frame.mapInArrow(lambda b: _digests(b, strip), "doc_id long, n_bytes long, digest binary"), "token-digests")
    missing = keyed.select("digest").distinct().join(known, "digest", "left_anti")
    texts = frame.select("text").mapInArrow(lambda b: _first_texts(b, strip), "digest binary, text string").join(missing, "digest", "left_semi")
    new = texts.mapInArrow(lambda b: _counts(b, tokenizer_path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_dir)

    stored = spark.read.schema(CACHE).parquet(cache_dir).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    return keyed.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
