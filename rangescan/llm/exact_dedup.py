"""Exact duplicates through content-defined chunk recipes.

A text is cut where a rolling hash of its last bytes has a given pattern, so equal passages give equal
chunks wherever they stand. Chunks are deduplicated to verified identifiers: chunks of one digest are
compared byte by byte, and a second content under the same digest gets an identifier of its own. A
document is then the ordered list of its chunk identifiers, 16 bytes each; only these lists are
grouped and compared. Long texts are moved once, and chunks that repeat within a task not at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import cut, doc_frame, ids_of, partitions, sliced, texts_of

#: Bytes of the rolling window; a cut is made where its hash has CUT_BITS zero bits; bytes of a chunk at least and at most.
WINDOW, CUT_BITS, LEAST, MOST = 16, 11, 512, 16_384
#: Digests that a task remembers before it starts anew.
SEEN = 500_000
#: Odd multiplier of the rolling hash.
FACTOR = np.uint32(2_654_435_761)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h = b[WINDOW - 1 :].copy()
    weight = np.uint32(1)
    for k in range(1, WINDOW):  # window sum of byte * FACTOR^age: depends on these bytes alone
        weight = np.uint32(int(weight) * int(FACTOR) & 0xFFFFFFFF)
        h += b[WINDOW - 1 - k : n - k] * weight
    marks = (np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW).tolist()
    out, at = [], 0
    for m in marks:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST:
            at = m
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.sha256(chunk).digest()[:size]


def _recipes(batches, size: int):
    for batch in sliced(batches):
        texts = [t.lower() for t in texts_of(batch)]  # bytes: A-Z only
        lists = [[_digest(c, size) for c in chunks(t)] for t in texts]
        yield pa.record_batch([ids_of(batch), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "text_sha256", "recipe"])


def _chunk_rows(batches, size: int):
    """(digest, bytes), each content once per task, or once per SEEN contents of it."""
    seen: set[bytes] = set()
    for batch in sliced(batches):
        if len(seen) > SEEN:
            seen.clear()
        keys, parts = [], []
        for t in texts_of(batch):
            for c in chunks(t.lower()):
                full = hashlib.sha256(c).digest()
                if full not in seen:
                    seen.add(full)
                    keys.append(full[:size])
                    parts.append(c)
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(parts, pa.binary())], ["digest", "content"])


def _clashes(batches):
    """Of rows sorted by digest: digests that stand for more than one content."""
    last_key = last = None
    told = False
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != last_key:
                last_key, last, told = k, c, False
            elif c != last and not told:
                out.append(k)
                told = True
        yield pa.record_batch([pa.array(out, pa.binary())], ["digest"])


def verified_recipes(docs: DataFrame, digest_bytes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified chunk identifiers of every row, A-Z lower-cased."""
    frame, n = doc_frame(docs, id_col, text_col), partitions(docs.sparkSession)
    recipes = cut(frame.mapInArrow(lambda b: _recipes(b, digest_bytes), "doc_id long, text_sha256 string, recipe array<binary>"), "recipes")
    rows = frame.select("text").mapInArrow(lambda b: _chunk_rows(b, digest_bytes), "digest binary, content binary")
    clashes = cut(rows.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(_clashes, "digest binary").distinct(), "chunk-clashes")
    if clashes.isEmpty():
        return recipes
    # contents that share a digest are numbered, and recipes with such a digest are written anew
    spread = lambda batches: _spread(batches, digest_bytes)
    parts = cut(frame.mapInArrow(spread, "doc_id long, text_sha256 string, place long, digest binary, content binary"), "chunk-places")
    named = parts.join(clashes, "digest", "left_semi").select("digest", "content").distinct()
    named = named.groupBy("digest").agg(F.array_sort(F.collect_list("content")).alias("contents"))
    known = parts.join(named, "digest", "left").withColumn("id", F.when(F.col("contents").isNull(), F.col("digest")).otherwise(F.concat("digest", F.array_position("contents", F.col("content")).cast("string").cast("binary"))))
    # equal rows of one document id share their list, as equal texts do
    fixed = known.groupBy("doc_id", "text_sha256", "place").agg(F.first("id").alias("id")).groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids"))
    fixed = fixed.select("doc_id", "text_sha256", F.transform("ids", lambda x: x.id).alias("fixed"))
    a, b = recipes.alias("a"), fixed.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_sha256") == F.col("b.text_sha256")), "left")
    return joined.select("a.doc_id", "a.text_sha256", F.coalesce("fixed", "recipe").alias("recipe"))


def _spread(batches, size: int):
    for batch in sliced(batches):
        rows = [(d, hashlib.sha256(t).hexdigest(), k, _digest(c, size), c) for d, t in zip(ids_of(batch).to_pylist(), (x.lower() for x in texts_of(batch)), strict=True) for k, c in enumerate(chunks(t))]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "text_sha256", "place", "digest", "content"])


def exact_duplicates(docs: DataFrame, digest_bytes: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a
    group stays; a row with a null id is kept only where its whole group has none. Rows that repeat the
    largest id are all kept. An empty table gives an empty table; other columns are ignored.
    """
    recipes = verified_recipes(docs, digest_bytes, id_col, text_col)
    groups = cut(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    return recipes.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
