"""Token ids in directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level 1 the
second chunk of those ids that need one, and so on. Each level has a bitmap that says which of its
ids go on, and a directory with the number of set bits before every 512-bit block. An id at any place
is read with one rank per level; no block is decoded around it.

A shard file: magic, header length (8 bytes), JSON header (counts, and offset and length of each
section), sections. All integers are little-endian.
"""

from __future__ import annotations

import json
import uuid
import zlib
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangescan.llm.common import cut, doc_frame, fresh_dir, open_fs, partitions, sliced, texts_of
from rangescan.llm.tokenizing import encoder

MAGIC, BLOCK = b"DACIDS01", 512
#: A task starts another shard beyond this many ids, which bounds its memory.
SHARD_TOKENS = 2_000_000


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, continuation bitmap, rank directory)."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        per_block = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([np.zeros(1, np.uint64), np.cumsum(per_block, dtype=np.uint64)])))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return levels


class Shard:
    """Random access to the ids of one shard file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(data[8:16], "little")
        self.header = json.loads(data[16 : 16 + size])
        base = 16 + size

        def section(name: str, kind: str) -> np.ndarray:
            at, n = self.header["sections"][name]
            return np.frombuffer(data, dtype=kind, count=n // np.dtype(kind).itemsize, offset=base + at)

        self.levels = [(section(f"chunks{k}", "u1"), section(f"bits{k}", "u1"), section(f"ranks{k}", "<u8")) for k in range(self.header["levels"])]
        self.doc_ids, self.has_id, self.offsets = section("doc_ids", "<i8"), section("has_id", "u1"), section("offsets", "<u8")

    def __len__(self) -> int:
        return self.header["n_tokens"]

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Set bits before place i."""
        block = i // BLOCK
        first, last = block * BLOCK // 8, i // 8
        n = int(ranks[block]) + int(np.bitwise_count(bits[first:last]).sum())
        return n + (int(bits[last] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def get(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1: one rank at each end and level."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if start == stop:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            first = start // 8
            more = np.unpackbits(bits[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[more]
            start, stop = self._rank(bits, ranks, start), self._rank(bits, ranks, stop)
        return out

    def documents(self):
        """(doc_id or None, offset in the shard, ids) in file order."""
        for k, doc in enumerate(self.doc_ids.tolist()):
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            yield (doc if self.has_id[k] else None), a, self.slice(a, b)


def shard_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One shard of documents with their ids (4 bytes each)."""
    counts = np.array([len(x) // 4 for x in ids], np.uint64)
    levels = pack(np.frombuffer(b"".join(ids), dtype="<u4"))
    parts = {"doc_ids": np.array([x or 0 for x in doc_ids], "<i8"), "has_id": np.array([x is not None for x in doc_ids], "u1"), "offsets": np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts)]).astype("<u8")}
    for k, (chunks, bits, ranks) in enumerate(levels):
        parts |= {f"chunks{k}": chunks, f"bits{k}": bits, f"ranks{k}": ranks.astype("<u8")}
    sections, at, blobs = {}, 0, []
    for name, part in parts.items():
        blob = part.tobytes()
        sections[name] = (at, len(blob))
        at += len(blob)
        blobs.append(blob)
    header = json.dumps({"version": 1, "n_tokens": int(counts.sum()), "n_docs": len(ids), "levels": len(levels), "sections": sections}).encode()
    return MAGIC + len(header).to_bytes(8, "little") + header + b"".join(blobs)


def _write(batches, path: str, folder: str, end_id: int, shard_tokens: int):
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    store, root = open_fs(folder)
    store.create_dir(root, recursive=True)
    docs: list[int | None] = []
    ids: list[bytes] = []
    held = seq = 0
    part = TaskContext.get().partitionId()

    def flush():
        nonlocal docs, ids, held, seq
        name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.dac"  # another name for each attempt
        with store.open_output_stream(str(PurePosixPath(root) / name)) as f:
            f.write(shard_bytes(docs, ids))
        row = pa.record_batch([pa.array([v]) for v in (part, seq, f"{folder}/{name}", held, len(docs))], ["part", "seq", "path", "n_tokens", "n_docs"])
        docs, ids, held, seq = [], [], 0, seq + 1
        return row

    for batch in sliced(batches):
        for doc, one in zip(batch.column(0).to_pylist(), enc.id_bytes(texts_of(batch)), strict=True):
            one += end
            docs.append(doc)
            ids.append(one)
            held += len(one) // 4
            if held >= shard_tokens:
                yield flush()
    if docs:
        yield flush()


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` to each, write shards in ascending id order; returns the manifest.

    Null texts count as empty (only the end id), null ids come first, rows with equal ids keep the order
    of their texts. Manifest: part, seq (their order is the order of the shards), path, n_tokens, n_docs.
    """
    n = partitions(docs.sparkSession)
    ordered = doc_frame(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(lambda b: _write(b, tokenizer_path, folder, end_id, shard_tokens), "part long, seq long, path string, n_tokens long, n_docs long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read from the shards of a manifest; a manifest without shards gives no rows.

    The driver adds up one number for each part, a writing task; the shards of a part are added up in a task.
    """
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each writing task
        rows.append((r.part, base))
        base += r.n
    bases = F.broadcast(spark.createDataFrame(rows, "part long, base long"))
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "seq", "path", F.coalesce(before, F.lit(0)).alias("before")).join(bases, "part").select("path", (F.col("base") + F.col("before")).alias("base"), "part", "seq")
    files = files.repartitionByRange(partitions(spark), "part", "seq").select("path", "base")

    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = open_fs(path)
                with store.open_input_stream(name) as f:
                    shard = Shard(f.read())
                out = [(doc, first + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc, a, ids in shard.documents()]
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, folder or fresh_dir(docs.sparkSession, "token-files"), **options))
