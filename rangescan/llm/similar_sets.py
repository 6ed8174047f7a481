"""Exact completion of classes of similar texts: no pair with the similarity is left between two classes.

Texts are sets of word shingles, numbered by a hash. Under any fixed order of all shingles, two sets with
Jaccard similarity t share one of the first n - ceil(t * n) + 1 shingles of either, so all pairs meet in the
lists of these. A list whose members are of one class has nothing to add. In the others, pairs of different
classes pass three filters that lose no pair:

- the sizes, and the places of the shared shingle (the first one that a pair shares always passes);
- a count filter over byte positions: the shingles of a text fall by hash into POSITIONS positions, and a
  byte for each says how many; the lesser bytes of two texts, summed, are at least what they share, and
  pairs below the guaranteed minimum go.

What is left is told as (text, other class), once, however many of the class the text met. A task then
holds a block of the class as an inverted index and tallies what the text shares with every member.

No table of shingles is written: as hashes they are larger than the texts. Texts go where they are compared,
and only those that are; the count filter needs no more of a text than its bytes.

Shingles that many texts have come last in the order, as far as a sample tells them: the sample changes
how long the lists are, not what is found. Long lists are parted into blocks, each pair of which is a task's.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import Scratch, cut, groups, partitions, sliced, small, texts_of
from rangescan.llm.passages import shingle_hashes

#: Byte positions of the count filter.
POSITIONS = 128
#: One text of so many is sampled; a shingle of so many sampled texts comes last; bits of the table that says so.
SAMPLE, OFTEN, BITS = 32, 3, 20
#: Members of a block of a long list; shingles of a block of a class.
BLOCK, BLOCK_GRAMS = 2048, 4_000_000
#: Pairs whose bytes are compared at a time.
_TOGETHER = 50_000


def grams_of(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, min(shingle, max(1, len(words)))) if words else np.zeros(1, np.uint64))


def positions_of(grams: np.ndarray) -> bytes:
    """How many shingles fall into each position; all 255 where one has more than a byte holds, which bounds nothing."""
    n = np.bincount((grams >> np.uint64(40) & np.uint64(POSITIONS - 1)).astype(np.int64), minlength=POSITIONS)
    return (np.full(POSITIONS, 255) if n.max() > 254 else n).astype(np.uint8).tobytes()


def _least(similarity: float, sizes):
    """Shingles that two sets share at least, by the sum of their sizes."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-6)


def _count_rows(batches, shingle: int):
    for batch in sliced(batches):
        grams = [grams_of(t, shingle) for t in texts_of(batch)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(g) for g in grams], pa.int64()), pa.array([positions_of(g) for g in grams], pa.binary())], ["rep", "class", "n", "bytes"])


def _sample_rows(batches, shingle: int):
    for batch in sliced(batches):
        for t in texts_of(batch):
            yield pa.record_batch([pa.array(grams_of(t, shingle).view(np.int64))], ["gram"])


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Table of bits, by the low bits of a shingle: set where a sample says that many texts have it. At most 2^BITS numbers reach the driver."""
    grams = texts.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(lambda b: _sample_rows(b, shingle), "gram long")
    often = grams.groupBy("gram").count().where(F.col("count") >= OFTEN).select(F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit")).distinct()
    table = np.zeros(1 << BITS, bool)
    table[often.toPandas()["bit"].to_numpy(np.int64)] = True
    return table


def _posting_rows(batches, shingle: int, similarity: float, table: np.ndarray):
    """Rows (key, class, rep, size, n, place) for the first shingles of each text in the order."""
    mask = np.uint64((1 << BITS) - 1)
    for batch in sliced(batches):
        keys, counts, sizes, places = [], [], [], []
        for t in texts_of(batch):
            g = grams_of(t, shingle)
            late = table[(g & mask).astype(np.int64)]
            first = np.concatenate([g[~late], g[late]])[: len(g) - math.ceil(similarity * len(g) - 1e-9) + 1]
            keys.append(first)
            counts.append(len(first))
            sizes.append(len(g))
            places.append(np.arange(len(first)))
        if keys:
            rep, own, size = (np.repeat(np.asarray(batch.column(k)), counts) for k in range(3))
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(own), pa.array(rep), pa.array(size), pa.array(np.repeat(sizes, counts).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "class", "rep", "size", "n", "place"])


def _crowded(batches, size: int):
    """Of rows sorted by (key, class): the lists with more than one class, with the block of each row and the blocks of its list."""
    for cols in groups(batches, 1):
        key, own = cols[:2]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(new, len(key)))
        mixed = np.repeat(own[new] != own[new + sizes - 1], sizes)
        block = ((np.arange(len(key)) - np.repeat(new, sizes)) // size).astype(np.int32)
        blocks = np.repeat(-(-sizes // size), sizes).astype(np.int32)
        yield pa.record_batch([pa.array(c[mixed]) for c in (*cols, block, blocks)], ["key", "class", "rep", "size", "n", "place", "block", "blocks"])


def _met(batches, similarity: float):
    """(rep, hub): of each pair that passes the filters, the text of the smaller class and the other class."""
    for batch in groups(batches, 3, arrow=True):
        key, first, second, own, rep, size, n, place, block = (np.asarray(batch.column(k)) for k in range(9))
        data = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(-1, POSITIONS)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        found = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            if own[a:b].min() == own[a:b].max():
                continue
            left = a + np.flatnonzero(block[a:b] == first[a])
            right = a + np.flatnonzero(block[a:b] == second[a])
            step = max(1, (1 << 20) // max(1, len(right)))
            for k in range(0, len(left), step):
                x, y = left[k : k + step, None], right[None, :]
                need = _least(similarity, n[x] + n[y])
                good = (own[x] != own[y]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need)
                if first[a] == second[a]:
                    good &= x < y
                i, j = np.nonzero(good)
                i, j, need = left[k + i], right[j], need[i, j]
                for m in range(0, len(i), _TOGETHER):
                    p, q = i[m : m + _TOGETHER], j[m : m + _TOGETHER]
                    shared = np.minimum(data[p], data[q]).sum(axis=1, dtype=np.int64)
                    close = (shared >= need[m : m + _TOGETHER]) | (data[p, 0] == 255) | (data[q, 0] == 255)
                    p, q = p[close], q[close]
                    swap = (size[p] > size[q]) | ((size[p] == size[q]) & (own[p] < own[q]))
                    p, q = np.where(swap, q, p), np.where(swap, p, q)
                    found.append(np.column_stack([rep[p], own[q]]))
        if found:
            out = np.unique(np.concatenate(found), axis=0)
            yield pa.record_batch([pa.array(np.ascontiguousarray(out[:, 0])), pa.array(np.ascontiguousarray(out[:, 1]))], ["rep", "hub"])


def _tallied(batches, shingle: int, similarity: float):
    """Of rows (hub, block, probe, rep, text) sorted by the first three: a link of each probe to a member of the block that is similar."""
    state, members, index = None, [], None
    for batch in sliced(batches):
        a, b = [], []
        hubs, blocks, probes, reps = (batch.column(k).to_pylist() for k in range(4))
        for hub, block, probe, rep, text in zip(hubs, blocks, probes, reps, texts_of(batch), strict=True):
            if state != (hub, block):
                state, members, index = (hub, block), [], None
            if probe and not members:
                continue
            grams = grams_of(text, shingle)
            if not probe:
                members.append((rep, grams))
                continue
            if index is None:
                names, sizes = np.array([m[0] for m in members]), np.array([len(m[1]) for m in members])
                pool, owner = np.concatenate([m[1] for m in members]), np.repeat(np.arange(len(members)), sizes)
                order = np.argsort(pool, kind="stable")
                index = pool[order], owner[order], names, sizes
            pool, owner, names, sizes = index
            low, high = np.searchsorted(pool, grams), np.searchsorted(pool, grams, side="right")
            times = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            both = np.bincount(owner[at], minlength=len(names))
            hit = np.flatnonzero((both >= similarity * (sizes + len(grams) - both)) & (names != rep))
            if len(hit):
                a.append(rep)
                b.append(int(names[hit[0]]))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links_between(texts: DataFrame, shingle: int, similarity: float, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(a, b): links between classes of ``texts`` (rep, class, size of the class, text), one at least for each two classes with a similar pair.

    Every linked pair reaches the similarity. An empty table gives an empty table.
    """
    spark, n = texts.sparkSession, partitions(texts.sparkSession)
    texts = texts.select("rep", "class", "size", "text")
    table = spark.sparkContext.broadcast(_frequent(texts, shingle))
    scratch = Scratch()
    row = "key long, class long, rep long, size long, n int, place int"
    postings = texts.mapInArrow(lambda b: _posting_rows(b, shingle, similarity, table.value), row)
    lists = scratch.cut(postings.repartition(n, "key").sortWithinPartitions("key", "class").mapInArrow(lambda b: _crowded(b, block), f"{row}, block int, blocks int"), "shingle-lists")
    wanted = scratch.cut(lists.select("rep").distinct(), "shingle-reps")
    counts = scratch.cut(texts.join(small(wanted), "rep", "left_semi").select("rep", "class", "text").mapInArrow(lambda b: _count_rows(b, shingle), "rep long, class long, n long, bytes binary"), "shingle-counts")
    placed = lists.join(counts.select("rep", "bytes"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = ["key", "first", "second"]
    placed = placed.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "class", "rep", "size", "n", "place", "block", "bytes")
    probes = scratch.cut(placed.repartition(n, *pair).sortWithinPartitions(*pair).mapInArrow(lambda b: _met(b, similarity), "rep long, hub long").distinct(), "shingle-probes")

    hubs = scratch.cut(probes.select("hub").distinct(), "similar-hubs")
    hubs = counts.select(F.col("class").alias("hub"), "rep", "n").join(small(hubs), "hub", "left_semi")
    blocks = scratch.cut(hubs.groupBy("hub").agg(F.ceil(F.sum("n") / block_grams).cast("int").alias("blocks")), "similar-blocks")
    members = hubs.join(small(blocks), "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("probe"), "rep").distinct()
    asked = probes.join(small(blocks), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), "rep")
    placed = texts.select("rep", "text").join(small(scratch.cut(members.union(asked), "similar-places")), "rep").select("hub", "block", "probe", "rep", "text")
    at = ["hub", "block"]
    links = cut(placed.repartition(n, *at).sortWithinPartitions(*at, "probe").mapInArrow(lambda b: _tallied(b, shingle, similarity), "a long, b long"), "similar-links")
    scratch.discard()
    return links
