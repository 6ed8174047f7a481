"""SimHash near-duplicates with an inverted index over the byte positions of the fingerprints.

Two fingerprints within ``max_bits`` differing bits agree in at least 8 - max_bits of their 8 bytes.
A list for each single byte would hold 1/256 of all documents, so a posting stands for a whole set of
8 - max_bits positions with their bytes: every pair that can reach the guaranteed count of equal bytes
meets in a list, and a list holds at most 256 ** max_bits distinct fingerprints whatever the input.
Within a list the equal bytes of a pair are tallied, pairs below the guaranteed count are dropped, the
rest is verified bit by bit. A list gives a spanning forest of its links, not all pairs: the classes
are the same.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangescan.llm.common import Scratch, cut, discard, doc_frame, free_name, groups, ids_of, partitions, sliced, small, texts_of, worker_caches
from rangescan.llm.components import components
from rangescan.llm.similar_sets import grams_of, links_between

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Hashes whose bits are counted at a time, for very long texts.
_HASHES = 1 << 16
#: Fingerprints of a list that are compared all with all; longer lists look up every neighbour instead.
_DENSE = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over the word shingles of a text, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), _HASHES):
        bits += np.unpackbits(h[k : k + _HASHES].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in sliced(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([ids_of(batch), pa.array(fp)], ["doc_id", "fp"])

    return doc_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _near(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a list of distinct fingerprints that reach the count of equal bytes and pass the check."""
    if len(fps) <= _DENSE:
        i, j = np.triu_indices(len(fps), 1)
    else:
        free = np.bitwise_or.reduce(fps ^ fps[0])  # bits in which the list differs at all
        places = [np.uint64(1 << k) for k in range(64) if int(free) >> k & 1]
        order = np.argsort(fps)
        base, ii, jj = fps[order], [], []
        for n in range(1, max_bits + 1):
            for flips in combinations(places, n):
                other = fps ^ np.bitwise_or.reduce(np.array(flips, np.uint64))
                at = np.minimum(np.searchsorted(base, other), len(base) - 1)
                hit = np.flatnonzero(base[at] == other)
                ii.append(hit)
                jj.append(order[at[hit]])
        i, j = np.concatenate(ii), np.concatenate(jj)
        i, j = i[i < j], j[i < j]
    differ = fps[i] ^ fps[j]
    equal_bytes = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    good = (equal_bytes >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
    return i[good], j[good]


def _forest(reps: list[int], i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
    root = list(range(len(reps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            a.append(reps[x])
            b.append(reps[y])
    return a, b


def _links(batches, max_bits: int):
    for cols in groups(batches, 2):
        yield from _linked(cols, max_bits)


def _linked(cols: list[np.ndarray], max_bits: int):
    which, key, fps, reps = cols
    if not len(key):
        return
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])]))
    sizes = np.diff(np.append(new, len(key)))
    a, b = [], []
    for start, size in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        part = slice(start, start + size)
        x, y = _forest(reps[part].tolist(), *_near(fps[part].view(np.uint64), max_bits))
        a += x
        b += y
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): representatives of distinct fingerprints within ``max_bits``, a spanning forest for each list.

    ``distinct`` has rows (fp, rep), each fp once.
    """
    masks = [int(np.array([sum(255 << 8 * p for p in places)], np.uint64).view(np.int64)[0]) for places in combinations(range(8), 8 - max_bits)]
    postings = distinct.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("positions", "key")).select("positions", "key", "fp", "rep")
    n = partitions(distinct.sparkSession)
    return postings.repartition(n, "positions", "key").sortWithinPartitions("positions", "key", "fp").mapInArrow(lambda it: _links(it, max_bits), "a long, b long")


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    Null and empty texts have fingerprint 0, which links like any other. component_id is the smallest
    doc_id reachable over links of at most ``max_bits`` bits; rows with a null id keep their class (null
    if it has no id at all). Repeated rows stay repeated; an empty table gives an empty table.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-reps")
    tree = components(link_fingerprints(reps.where("rep is not null"), max_bits))
    classes = cut(reps.join(tree, reps.rep == tree.child, "left").select("fp", F.coalesce("parent", "rep").alias("component_id")), "fingerprint-classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


# Near duplicates by the similarity of their shingles ----------------------------------------------------
#
# Texts whose 5-word shingles have a Jaccard similarity of 0.8 differ in some 15 % of the bits of a SimHash
# of these shingles: more than one bit a byte, so no number of equal bytes is guaranteed at any length. But
# they differ in some 7 % of the bits of a SimHash of their distinct words. So first candidates come from 256
# bits over the distinct words, by the same index over byte positions, and are verified on the shingles. They
# give most of each class; what they leave between two classes is found exactly (similar_sets).

#: Bytes of the wide fingerprint; bits in which candidates may differ; bytes of a position set, the guaranteed equal ones.
WIDE_BYTES, WIDE_BITS = 32, 28
SET_BYTES = WIDE_BYTES - WIDE_BITS
#: Position sets; a pair meets if one of them lies within its equal bytes.
SETS = 64
#: Longer lists are gone through in windows of so many fingerprints that overlap by half.
LIST = 1024
_word_bits: dict[bytes, bytes] = {}
worker_caches.append(_word_bits)


def position_sets(count: int = SETS) -> list[tuple[int, ...]]:
    """Different sets of byte positions by a fixed rule: a seeded generator draws them."""
    rng, out = random.Random(SEED), []
    while len(out) < count:
        one = tuple(sorted(rng.sample(range(WIDE_BYTES), SET_BYTES)))
        if one not in out:
            out.append(one)
    return out


def wide_fingerprint(words: list[bytes]) -> np.ndarray:
    """SimHash of 256 bits over the distinct words, as 4 unsigned longs; zeros without words."""
    distinct = list(set(words))
    if len(_word_bits) > 50_000:
        _word_bits.clear()
    for w in distinct:
        if w not in _word_bits:
            _word_bits[w] = xxhash.xxh3_128_digest(w) + xxhash.xxh3_128_digest(w, 1)
    bits = np.zeros(8 * WIDE_BYTES, np.int64)
    for k in range(0, len(distinct), _HASHES):
        part = distinct[k : k + _HASHES]
        table = np.frombuffer(b"".join([_word_bits[w] for w in part]), np.uint8).reshape(len(part), WIDE_BYTES)
        bits += np.unpackbits(table, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(distinct), bitorder="little").view("<u8")


def _wide_rows(batches):
    for batch in sliced(batches):
        words = [t.lower().split() for t in texts_of(batch)]
        joined = [b" ".join(w) for w in words]
        keys = [pa.array(np.array([f(j) for j in joined], np.uint64).view(np.int64)) for f in (xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest)]
        wide = np.array([wide_fingerprint(w) for w in words], np.uint64).reshape(-1, 4).view(np.int64)
        yield pa.record_batch([ids_of(batch), *keys, *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(4))], ["doc_id", "k1", "k2", "f0", "f1", "f2", "f3"])


def _spanning_tree(fps: np.ndarray) -> list[tuple[int, int]]:
    """Minimum spanning tree by differing bits, edges above WIDE_BITS left out.

    Any two fingerprints within some number of bits are joined by tree edges of no more bits.
    """
    n, edges = len(fps), []
    far = np.full(n, 10_000)
    via = np.zeros(n, np.int64)
    at, left = 0, np.ones(n, bool)
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(fps ^ fps[at]).sum(axis=1, dtype=np.int64)
        closer = left & (d < far)
        far[closer], via[closer] = d[closer], at
        at = int(np.argmin(np.where(left, far, 20_000)))
        if far[at] <= WIDE_BITS:
            edges.append((int(via[at]), at))
    return edges


def _wide_links(batches):
    for which, key, f0, f1, f2, f3, reps in groups(batches, 2):
        fps = np.column_stack([f0, f1, f2, f3]).view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])]))
        sizes = np.diff(np.append(new, len(key)))
        two = new[sizes == 2]
        close = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1, dtype=np.int64) <= WIDE_BITS
        a, b = reps[two[close]].tolist(), reps[two[close] + 1].tolist()
        for start, size in zip(new[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = np.arange(start, start + size)
            if size > LIST:
                own = own[np.lexsort(fps[own].T)]
            for k in range(0, max(1, size - LIST // 2), LIST // 2):
                part = own[k : k + LIST]
                for x, y in _spanning_tree(fps[part]):
                    a.append(int(reps[part[x]]))
                    b.append(int(reps[part[y]]))
        yield pa.record_batch([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def _shingle_rows(batches, shingle: int):
    for batch in sliced(batches):
        yield pa.record_batch([ids_of(batch), pa.array([grams_of(t, shingle).view(np.int64) for t in texts_of(batch)], pa.list_(pa.int64()))], ["doc_id", "grams"])


def _similar(batches, similarity: float):
    for batch in batches:
        a, b, x, y = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "x", "y"))
        good = []
        for p, q in zip(x, y, strict=True):
            p, q = np.asarray(p.values), np.asarray(q.values)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= similarity * (len(p) + len(q) - both))
        yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def similar_classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row: classes over pairs whose word shingles have the Jaccard similarity.

    Texts with the same words, A-Z lower-cased, are one class; null and empty texts are such texts.
    component_id is the smallest doc_id of the class, null where it has none. Texts whose smallest id is the
    same are one. Repeated rows stay; an empty table gives an empty table; other columns are ignored.

    SimHash candidates are verified and give classes; then ``links_between`` finds every pair that is still
    between two classes.
    """
    frame, n = doc_frame(docs, id_col, text_col), partitions(docs.sparkSession)
    rows = cut(frame.mapInArrow(_wide_rows, "doc_id long, k1 long, k2 long, f0 long, f1 long, f2 long, f3 long"), "wide-fingerprints")
    reps = cut(rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), *(F.min(f"f{k}").alias(f"f{k}") for k in range(4))), "wide-reps")
    byte = lambda p: F.shiftrightunsigned(f"f{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255))
    keys = F.array(*[sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(places) if i), byte(places[0])) for places in position_sets()])
    postings = reps.where("rep is not null").select("f0", "f1", "f2", "f3", "rep", F.posexplode(keys).alias("positions", "key")).select("positions", "key", "f0", "f1", "f2", "f3", "rep")
    found = postings.repartition(n, "positions", "key").sortWithinPartitions("positions", "key", "rep").mapInArrow(_wide_links, "a long, b long")
    scratch = Scratch()
    pairs = scratch.cut(found.where("a <> b").distinct(), "wide-pairs")
    wanted = scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "wide-wanted")
    grams = frame.join(small(wanted), "doc_id", "left_semi").mapInArrow(lambda b: _shingle_rows(b, shingle), "doc_id long, grams array<long>").groupBy("doc_id").agg(F.first("grams").alias("grams"))
    grams = scratch.cut(grams, "wide-grams")
    both = pairs.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    links = cut(both.select("a", "b", "x", "y").mapInArrow(lambda b: _similar(b, similarity), "a long, b long"), "wide-links")
    scratch.discard()
    tree = components(links)
    members = reps.where("rep is not null").join(tree, reps.rep == tree.child, "left").select("rep", F.coalesce("parent", "rep").alias("class")).distinct()
    members = cut(members.join(members.groupBy("class").agg(F.count("*").alias("size")), "class"), "wide-members")
    texts = cut(frame.join(small(members), frame.doc_id == members.rep).select("rep", "class", "size", "text"), "wide-texts")
    more = links_between(texts, shingle, similarity)
    discard(texts, members)
    tree = components(links.union(more))
    classes = cut(reps.join(tree, reps.rep == tree.child, "left").select("k1", "k2", F.coalesce("parent", "rep").alias("component_id")), "wide-classes")
    return rows.join(classes, ["k1", "k2"]).select("doc_id", "component_id")


def keep_one_per_class(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each class of similar texts.

    Rows that repeat that id stay together; null and empty texts are one class; rows without an id stay only
    where their whole class has none. Columns may have any names; an empty table stays empty.
    """
    name = free_name("drop", docs.columns)
    stays = similar_classes(docs, shingle, similarity, id_col, text_col).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = cut(stays.where(~F.col("stays")).select(F.col("doc_id").alias(name)), "near-copies")  # fewer than those that stay, and texts need not move
    return docs.join(small(gone), F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(name)), "left_anti")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
