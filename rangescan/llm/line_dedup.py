"""Repeated line runs by a suffix array over line identifiers, built by distributed prefix doubling.

Every line is a symbol, every document a sequence; a run never crosses the end of a document. Suffixes
are first sorted by their first line; when they are ranked by 2^t lines, sorting by (rank, rank of the
suffix 2^t lines on) ranks them by 2^(t+1). Suffixes with equal ranks form an interval of common prefix
of at least that many lines, its first member in corpus order is the copy that stays. A suffix that is
alone in its interval is finished, and so, one round later, is any whose continuation is: the table
shrinks to what is repeated.

A repeated run with enough words is the union of the shortest runs with enough words that begin at a line
of it and the shortest that end at one. Two ranks of 2^t lines that overlap name a run of any length
from 2^t on, so these shortest runs are looked up, whatever their length, and the doubling ends at the
longest of them.

A round sorts by range, with the place in the corpus as the last key, so one very common line spreads
over many tasks; a task numbers its own rows, and only one summary a task goes to the driver, which
chains intervals that reach across tasks.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangescan.llm.common import Scratch, bounded_batches, cut, free_name, partitions, sliced, texts_of

#: Words that a repeated run needs for its later copies to be deleted.
MIN_WORDS = 10
_PLACE = ["doc_id", "d", "line"]
#: Lines of a run fit into so many bits.
_LENGTH_BITS = 31
_LENGTHS = 1 << _LENGTH_BITS


def _shortest(words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the length of the shortest run from it that has the words, 0 if none, and of that up to it, 0 if none or if it is one of the first."""
    n = len(words)
    sizes, at = np.concatenate([[0], np.cumsum(words)]), np.arange(n)
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + min_words), at + 1)
    ahead = np.where(ends <= n, ends - at, 0)
    starts = np.minimum(np.searchsorted(sizes, sizes[1:] - min_words, side="right") - 1, at)
    back = np.where(starts >= 0, at - starts + 1, 0)
    return ahead, np.where(ahead[starts] == back, 0, back)


def _lines(batches, min_words: int):
    for batch in sliced(batches):
        docs, marks = batch.column(0), batch.column(1)
        which, line, h1, h2, ahead, back = [], [], [], [], [], []
        for k, text in enumerate(texts_of(batch)):
            parts = text.split(b"\n")
            for out, lengths in zip((ahead, back), _shortest([len(p.split()) for p in parts], min_words), strict=True):
                out += lengths.tolist()
            for n, part in enumerate(parts):
                h = xxhash.xxh3_128_digest(part)
                which.append(k)
                line.append(n)
                h1.append(h[:8])
                h2.append(h[8:])
        take = pa.array(which, pa.int64())
        longs = [pa.array(np.frombuffer(b"".join(h), "<i8")) for h in (h1, h2)]
        yield pa.record_batch([docs.take(take), marks.take(take), pa.array(line, pa.int64()), *longs, pa.array(ahead, pa.int64()), pa.array(back, pa.int64())], ["doc_id", "d", "line", "h1", "h2", "ahead", "back"])


def _numbered(batches):
    """Rows sorted by (a, b, place): their number in the task and that of the first row with equal keys.

    ``tied``: another row of the task has equal keys; ``last``: the task's last row. A final row carries
    the summary of the task in ``note``.
    """
    part = TaskContext.get().partitionId()
    at = tie = 0
    prev, first, held = None, None, None

    def out(cols, tied, last, note=None):
        n = len(tied)
        return pa.record_batch([*cols, pa.array(tied, pa.bool_()), pa.array([last] * n, pa.bool_()), pa.array([part] * n, pa.int64()), pa.array([note] * n, pa.string())], ["doc_id", "d", "line", "idx", "tie", "tied", "last", "part", "note"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = np.asarray(batch.column(3)), np.asarray(batch.column(4))
        same = np.concatenate([[prev == (int(a[0]), int(b[0]))], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        idx = np.arange(at, at + n)
        ties = np.maximum(np.maximum.accumulate(np.where(same, -1, idx)), tie)
        first = first or (int(a[0]), int(b[0]))
        if held is not None:
            yield out(held[0], [bool(held[1] or same[0])], False)
        tied = same.copy()
        tied[:-1] |= same[1:]
        cols = [*batch.columns[:3], pa.array(idx), pa.array(ties)]
        if n > 1:
            yield out([c.slice(0, n - 1) for c in cols], tied[:-1].tolist(), False)
        held = ([c.slice(n - 1) for c in cols], bool(same[-1]))
        prev, at, tie = (int(a[-1]), int(b[-1])), at + n, int(ties[-1])
    if held is not None:
        yield out(held[0], [held[1]], True)
        yield out([pa.nulls(1, c.type) for c in held[0]], [False], False, json.dumps({"n": at, "first": first, "end": prev, "tie": tie}))


def _rank(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rank rows (doc_id, d, line, a, b) by (a, b).

    Returns (doc_id, d, line, rank, first, tied): rank is the place of the first row of the interval of
    equal keys; ``first``: this row is that one, the first in corpus order; ``tied``: there are others.
    """
    spark = rows.sparkSession
    ordered = rows.select(*_PLACE, "a", "b").repartitionByRange(partitions(spark), "a", "b", *_PLACE).sortWithinPartitions("a", "b", *_PLACE)
    done = scratch.cut(ordered.mapInArrow(_numbered, "doc_id long, d long, line long, idx long, tie long, tied boolean, last boolean, part long, note string"), "line-ranks")
    parts = [(r.part, json.loads(r.note)) for r in done.where("note is not null").select("part", "note").orderBy("part").collect()]  # one for each task
    fix, base, end, open_tie = [], 0, None, 0
    for k, (part, x) in enumerate(parts):
        goes_on = k + 1 < len(parts) and parts[k + 1][1]["first"] == x["end"]
        fix.append((part, base, open_tie if x["first"] == end else base, x["first"] == end, goes_on))
        open_tie = base + x["tie"] if x["tie"] else fix[-1][2]
        end, base = x["end"], base + x["n"]
    frame = spark.createDataFrame(fix, "part long, base long, tie0 long, joined boolean, goes_on boolean")
    rank = F.when(F.col("tie") == 0, F.col("tie0")).otherwise(F.col("base") + F.col("tie"))
    tied = F.col("tied") | (F.col("last") & F.col("goes_on")) | ((F.col("tie") == 0) & F.col("joined"))
    return done.where("note is null").join(F.broadcast(frame), "part").select(*_PLACE, rank.alias("rank"), (F.col("base") + F.col("idx") == rank).alias("first"), tied.alias("tied"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, d, line, length): line runs that stand earlier in the corpus too, together all lines of those with ``min_words`` words.

    ``docs`` has (doc_id, d, text); the corpus order is (doc_id, d, line), null ids first. Rows with equal
    doc_id and d are one document. ``scratch`` gets the tables that the result is read from.
    """
    scratch = scratch or Scratch()
    lines = docs.select("doc_id", "d", "text").mapInArrow(lambda b: _lines(b, min_words), "doc_id long, d long, line long, h1 long, h2 long, ahead long, back long")
    common = scratch.cut(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "common-lines")
    found = lines.join(common, ["h1", "h2"])
    # rows that repeat id and text count once; without any, the join keeps its freedom to split a very common line
    if not docs.groupBy("doc_id", "d").count().where("count > 1").isEmpty():
        found = found.distinct()
    found = scratch.cut(found, "found-lines")
    wanted = found.where("ahead > 0").select(*_PLACE, F.col("ahead").alias("length")).union(found.where("back > 0").select("doc_id", "d", F.col("line") - F.col("back") + 1, "back"))
    longest = wanted.agg(F.max("length")).first()[0] or 0
    ranks = _rank(found.select(*_PLACE, F.col("h1").alias("a"), F.col("h2").alias("b")), scratch)
    levels, length = [], 1
    while True:
        tied = ranks.where("tied").select(*_PLACE, "rank")
        runs = wanted.where((F.col("length") >= length) & (F.col("length") < 2 * length))
        runs = _at(_at(runs, tied, F.col("line"), "a"), tied, F.col("line") + F.col("length") - length, "b")
        # the length goes with the key and, as a place may begin several runs, with the line
        keyed = runs.select("doc_id", "d", (F.col("line") * _LENGTHS + F.col("length")).alias("line"), (F.col("a") * length + F.col("length") - length).alias("a"), "b")
        levels.append(_rank(keyed, scratch).where("not first").select("doc_id", "d", F.shiftright("line", _LENGTH_BITS).alias("line"), F.col("line").bitwiseAND(F.lit(_LENGTHS - 1)).alias("length")))
        if 2 * length > longest or tied.isEmpty():
            break
        pairs = _at(tied.withColumnRenamed("rank", "a"), tied, F.col("line") + length, "b")
        ranks = _rank(pairs.select(*_PLACE, "a", "b"), scratch)
        length *= 2
    return _union(levels).groupBy(*_PLACE).agg(F.max("length").alias("length"))


def _at(rows: DataFrame, ranks: DataFrame, line: Column, name: str) -> DataFrame:
    """``rows`` with the rank at another line of their document; those without one go."""
    on = ranks.select(F.col("doc_id").alias("_doc"), F.col("d").alias("_d"), F.col("line").alias("_line"), F.col("rank").alias(name))
    return rows.join(on, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("d") == F.col("_d")) & (line == F.col("_line"))).drop("_doc", "_d", "_line")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _without(text: bytes, starts: list[int], lengths: list[int], min_words: int) -> tuple[bytes, int, int]:
    """The text without its later copies, its lines, and how many of them went."""
    parts = text.split(b"\n")
    sizes = np.concatenate([[0], np.cumsum([len(p.split()) for p in parts])])
    gone = np.zeros(len(parts) + 1, np.int64)
    for a, n in zip(starts, lengths, strict=True):
        if sizes[a + n] - sizes[a] >= min_words:
            gone[a] += 1
            gone[a + n] -= 1
    out = np.cumsum(gone[:-1]) > 0
    return b"\n".join(p for p, g in zip(parts, out, strict=True) if not g), len(parts), int(out.sum())


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted, and columns _lines and _deleted (see ``count_columns``).

    Lines are parted by line feeds. A line goes if it lies in a run of any number of lines with at least
    ``min_words`` words that also starts at an earlier place of the corpus order (id, then text digest,
    then line). The first copy stays, copies within one document included. Null texts stay null with one
    line and none deleted; rows with equal id and text are one document and get the same result; a text
    that is a later copy as a whole becomes empty. An empty table gives an empty table; other columns may
    have any names.
    """
    bounded_batches(docs.sparkSession)
    names, width = docs.columns, len(docs.columns)
    key, digest, run_key, run_digest, starts, lengths = (free_name(x, names) for x in ("doc_key", "doc_digest", "run_key", "run_digest", "run_starts", "run_lengths"))
    doc, d, at = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), docs.columns.index(text_col)
    keyed = docs.select("*", doc.alias(key), d.alias(digest))
    runs = repeated_runs(docs.select(doc.alias("doc_id"), d.alias("d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), min_words, scratch := Scratch())
    runs = cut(runs.groupBy("doc_id", "d").agg(F.collect_list("line").alias("starts"), F.collect_list("length").alias("lengths")), "line-runs")
    scratch.discard()
    runs = runs.select(F.col("doc_id").alias(run_key), F.col("d").alias(run_digest), F.col("starts").alias(starts), F.col("lengths").alias(lengths))
    joined = keyed.join(runs, F.col(key).eqNullSafe(F.col(run_key)) & (F.col(digest) == F.col(run_digest)), "left").select(*[F.col(f"`{c}`") for c in names], starts, lengths)
    lines_col, deleted_col = count_columns(names)

    def run(batches):
        for batch in sliced(batches, text_col):
            old = batch.column(at).cast(pa.binary()).to_pylist()
            new, lines, gone = [], [], []
            for text, starts, lengths in zip(old, batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True):
                t, n, g = _without(text or b"", starts or [], lengths or [], min_words)
                new.append(None if text is None else t)
                lines.append(n)
                gone.append(g)
            kind = batch.schema.field(at).type
            cols = [pa.array(new, pa.binary()).cast(kind) if k == at else batch.column(k) for k in range(width)]
            yield pa.record_batch([*cols, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*names, lines_col, deleted_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(lines_col, T.LongType()), T.StructField(deleted_col, T.LongType())])
    return joined.mapInArrow(run, schema)


def count_columns(names: list[str]) -> tuple[str, str]:
    """Names of the columns with a document's lines and deleted lines: underscores are added until no other column has them."""
    return free_name("_lines", names), free_name("_deleted", names)


def line_report(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_deleted, text_sha256 of what stays) for every row; null texts have one line, and an empty text's digest."""
    rows = deduplicate_lines(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), min_words)
    return rows.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def keep_first_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies deleted; rows of which nothing stays go.

    Columns stay as they are and may have any names; null texts stay null; rows that repeat have one fate; an
    empty table stays empty.
    """
    lines, deleted = count_columns(docs.columns)
    rows = deduplicate_lines(docs, min_words, id_col, text_col)
    return rows.where(F.col(deleted) < F.col(lines)).drop(lines, deleted)

