"""Frames as a stream: sinks that get every batch in turn, nearest-time pairing, replay."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

_ids = itertools.count()


class SenderType(Enum):
    STORER = "storer"
    STREAMER = "streamer"


class Pipeline:
    """Transforms each micro-batch and hands the result to all sinks, one after another in order of their ids."""

    def __init__(self, transform: Callable[[DataFrame], DataFrame] = lambda df: df, kind: SenderType = SenderType.STREAMER):
        if not isinstance(kind, SenderType):
            raise ValueError("a pipeline is a storer or a streamer")
        self.id, self.kind, self.transform = next(_ids), kind, transform
        self.sinks: dict[int, Callable[[DataFrame, int], None]] = {}

    def add_sink(self, sink: Callable[[DataFrame, int], None]) -> int:
        """The new sink's id; it gets (rows, batch id)."""
        key = next(_ids)
        self.sinks[key] = sink
        return key

    def remove_sink(self, sink: int | Callable) -> bool:
        """By id or by the sink itself; False if it isn't there."""
        keys = [k for k, s in self.sinks.items() if k == sink or s is sink]
        for k in keys:
            del self.sinks[k]
        return bool(keys)

    @property
    def sink_count(self) -> int:
        return len(self.sinks)

    def share(self, rows: DataFrame, batch: int = -1) -> None:
        """Give rows to every sink; they are computed once if there are several."""
        out = self.transform(rows)
        many = len(self.sinks) > 1
        if many:
            out = out.persist()
        try:
            for key in sorted(self.sinks):
                self.sinks[key](out, batch)
        finally:
            if many:
                out.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None, once: bool = False) -> StreamingQuery:
        """``interval``: pace of the batches, such as "100 milliseconds"; ``once``: what is there, then stop."""
        writer = stream.writeStream.foreachBatch(self.share).option("checkpointLocation", checkpoint).queryName(f"pipeline-{self.id}-{next(_ids)}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval) if interval else writer).start()


class Latest:
    """Sink that keeps the newest rows in a temporary view and tells a listener."""

    def __init__(self, view: str, on_update: Callable[[int], None] | None = None):
        self.view, self.on_update = view, on_update

    def __call__(self, rows: DataFrame, batch: int) -> None:
        kept = rows.sparkSession.createDataFrame(rows.toArrow())  # one frame's objects: bounded by the sensor
        kept.createOrReplaceGlobalTempView(self.view)
        if self.on_update:
            self.on_update(batch)


class Stats(StreamingQueryListener):
    """Collects rows and durations of every batch."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": dict(p.durationMs)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def replay(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A folder of Parquet frames as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def replay_files(spark: SparkSession, path: str, suffix: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of scan files as a stream of (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_a_batch).load(path)


def _micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


def _bucketed(rows: DataFrame, time: str, width: float, spread: bool) -> DataFrame:
    at = F.floor(_micros(time) / F.lit(int(width * 1e6))).cast("long")
    return rows.withColumn("_slot", F.explode(F.array(at - 1, at, at + 1)) if spread else at)


def sync_nearest(frames: DataFrame, odom: DataFrame, max_dt: float, key: list[str] | None = None, time: str = "ts", frame_id: str = "frame_id", watermark: str | None = None) -> DataFrame:
    """Each frame with the odometry row nearest in time, at most ``max_dt`` seconds off; the earlier of equals.

    Time is cut into slots as wide as ``max_dt`` and rows are joined by slot, the odometry standing in its
    own and both adjacent ones: an equi-join that keeps a busy key from becoming one task. Frames
    without a partner are left out. For streams give a ``watermark``: the join then drops its state, and
    the nearest is taken by an aggregation that closes with the watermark.
    """
    key = key or []
    if watermark:
        frames, odom = frames.withWatermark(time, watermark), odom.withWatermark(time, watermark)
    a = _bucketed(frames, time, max_dt, spread=False)
    names = [c for c in odom.columns if c not in key and c != time]
    b = _bucketed(odom.select(*key, F.col(time).alias("odom_ts"), *(F.col(c).alias(f"odom_{c}") for c in names)), "odom_ts", max_dt, spread=True)
    dt = F.abs(_micros(time) - _micros("odom_ts"))
    # stated as a range for the state of a streaming join, too
    span = F.expr(f"INTERVAL {int(max_dt * 1e6)} MICROSECONDS")
    both = a.join(b, [*key, "_slot"]).where((F.col("odom_ts") >= F.col(time) - span) & (F.col("odom_ts") <= F.col(time) + span))
    rest = [c for c in frames.columns if c not in (*key, time, frame_id)]
    best = F.min_by(F.struct("odom_ts", *(f"odom_{c}" for c in names)), F.struct(dt, "odom_ts", *(f"odom_{c}" for c in names)))
    out = both.groupBy(*key, frame_id, time).agg(*(F.first(c).alias(c) for c in rest), best.alias("o"))
    return out.select(*key, frame_id, time, *rest, "o.*")


def nearest_asof(frames: DataFrame, odom: DataFrame, key: list[str], time: str = "ts") -> DataFrame:
    """Each frame with the last odometry row at or before it, by one sort of both by key and time."""
    names = [c for c in odom.columns if c not in (*key, time)]
    a = frames.withColumns({"_kind": F.lit(1), "_o": F.lit(None).cast(odom.select(F.struct(time, *names).alias("s")).schema["s"].dataType)})
    b = odom.select(*key, time, F.lit(0).alias("_kind"), F.struct(time, *names).alias("_o"))
    window = Window.partitionBy(*key).orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_o", ignorenulls=True).over(window))
    return both.where("_kind = 1").select(*frames.columns, *(F.col(f"_last.{c}").alias(f"odom_{c}") for c in (time, *names)))
