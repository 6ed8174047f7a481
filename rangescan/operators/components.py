"""Connected components inside the JVM: neighbours are merged until no edge is left.

A round keeps the edges between merged vertices alone, so rounds shrink and their number grows with the
logarithm of a component, not with its length. Every round is written to a shared folder and read back:
that ends the lineage and survives lost executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset and there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "rangescan-shared")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` through Parquet in the shared folder."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def min_labels(vertices: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(frame_id, id, root): the smallest id of the component of every vertex (frame_id, id); edges are (frame_id, src, dst)."""
    edges = edges.where("src <> dst").select("frame_id", "src", "dst")
    merged = []
    for seed in range(max_rounds):
        if edges.isEmpty():
            break
        # each vertex takes the name of the first of itself and its neighbours, in an order drawn anew every round
        turn = lambda c: F.xxhash64(F.col(c), F.lit(seed))  # noqa: E731, B023
        both = edges.union(edges.select("frame_id", F.col("dst"), F.col("src")))
        first = both.groupBy("frame_id", F.col("src").alias("id")).agg(F.min_by("dst", turn("dst")).alias("name"))
        names = written(first.select("frame_id", "id", F.when(turn("id") < turn("name"), F.col("id")).otherwise(F.col("name")).alias("name")), "grid-names")
        merged.append(names)
        # edges between vertices of one name are done; the others go on, each once
        src, dst = (names.select("frame_id", F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
        ends = edges.join(src, ["frame_id", "src"]).join(dst, ["frame_id", "dst"]).where("src_name <> dst_name")
        edges = written(ends.select("frame_id", F.least("src_name", "dst_name").alias("src"), F.greatest("src_name", "dst_name").alias("dst")).distinct(), "grid-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not merged:
        return vertices.select("frame_id", "id", F.col("id").alias("root"))
    last = merged.pop()
    while merged:  # names of names, from the last and smallest round to the first
        final = last.select("frame_id", F.col("id").alias("name"), F.col("name").alias("final"))
        last = merged.pop().join(final, ["frame_id", "name"], "left").select("frame_id", "id", F.coalesce("final", "name").alias("name"))
    named = written(last, "grid-names")
    low = named.groupBy("frame_id", "name").agg(F.min("id").alias("root"))
    root = named.join(low, ["frame_id", "name"]).select("frame_id", "id", "root")
    return vertices.select("frame_id", "id").join(root, ["frame_id", "id"], "left").select("frame_id", "id", F.coalesce("root", "id").alias("root"))
