"""Range images, points and readings derived from the driver's tables, which hold no scans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangescan.operators.project import unproject
from rangescan.plans.sensor import Sensor

ROWS, COLS = 16, 90
#: 16 rows 2 degrees apart, 90 columns 4 degrees apart: a full turn, so columns wrap.
SENSOR = Sensor(tuple(math.radians(15 - 2 * r) for r in range(ROWS)), tuple(math.radians(-180 + 4 * c) for c in range(COLS)), 2 * math.pi)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range images (frame_id, row, col, depth, n_points) from lineitem."""
    keys = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 750").alias("frame_id"), F.expr("cast(l_suppkey % 16 as int)").alias("row"), F.expr("cast(l_partkey % 90 as int)").alias("col"), "l_quantity"
    )
    return keys.groupBy("frame_id", "row", "col").agg(F.max("l_quantity").alias("depth"), F.count("*").alias("n_points"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ``px``."""
    return unproject(px(spark, sf_dir), SENSOR)


def emb3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from embeddings: the frame is the label, the place the first three values times ten."""
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("point_idx"), *((F.get(v, F.lit(k)).cast("double") * 10).alias(c) for k, c in enumerate("xyz")), F.pmod(F.col("vec_id"), F.lit(ROWS)).cast("int").alias("ring"))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings (key, ts, value, kind) from events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_type").alias("kind"), "event_id")
