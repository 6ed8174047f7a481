import pytest
from pyspark.sql import functions as F

from rangescan.operators.labels import label_image
from rangescan.plans.views import SENSOR, px
from rangescan.streaming.pipeline import Latest, Pipeline, SenderType, Stats, nearest_asof, replay, sync_nearest


def test_sinks_run_in_order_and_can_be_removed(spark):
    seen = []
    p = Pipeline()
    a = p.add_sink(lambda df, b: seen.append(("a", df.count())))
    second = lambda df, b: seen.append(("b", df.count()))
    p.add_sink(second)
    p.share(spark.range(3))
    assert seen == [("a", 3), ("b", 3)] and p.sink_count == 2
    assert p.remove_sink(a) and p.remove_sink(second) and not p.remove_sink(99) and p.sink_count == 0
    assert p.kind is SenderType.STREAMER and Pipeline().id > p.id
    with pytest.raises(ValueError):
        Pipeline(kind=None)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    image = px(spark, sf_dir)
    for frame in (0, 1):
        image.where(F.col("frame_id") == frame).coalesce(1).write.parquet(str(tmp_path / "frames" / f"f{frame}"))
    stats = Stats()
    spark.streams.addListener(stats)
    out, told = [], []
    p = Pipeline(lambda df: label_image(df, SENSOR, "angle", 0.17))
    p.add_sink(lambda df, b: out.extend(map(tuple, df.collect())))
    p.add_sink(Latest("objects", told.append))
    q = p.start(replay(spark, str(tmp_path / "frames" / "*"), image.schema), str(tmp_path / "check"), once=True)
    q.awaitTermination(120)
    assert sorted(out) == sorted(map(tuple, label_image(image, SENSOR, "angle", 0.17).collect()))
    assert len(told) == 2 and spark.table("global_temp.objects").select("frame_id").distinct().count() == 1
    spark.streams.removeListener(stats)


def rows(spark, values, name):
    return spark.createDataFrame([(k, s, n) for k, s, n in values], f"key long, s double, {name} long").selectExpr("key", f"timestamp_micros(cast(s * 1000000 as bigint)) as ts", name)


def test_nearest_in_time(spark):
    frames = rows(spark, [(1, 10.0, 0), (1, 20.0, 1), (1, 99.0, 2), (2, 10.0, 3)], "frame_id")
    odom = rows(spark, [(1, 9.0, 100), (1, 11.0, 101), (1, 20.5, 102), (2, 13.5, 103)], "id")
    got = {r.frame_id: r.odom_id for r in sync_nearest(frames, odom, 3.0, ["key"]).collect()}
    assert got == {0: 100, 1: 102}
    last = {r.frame_id: r.odom_id for r in nearest_asof(frames, odom, ["key"]).collect()}
    assert last == {0: 100, 1: 101, 2: 102, 3: None}


def test_nearest_as_a_stream(spark, tmp_path):
    frames, odom = rows(spark, [(1, 10.0, 0), (1, 20.0, 1)], "frame_id"), rows(spark, [(1, 9.0, 100), (1, 20.5, 102)], "id")
    for name, df in (("f", frames), ("o", odom)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    # a late pair moves the watermark on
    rows(spark, [(1, 900.0, 9)], "frame_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    rows(spark, [(1, 900.0, 109)], "id").coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    joined = sync_nearest(replay(spark, str(tmp_path / "f"), frames.schema, 9), replay(spark, str(tmp_path / "o"), odom.schema, 9), 3.0, ["key"], watermark="5 seconds")
    q = joined.writeStream.format("memory").queryName("synced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.frame_id, r.odom_id) for r in spark.table("synced").collect()} >= {(0, 100), (1, 102)}
