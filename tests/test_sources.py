import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangescan.plans.sensor import Sensor
from rangescan.sources import scans, sinks


def png(image, filters):
    rows = []
    data = image.astype(">u2").tobytes()
    width = image.shape[1] * 2
    lines = [data[k * width : (k + 1) * width] for k in range(len(image))]
    for k, line in enumerate(lines):
        above = lines[k - 1] if k else bytes(width)
        kind, out = filters[k % len(filters)], bytearray()
        for i, v in enumerate(line):
            a, b, c = (line[i - 2] if i > 1 else 0), above[i], (above[i - 2] if i > 1 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        rows.append(bytes([kind]) + bytes(out))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_filters():
    image = np.random.default_rng(0).integers(0, 65536, (10, 7))
    assert (scans.decode_png16(png(image, [0, 1, 2, 3, 4])) == image).all()
    with pytest.raises(ValueError):
        scans.decode_png16(b"no image")


def test_numeric_order(spark, tmp_path):
    for name in ("a_10.bin", "a_9.bin", "b.bin", "a_1.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "a_2.bin").write_bytes(b"")  # holds no scan
    got = [r.path.rpartition("/")[2] for r in scans.list_scans(spark, str(tmp_path), suffix=".bin").orderBy("frame_id").collect()]
    assert got.index("a_9.bin") < got.index("a_10.bin") and len(got) == 3
    assert scans.list_scans(spark, str(tmp_path), "a_", ".bin").count() == 2
    assert scans.list_scans(spark, str(tmp_path / "none")).count() == 0
    numbers = spark.createDataFrame([("x/12/y7.bin",), ("none",)], "p string").select(scans.path_number(F.col("p")).alias("n")).collect()
    assert [r.n for r in numbers] == [7, 0]


def test_binary_scans(spark, tmp_path):
    data = np.array([[1, 2, 3, 0.5], [4, 5, 6, 0.1]], "<f4").tobytes() + b"rest"
    (tmp_path / "0.bin").write_bytes(data)
    (tmp_path / "1.bin").write_bytes(b"few")
    rows = scans.read_bin(spark, str(tmp_path)).orderBy("frame_id", "point_idx").collect()
    assert [(r.frame_id, r.x, r.z, r.ring) for r in rows] == [(0, 1.0, 3.0, 0), (0, 4.0, 6.0, 0)]
    assert scans.read_bin(spark, str(tmp_path), compat=True).count() == 4


def test_text_scans(spark, tmp_path):
    (tmp_path / "5.txt").write_text("1 2 3 0\n1 2 3 0 \nbad\n4 5 6 1\n")
    assert [(r.x, r.y) for r in scans.read_txt(spark, str(tmp_path)).orderBy("point_idx").collect()] == [(1.0, 2.0), (4.0, 5.0)]


def test_depth_images(spark, tmp_path):
    (tmp_path / "1.png").write_bytes(png(np.array([[500, 0], [1000, 250]]), [0]))
    pixels = scans.read_depth_png(spark, str(tmp_path), corrections=(0.5, 0.25))
    assert {(r.row, r.col): r.depth for r in pixels.collect()} == {(0, 0): 0.5, (0, 1): 0.0, (1, 0): 1.75, (1, 1): 0.25}
    sensor = Sensor((0.0, 0.1), (0.0, 1.0), 2.0)
    assert scans.read_scans(spark, str(tmp_path), "png", sensor).count() == 3
    with pytest.raises(ValueError):
        scans.read_scans(spark, str(tmp_path), "exr")


def test_corrections_have_one_value_a_row():
    assert len(scans.CORRECTIONS_64) == 64


def test_pcd_round_trip(spark, tmp_path):
    rows = [(f, lab, 10 * lab + k, float(k), 0.5, -1.0, 0) for f in (0, 1) for lab in (1, 2) for k in range(3)]
    df = spark.createDataFrame(rows, "frame_id long, label int, point_idx long, x float, y float, z float, ring int")
    out = sinks.save_pcd(df, str(tmp_path / "out"), every=2).collect()
    assert len(out) == 2 and all(r.n_points == 3 for r in out)
    back = scans.read_pcd(spark, str(tmp_path / "out" / "000000"))
    assert back.count() == 6 and {r.ring for r in back.collect()} == {1, 2}
    (tmp_path / "a.pcd").write_text("# c\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS 2\nDATA ascii\n1 2 3\n4 5 6\n")
    assert [r.z for r in scans.read_pcd(spark, str(tmp_path), "a.pcd").orderBy("point_idx").collect()] == [3.0, 6.0]


def test_messages(spark):
    point = np.dtype({"names": ["x", "y", "z", "ring"], "formats": ["<f4", "<f4", "<f4", "<u2"], "offsets": [0, 4, 8, 16], "itemsize": 20})
    data = np.zeros(2, point)
    data["x"], data["ring"] = [1, 2], [3, 4]
    got = scans.decode_messages(spark.createDataFrame([(7, bytearray(data.tobytes()))], "frame_id long, data binary"), (0, 4, 8, 16), 20).orderBy("point_idx").collect()
    assert [(r.frame_id, r.x, r.ring) for r in got] == [(7, 1.0, 3), (7, 2.0, 4)]
    turn = spark.range(1).select(scans.odometry_pose(*(F.lit(v) for v in (0.0, 0.0, 0.5**0.5, 0.5**0.5, 1.0, 2.0, 3.0))).alias("p")).first().p
    assert np.array(turn).reshape(4, 4) == pytest.approx(np.array([[0, -1, 0, 1], [1, 0, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f, 1, f, 0.0, 0.0, 0.0, 2) for f in range(4)], "frame_id long, label int, point_idx long, x float, y float, z float, ring int")
    sinks.save_clusters(df, str(tmp_path / "c"), every=2)
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["frame=000000", "frame=000002"]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.save_clusters(df, str(tmp_path / "c"))
    sinks.save_points(df, str(tmp_path / "p"))
    sinks.save_pixels(df.selectExpr("frame_id", "label as row", "ring as col", "x as depth"), str(tmp_path / "d"))
    assert [r.frame_id for r in sinks.latest(df).collect()] == [3]
    assert sinks.from_labelled(sinks.to_labelled(df)).first().ring == 2
    assert spark.range(1).select(sinks.padded(F.lit(12345678)).alias("n")).first().n == "12345678"


def test_scans_are_written_and_read_back(spark, tmp_path):
    """Every kind of file, and images with holes; a kind that can't be written is refused."""
    rows = [(f, k, float(k), k / 3, -1.5 * f, k) for f in (0, 7, 12) for k in range(5)]
    points = spark.createDataFrame(rows, "frame_id long, point_idx long, x double, y double, z double, ring int")
    for kind in ("bin", "txt", "pcd"):
        folder = str(tmp_path / kind)
        assert sinks.save_scans(points, folder, kind).count() == 3
        got = scans.read_scans(spark, folder, kind).withColumn("frame_id", scans.path_number(F.col("path"))).orderBy("frame_id", "point_idx").collect()
        assert [(r.frame_id, r.point_idx) for r in got] == [(f, k) for f, k, *_ in rows]
        assert np.allclose([(r.x, r.y, r.z) for r in got], [r[2:5] for r in rows]) and [r.ring for r in got] == [k if kind == "pcd" else 0 for *_, k in rows]
    with pytest.raises(ValueError):
        sinks.save_scans(points, str(tmp_path), "exr")
    pixels = spark.createDataFrame([(3, 1, 2, 7.5), (3, 0, 0, 0.25)], "frame_id long, row int, col int, depth double")
    sinks.save_images(pixels, str(tmp_path / "png"), 2, 4, 500.0).count()
    image = {(r.row, r.col): r.depth for r in scans.read_depth_png(spark, str(tmp_path / "png")).collect()}
    assert len(image) == 8 and image[1, 2] == 7.5 and image[0, 0] == 0.25 and image[1, 1] == 0
