"""Readers of scan files. Spark lists the files, executors decode them; a frame is one file.

All readers give ``frame_id`` (place of the file in numeric path order) and ``path``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangescan.plans.sensor import Sensor

POINTS = "frame_id long, path string, point_idx long, x float, y float, z float, ring int"
PIXELS = "frame_id long, path string, row int, col int, depth float"
#: Pixel units a metre in 16-bit depth images.
PNG_SCALE = 500.0
#: Depth errors in metres of the 64 rows of the sensor that recorded the depth images.
CORRECTIONS_64 = (
    0.02587499999999987, -0.0061250000000001581, 0.031874999999999876, 0.001874999999999849,
    0.029874999999999874, -0.1961250000000001, 0.049874999999999892, -0.034125000000000183,
    0.0038749999999998508, 0.0058749999999998526, 0.035874999999999879, -0.064124999999999988,
    0.035874999999999879, 0.001874999999999849, -0.024125000000000174, -0.062124999999999986,
    0.039874999999999883, -0.020125000000000171, 0.075874999999999915, -0.024125000000000174,
    -0.0041250000000001563, -0.058124999999999982, -0.032125000000000181, -0.058124999999999982,
    0.021874999999999867, -0.032125000000000181, 0.059874999999999901, -0.04412499999999997,
    0.075874999999999915, -0.0041250000000001563, 0.021874999999999867, 0.0058749999999998526,
    -0.036125000000000185, -0.022125000000000172, -0.0041250000000001563, -0.058124999999999982,
    -0.026125000000000176, -0.030125000000000179, 0.045874999999999888, 0.035874999999999879,
    -0.026125000000000176, 0.041874999999999885, -0.086125000000000007, -0.060124999999999984,
    0.031874999999999876, -0.010125000000000162, -0.024125000000000174, -0.048124999999999973,
    -0.038125000000000187, 0.039874999999999883, -0.026125000000000176, 0.037874999999999881,
    -0.020125000000000171, 0.051874999999999893, -0.014125000000000165, 0.019874999999999865,
    -0.0021250000000001545, 0.027874999999999872, 0.0058749999999998526, 0.021874999999999867,
    0.023874999999999869, 0.085874999999999702, 0.085874999999999702, 0.11587499999999995,
)


def path_number(path: Column) -> Column:
    """Sort key of a path: its last run of digits, 0 without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(path, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long"), F.lit(0).cast("long"))


def list_scans(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", ordered: bool = True) -> DataFrame:
    """(frame_id, path) of the files of a folder with a prefix and a suffix; empty for a missing folder.

    Files without a byte hold no scan and are left out. ``ordered``: by number, then path; else by path.
    """
    files = _files(spark, path, prefix, suffix, "path")
    keys = [path_number(F.col("path")), F.col("path")] if ordered else [F.col("path")]
    # one row a file, sorted once on the driver's side of the plan: lists of files are small
    return files.select((F.row_number().over(Window.orderBy(*keys)) - 1).cast("long").alias("frame_id"), "path")


def _files(spark: SparkSession, path: str, prefix: str, suffix: str, *columns: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(path).select(*columns)
    except AnalysisException:
        return spark.createDataFrame([], ", ".join(f"{c} {'binary' if c == 'content' else 'string'}" for c in columns))


def _contents(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(frame_id, path, content); the numbering reads names alone and is small enough to broadcast."""
    return _files(spark, path, "", suffix, "path", "content").join(F.broadcast(list_scans(spark, path, "", suffix)), "path").select("frame_id", "path", "content")


def _decoded(files: DataFrame, decode, schema: str, fields: list[str]) -> DataFrame:
    """Run ``decode(bytes) -> dict of arrays`` on every file."""

    def run(batches):
        for batch in batches:
            for frame, path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = decode(content)
                n = len(got[fields[0]])
                yield pa.record_batch([pa.array([frame] * n, pa.int64()), pa.array([path] * n, pa.string()), *(pa.array(got[f]) for f in fields)], ["frame_id", "path", *fields])

    return files.mapInArrow(run, schema)


_POINT_FIELDS = ["point_idx", "x", "y", "z", "ring"]


def _points(x, y, z, ring=None) -> dict:
    n = len(x)
    return {"point_idx": np.arange(n, dtype=np.int64), "x": np.asarray(x, np.float32), "y": np.asarray(y, np.float32), "z": np.asarray(z, np.float32), "ring": np.zeros(n, np.int32) if ring is None else np.asarray(ring, np.int32)}


def read_bin(spark: SparkSession, path: str, suffix: str = ".bin", compat: bool = False) -> DataFrame:
    """Points of binary scans: four little-endian float32 a point (x, y, z, intensity); an incomplete last one is left out.

    ``compat`` adds the point (0, 0, 0) at the end that readers which test for the end of file late make.
    """

    def decode(data: bytes) -> dict:
        xyz = np.frombuffer(data, "<f4", count=len(data) // 16 * 4).reshape(-1, 4)[:, :3]
        if compat:
            xyz = np.vstack([xyz, np.zeros((1, 3), np.float32)])
        return _points(*xyz.T)

    return _decoded(_contents(spark, path, suffix), decode, POINTS, _POINT_FIELDS)


def read_txt(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Points of text scans: four numbers a line, parted by single blanks; lines with another number of fields are left out."""

    def decode(data: bytes) -> dict:
        lines = [f for f in (line.split(" ") for line in data.decode().split("\n")) if len(f) == 4]
        return _points(*np.array([[float(v) for v in f[:3]] for f in lines], np.float32).reshape(-1, 3).T)

    return _decoded(_contents(spark, path, suffix), decode, POINTS, _POINT_FIELDS)


def decode_png16(data: bytes) -> np.ndarray:
    """Values of a grey PNG of 8 or 16 bits, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, parts, size = 8, [], None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if color or interlace or depth not in (8, 16):
                raise ValueError("only plain grey images of 8 or 16 bits are read")
            size = (height, width, depth // 8)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("PNG without a header")
    height, width, step = size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width * step + 1)
    out = np.zeros((height + 1, width * step), np.int32)
    for r in range(height):
        kind, line, above, row = raw[r, 0], raw[r, 1:].astype(np.int32), out[r], out[r + 1]
        if kind == 0:
            row[:] = line
        elif kind == 1:
            row[:] = np.add.accumulate(line.reshape(-1, step), axis=0).ravel() % 256
        elif kind == 2:
            row[:] = (line + above) % 256
        else:
            for i in range(len(line)):
                left, corner = (row[i - step], above[i - step]) if i >= step else (0, 0)
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    p = left + above[i] - corner
                    near = (abs(p - left), abs(p - above[i]), abs(p - corner))
                    guess = (left, above[i], corner)[near.index(min(near))]
                row[i] = (line[i] + guess) % 256
    image = out[1:].reshape(height, width, step)
    return image[..., 0] if step == 1 else image[..., 0] * 256 + image[..., 1]


def read_depth_png(spark: SparkSession, path: str, suffix: str = ".png", scale: float = PNG_SCALE, corrections: tuple[float, ...] | None = None) -> DataFrame:
    """Dense pixels of depth images in metres; ``corrections`` are taken off row by row where there is a depth."""

    def decode(data: bytes) -> dict:
        image = decode_png16(data)
        row, col = np.indices(image.shape, np.int32)
        return {"row": row.ravel(), "col": col.ravel(), "depth": (image.ravel() / scale).astype(np.float32)}

    pixels = _decoded(_contents(spark, path, suffix), decode, PIXELS, ["row", "col", "depth"])
    return fix_depth(pixels, corrections) if corrections else pixels


def fix_depth(pixels: DataFrame, corrections: tuple[float, ...] = CORRECTIONS_64) -> DataFrame:
    """Take the error of its row off every depth of at least 1 mm; rows beyond the list stay."""
    error = F.coalesce(F.get(F.lit(list(corrections)), F.col("row")), F.lit(0.0))
    return pixels.withColumn("depth", F.when(F.col("depth") >= 0.001, F.col("depth") - error).otherwise(F.col("depth")).cast(pixels.schema["depth"].dataType))


_PCD_KINDS = {("F", 4): "<f4", ("F", 8): "<f8", ("U", 1): "u1", ("U", 2): "<u2", ("U", 4): "<u4", ("I", 1): "i1", ("I", 2): "<i2", ("I", 4): "<i4"}


def decode_pcd(data: bytes) -> dict:
    """Points of a PCD file, ascii or binary; the field label (or ring) becomes the ring."""
    head, at = {}, 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        words = data[at:end].decode().split()
        at = end + 1
        if words and not words[0].startswith("#"):
            head[words[0]] = words[1:]
    names, counts = head["FIELDS"], [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    if head["DATA"][0] == "ascii":
        places = dict(zip(names, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int).tolist(), strict=True))
        lines = [line.split() for line in data[at:].decode().splitlines() if line.strip()][:n]
        column = lambda name: np.array([float(f[places[name]]) for f in lines])
    elif head["DATA"][0] == "binary":
        kinds = [_PCD_KINDS[t, int(s)] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
        table = np.frombuffer(data, np.dtype([(f"{name}", k, (c,)) if c > 1 else (name, k) for name, k, c in zip(names, kinds, counts, strict=True)]), count=n, offset=at)
        column = lambda name: table[name]
    else:
        raise ValueError("only ascii and binary PCD files are read")
    ring = next((f for f in ("label", "ring") if f in names), None)
    return _points(column("x"), column("y"), column("z"), None if ring is None else column(ring))


def read_pcd(spark: SparkSession, path: str, suffix: str = ".pcd") -> DataFrame:
    return _decoded(_contents(spark, path, suffix), decode_pcd, POINTS, _POINT_FIELDS)


def read_scans(spark: SparkSession, path: str, fmt: str, sensor: Sensor | None = None) -> DataFrame:
    """Points by file kind: bin, txt, pcd, or png through the sensor model."""
    readers = {"bin": read_bin, "txt": read_txt, "pcd": read_pcd}
    if fmt in readers:
        return readers[fmt](spark, path)
    if fmt == "png" and sensor is not None:
        from rangescan.operators.project import unproject

        return unproject(read_depth_png(spark, path), sensor)
    raise ValueError(f"cannot read {fmt!r}" + (" without a sensor" if fmt == "png" else ""))


def decode_messages(messages: DataFrame, offsets: tuple[int, int, int, int], step: int) -> DataFrame:
    """Points of point-cloud messages (frame_id, data binary): x, y, z float32 and ring uint16 at byte offsets, ``step`` bytes a point."""
    kind = np.dtype({"names": ["x", "y", "z", "ring"], "formats": ["<f4", "<f4", "<f4", "<u2"], "offsets": list(offsets), "itemsize": step})

    def run(batches):
        for batch in batches:
            for frame, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = np.frombuffer(data, kind, count=len(data) // step)
                got = _points(t["x"], t["y"], t["z"], t["ring"])
                yield pa.record_batch([pa.array([frame] * len(t), pa.int64()), *(pa.array(got[f]) for f in _POINT_FIELDS)], ["frame_id", *_POINT_FIELDS])

    return messages.select(F.col("frame_id").cast("long"), "data").mapInArrow(run, POINTS.replace(" path string,", ""))


def odometry_pose(qx: Column, qy: Column, qz: Column, qw: Column, x: Column, y: Column, z: Column) -> Column:
    """Pose (array of 16) of a unit quaternion and a position."""
    one, two, zero = F.lit(1.0), F.lit(2.0), F.lit(0.0)
    return F.array(
        one - two * (qy * qy + qz * qz), two * (qx * qy - qz * qw), two * (qx * qz + qy * qw), x,
        two * (qx * qy + qz * qw), one - two * (qx * qx + qz * qz), two * (qy * qz - qx * qw), y,
        two * (qx * qz - qy * qw), two * (qy * qz + qx * qw), one - two * (qx * qx + qy * qy), z,
        zero, zero, zero, one,
    )
