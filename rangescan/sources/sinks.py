"""Writers of clusters, points and pixels."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def padded(number: Column, width: int = 6) -> Column:
    """Number as text with leading zeros; longer numbers are not cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def sampled(frames: DataFrame, every: int, seq: str = "frame_id") -> DataFrame:
    """Every ``every``-th frame, by number."""
    return frames.where(F.pmod(F.col(seq), F.lit(every)) == 0)


def save_clusters(clusters: DataFrame, path: str, every: int = 1) -> None:
    """Parquet by frame and label of every ``every``-th frame; nothing is written over."""
    named = sampled(clusters, every).withColumn("frame", padded(F.col("frame_id"))).withColumn("cloud", padded(F.col("label")))
    named.write.partitionBy("frame", "cloud").mode("errorifexists").parquet(path)


def save_points(points: DataFrame, path: str) -> None:
    points.withColumn("frame", padded(F.col("frame_id"))).write.partitionBy("frame").mode("errorifexists").parquet(path)


def save_pixels(pixels: DataFrame, path: str) -> None:
    """Depth images as sparse pixels, by frame."""
    pixels.withColumn("frame", padded(F.col("frame_id"))).write.partitionBy("frame").mode("errorifexists").parquet(path)


def to_labelled(points: DataFrame) -> DataFrame:
    """Points as (x, y, z, label): the ring is the label."""
    return points.select(*(c for c in ("frame_id", "point_idx") if c in points.columns), "x", "y", "z", F.col("ring").alias("label"))


def from_labelled(points: DataFrame) -> DataFrame:
    """Inverse of ``to_labelled``; points without a label have ring 0."""
    ring = F.col("label") if "label" in points.columns else F.lit(0)
    return points.select(*(c for c in ("frame_id", "point_idx") if c in points.columns), *(F.col(c).cast("float").alias(c) for c in "xyz"), ring.cast("int").alias("ring"))


def pcd_bytes(x, y, z, label) -> bytes:
    """A binary PCD file of labelled points."""
    table = np.zeros(len(x), np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("label", "<u4")]))
    table["x"], table["y"], table["z"], table["label"] = x, y, z, label
    n = len(table)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z label\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + table.tobytes()


def save_pcd(clusters: DataFrame, path: str, every: int = 1) -> DataFrame:
    """One PCD file for each frame and label below ``path``, a folder that all executors see; gives what was written.

    Call an action on the result. A file appears under its name only when it is complete.
    """

    def write(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs

        frame, label = (k.as_py() for k in key)
        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        folder = f"{root}/{frame:06d}"
        store.create_dir(folder, recursive=True)
        name, part = f"{folder}/cloud_{label:06d}.pcd", f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(pcd_bytes(*(table[c].to_numpy() for c in ("x", "y", "z", "label"))))
        store.move(part, name)
        return pa.table({"frame_id": pa.array([frame], pa.int64()), "label": pa.array([label], pa.int64()), "path": [name], "n_points": pa.array([table.num_rows], pa.int64())})

    rows = sampled(clusters, every).select(F.col("frame_id").cast("long"), F.col("label").cast("long"), "x", "y", "z")
    return rows.groupBy("frame_id", "label").applyInArrow(write, "frame_id long, label long, path string, n_points long")


def _by_frame(rows: DataFrame, path: str, suffix: str, content, columns: list[str]) -> DataFrame:
    """One file for each frame below ``path``: ``content`` makes its bytes of the frame's table; gives (frame_id, path)."""

    def write(key: tuple, table: pa.Table) -> pa.Table:
        from pyarrow import fs

        frame = key[0].as_py()
        store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        name, part = f"{root}/{frame:06d}{suffix}", f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(content(table))
        store.move(part, name)
        return pa.table({"frame_id": pa.array([frame], pa.int64()), "path": [name]})

    return rows.select(F.col("frame_id").cast("long"), *columns).groupBy("frame_id").applyInArrow(write, "frame_id long, path string")


def save_scans(points: DataFrame, path: str, fmt: str) -> DataFrame:
    """A scan file (bin, txt or pcd) for each frame, points in order of point_idx; call an action on the result."""

    def content(table: pa.Table) -> bytes:
        x, y, z, ring = (table.sort_by("point_idx")[c].to_numpy() for c in ("x", "y", "z", "ring"))
        if fmt == "pcd":
            return pcd_bytes(x, y, z, ring)
        if fmt == "bin":
            return np.column_stack([x, y, z, np.zeros(len(x))]).astype("<f4").tobytes()
        return "".join(f"{float(a)!r} {float(b)!r} {float(c)!r} 0\n" for a, b, c in zip(x, y, z, strict=True)).encode()

    if fmt not in ("bin", "txt", "pcd"):
        raise ValueError(f"cannot write {fmt!r}")
    return _by_frame(points, path, f".{fmt}", content, ["point_idx", "x", "y", "z", "ring"])


def png_bytes(image: np.ndarray) -> bytes:
    """A grey PNG of 16 bits."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.zeros((image.shape[0], 2 * image.shape[1] + 1), np.uint8)  # each begins with 0: no filter
    lines[:, 1:] = image.astype(">u2").view(np.uint8)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def save_images(pixels: DataFrame, path: str, rows: int, cols: int, scale: float) -> DataFrame:
    """A depth image for each frame, ``scale`` steps a metre, 0 where there is no pixel; call an action on the result."""

    def content(table: pa.Table) -> bytes:
        image = np.zeros((rows, cols), np.uint16)
        image[table["row"].to_numpy(), table["col"].to_numpy()] = np.rint(table["depth"].to_numpy() * scale)
        return png_bytes(image)

    return _by_frame(pixels, path, ".png", content, ["row", "col", "depth"])


def message_bytes(points: DataFrame) -> DataFrame:
    """(frame_id, data): a message for each frame, 18 bytes a point in order of point_idx: x, y, z, 4 unused bytes, ring."""
    kind = np.dtype({"names": ["x", "y", "z", "ring"], "formats": ["<f4", "<f4", "<f4", "<u2"], "offsets": [0, 4, 8, 16], "itemsize": 18})

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(table.num_rows, kind)
        for c in kind.names:
            out[c] = table.sort_by("point_idx")[c].to_numpy()
        return pa.table({"frame_id": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([out.tobytes()], pa.binary())})

    rows = points.select(F.col("frame_id").cast("long"), "point_idx", "x", "y", "z", "ring")
    return rows.groupBy("frame_id").applyInArrow(pack, "frame_id long, data binary")


def latest(clusters: DataFrame) -> DataFrame:
    """Rows of the last frame: what a store of the newest value holds."""
    last = clusters.agg(F.max("frame_id").alias("last"))
    return clusters.join(F.broadcast(last), F.col("frame_id") == F.col("last")).drop("last")  # one row
