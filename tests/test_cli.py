import numpy as np

from rangescan import cli
from rangescan.plans.sensor import Sensor


def test_a_folder_of_scans_is_segmented(spark, tmp_path):
    """Two scans of a wall in front of a 16-beam sensor; the objects are saved by frame and label."""
    sensor, folder = Sensor.vlp_16(), tmp_path / "scans"
    folder.mkdir()
    up, round_ = np.meshgrid(sensor.row_angles, sensor.col_angles[400:470], indexing="ij")
    depth = 5 / np.cos(up)
    wall = np.column_stack([v.ravel() for v in (depth * np.cos(up) * np.cos(round_), depth * np.cos(up) * np.sin(round_), depth * np.sin(up), np.zeros_like(up))])
    for name in ("2.bin", "10.bin"):
        (folder / name).write_bytes(wall.astype("<f4").tobytes())
    cli.main(["--path", str(folder), "--format", "bin", "--num_beams", "16", "--out", str(tmp_path / "out")])
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("frame_id").count().collect()
    assert sorted(r.frame_id for r in rows) == [0, 1] and all(r["count"] > 500 for r in rows)
