import math

import pytest
from pyspark.sql import functions as F

from rangescan.plans.sensor import Sensor, Span, col_of, from_degrees, row_of


def degrees(start, end, count):
    return Span.by_count(from_degrees(start), from_degrees(end), count)


def test_presets_have_the_known_sizes():
    assert [(s.rows, s.cols) for s in (Sensor.vlp_16(), Sensor.hdl_32(), Sensor.hdl_64(), Sensor.hdl_64_equal(), Sensor.full_sphere(1))] == [(16, 870), (32, 870), (64, 870), (64, 870), (180, 360)]
    with pytest.raises(ValueError):
        Sensor.preset(17)


def test_span_by_step_counts_whole_steps():
    s = Span.by_step(from_degrees(0), from_degrees(10.5), from_degrees(1))
    assert s.count == 10 and s.width == pytest.approx(math.radians(10.5))


def test_invalid_spans_are_refused():
    with pytest.raises(ValueError, match="Projection parameters invalid."):
        Sensor.from_spans([], [degrees(0, 10, 10)])
    with pytest.raises(ValueError, match="Projection parameters invalid."):
        Sensor.from_spans([degrees(0, 10, 0)], [degrees(0, 10, 10)])
    with pytest.raises(ValueError, match="arrays not filled"):
        Sensor((), (0.0,), 1.0).checked()


def test_angles_go_to_the_nearest_bin(spark):
    sensor = Sensor.from_spans([degrees(0, 10, 10)], [degrees(0, 10, 10)])
    rows = spark.createDataFrame([(float(k),) for k in range(-5, 16)], "a double").select("a", row_of(F.radians("a"), sensor).alias("r")).collect()
    assert [r.r for r in rows] == [min(9, max(0, int(r.a))) for r in rows]


@pytest.mark.parametrize("sensor", [Sensor.vlp_16(), Sensor.hdl_64(), Sensor.full_sphere(5)])
def test_bins_equal_a_scan_over_all_angles(spark, sensor):
    angles = [math.radians(-40 + 0.173 * k) for k in range(500)]
    got = spark.createDataFrame([(a,) for a in angles], "a double").select("a", row_of(F.col("a"), sensor).alias("r"), col_of(F.col("a") * 4, sensor).alias("c")).collect()
    best = lambda values, a: min(range(len(values)), key=lambda k: (abs(values[k] - a), k))
    assert [(r.r, r.c) for r in got] == [(best(sensor.row_angles, r.a), best(sensor.col_angles, r.a * 4)) for r in got]


def test_ties_go_to_the_earlier_bin(spark):
    up, down = Sensor((0.0, 1.0, 2.0), (0.0, 1.0), 2.0), Sensor((2.0, 1.0, 0.0), (0.0, 1.0), 2.0)
    row = spark.range(1).select(row_of(F.lit(0.5), up).alias("u"), row_of(F.lit(1.5), down).alias("d")).first()
    assert (row.u, row.d) == (0, 0)


def test_rows_and_columns_out_of_range():
    s = Sensor((0.1, 0.2), (0.0, 1.0, 2.0), 3.0)
    assert s.angle_from_row(5) == 0.0 and s.angle_from_col(-1) == 2.0 and s.angle_from_col(3) == 0.0


def test_alphas_wrap():
    s = Sensor.from_spans([degrees(0, 4, 4)], [degrees(0, 4, 4)])
    assert s.row_alphas == pytest.approx([math.radians(1)] * 3 + [0.0], abs=1e-3)
    assert s.col_alphas == pytest.approx([math.radians(1)] * 4, abs=1e-3)


def test_config_file(tmp_path):
    good = tmp_path / "img.cfg"
    good.write_text("# comment\n8;2;180;-180;-2;25\n")
    s = Sensor.from_config(str(good))
    assert (s.rows, s.cols) == (2, 8) and s.row_angles[1] == pytest.approx(math.radians(25)) and s.col_angles[1] == pytest.approx(math.radians(135))
    for text in ("8;2;180\n", "8;2;180;-180\n", "8;3;180;-180;1;2\n", "# nothing\n"):
        bad = tmp_path / "bad.cfg"
        bad.write_text(text)
        with pytest.raises(ValueError):
            Sensor.from_config(str(bad))
    with pytest.raises(FileNotFoundError):
        Sensor.from_config(str(tmp_path / "none.cfg"))
