"""Queries over the derived views, one or more for each operator, with the same in SQL."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangescan.functions import angles, colors, pose
from rangescan.operators import cluster, ground, labels, objects, project
from rangescan.operators.components import shared_folder
from rangescan.plans.segmentation import Settings, segment
from rangescan.plans.sensor import Sensor
from rangescan.plans.views import COLS, ROWS, SENSOR, emb3, ev, pts, px, table
from rangescan.sources.scans import CORRECTIONS_64, PNG_SCALE, decode_messages, fix_depth, odometry_pose, path_number, read_depth_png, read_scans
from rangescan.sources.sinks import from_labelled, message_bytes, padded, sampled, save_images, save_scans, to_labelled
from rangescan.streaming.pipeline import Pipeline, nearest_asof, replay, sync_nearest

SEPARATION, LINE, SIMPLE = math.radians(10), 0.2, 2.0
GROUND, WINDOW = math.radians(9), 5
QUERIES, ORACLES = {}, {}


def register(sql: str | None = None, name: str | None = None):
    """Add a query under its function's name; ``sql`` is its counterpart."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; minus zero becomes zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


# SQL fragments ----------------------------------------------------------------------------------------

_num = lambda x: f"{x!r}e0" if "e" not in repr(x) else repr(x)
_rows = ", ".join(f"({k}, {_num(a)}, {_num(d)})" for k, (a, d) in enumerate(zip(SENSOR.row_angles, SENSOR.row_alphas, strict=True)))
_cols = ", ".join(f"({k}, {_num(a)}, {_num(d)})" for k, (a, d) in enumerate(zip(SENSOR.col_angles, SENSOR.col_alphas, strict=True)))
PX = f"""WITH RECURSIVE px AS (SELECT l_orderkey // 750 AS frame_id, CAST(l_suppkey % 16 AS INTEGER) AS "row", CAST(l_partkey % 90 AS INTEGER) AS col, max(l_quantity) AS depth, count(*) AS n_points FROM lineitem GROUP BY 1, 2, 3),
sr(r, ra, al) AS (VALUES {_rows}), sc(c, ca, al) AS (VALUES {_cols})"""
PTS = PX + """, pts AS (SELECT frame_id, CAST("row" AS BIGINT) * 90 + col AS point_idx, depth * cos(ra) * cos(ca) AS x, depth * cos(ra) * sin(ca) AS y, depth * sin(ra) AS z, "row" AS ring, "row", col, depth FROM px JOIN sr ON sr.r = px."row" JOIN sc ON sc.c = px.col)"""
DENSE = PX + """, grid AS (SELECT f.frame_id, CAST(a.r AS INTEGER) AS "row", CAST(b.c AS INTEGER) AS col, coalesce(px.depth, 0.0) AS depth FROM (SELECT DISTINCT frame_id FROM px) f CROSS JOIN sr a CROSS JOIN sc b LEFT JOIN px ON px.frame_id = f.frame_id AND px."row" = a.r AND px.col = b.c)"""


def _slopes(source: str) -> str:
    """CTE with the slope of every cell of a dense CTE."""
    return f""", lagged AS (SELECT g.*, ra, lag(depth) OVER w AS d0, lag(ra) OVER w AS a0 FROM {source} g JOIN sr ON sr.r = g."row" WINDOW w AS (PARTITION BY frame_id, col ORDER BY "row")),
slopes AS (SELECT frame_id, "row", col, depth, CASE WHEN "row" = 0 THEN 0.0 ELSE atan2(abs(depth * sin(ra) - d0 * sin(a0)), abs(depth * cos(ra) - d0 * cos(a0))) END AS angle FROM lagged)"""


def _smooth(source: str, window: int) -> str:
    """CTE ``smooth`` with angles smoothed down the columns of a dense CTE."""
    weights = ", ".join(f"({k - window // 2}, {_num(w)})" for k, w in enumerate(ground.smoothing_kernel(window)))
    return f""", kernel(k, w) AS (VALUES {weights}),
smooth AS (SELECT a.frame_id, a."row", a.col, any_value(a.depth) AS depth, sum(w * b.angle) AS angle FROM {source} a CROSS JOIN kernel JOIN {source} b ON b.frame_id = a.frame_id AND b.col = a.col AND b."row" = {ROWS - 1} - abs({ROWS - 1} - abs(a."row" + k)) GROUP BY 1, 2, 3)"""


def _repaired() -> str:
    """CTE ``repaired``: hole repair, one step a row over a wide table of columns."""
    wide = ", ".join(f'max(depth) FILTER ("row" = {k}) AS d{k}' for k in range(ROWS))
    parts = [f", w0 AS (SELECT frame_id, col, {wide} FROM grid GROUP BY 1, 2), e0 AS (SELECT *, d0 AS e0 FROM w0)"]
    for k in range(1, ROWS):
        pairs = [(f"e{k - i}", f"d{k + j}") for i in range(1, 5) if k - i >= 0 for j in range(1, 5) if k + j < ROWS]
        fits = [f"({a} > 0.001 AND {b} > 0.001 AND abs({a} - {b}) < 1.0)" for a, b in pairs]
        total = " + ".join(f"CASE WHEN {f} THEN {a} + {b} ELSE 0.0 END" for f, (a, b) in zip(fits, pairs, strict=True)) or "0.0"
        count = " + ".join(f"CASE WHEN {f} THEN 2 ELSE 0 END" for f in fits) or "0"
        parts.append(f"e{k} AS MATERIALIZED (SELECT *, CASE WHEN d{k} < 0.001 AND {count} > 0 THEN ({total}) / ({count}) ELSE d{k} END AS e{k} FROM e{k - 1})")
    rows = " UNION ALL ".join(f'SELECT frame_id, {k} AS "row", col, e{k} AS depth FROM e{ROWS - 1}' for k in range(ROWS))
    return ", ".join(parts) + f", repaired AS ({rows})"


PREPARED = DENSE + _repaired() + _slopes("repaired") + _smooth("slopes", WINDOW)
BETA = "abs(atan2(least(a.depth, b.depth) * sin(al), greatest(a.depth, b.depth) - least(a.depth, b.depth) * cos(al)))"
VALUES = {"simple": "abs(a.depth - b.depth)", "angle": BETA, "line_dist": f"greatest(a.depth, b.depth) * sin({BETA})"}


def _pairs(source: str, value: str, step: int = 1) -> str:
    """CTE ``pairs`` (frame_id, src, dst, axis, da, db, diff) of neighbours of a CTE, each once."""
    out = []
    for k in range(1, step + 1):
        out.append(f"""SELECT a.frame_id, CAST(a."row" * {COLS} + a.col AS BIGINT) AS src, CAST(b."row" * {COLS} + b.col AS BIGINT) AS dst, 'row' AS axis, a.depth AS da, b.depth AS db, {value} AS diff FROM {source} a JOIN {source} b ON b.frame_id = a.frame_id AND b.col = a.col AND b."row" = a."row" + {k} JOIN sr ON sr.r = a."row" """)
        key = f"CASE WHEN least(a.col, b.col) = 0 AND greatest(a.col, b.col) = {COLS - 1} THEN {COLS - 1} ELSE least(a.col, b.col) END"
        out.append(f"""SELECT a.frame_id, CAST(a."row" * {COLS} + a.col AS BIGINT), CAST(b."row" * {COLS} + b.col AS BIGINT), 'col', a.depth, b.depth, {value} FROM {source} a JOIN {source} b ON b.frame_id = a.frame_id AND b."row" = a."row" AND b.col = (a.col + {k}) % {COLS} JOIN sc ON sc.c = {key}""")
    return ", pairs AS (" + " UNION ALL ".join(out) + ")"


def _labels(source: str, kind: str, threshold: float, step: int = 1) -> str:
    """CTE ``lab`` (frame_id, id, label) of the pixels of a sparse CTE without holes."""
    test = f"diff {'<' if kind == 'simple' else '>'} {_num(threshold)}"
    return _pairs(source, VALUES[kind], step) + f""", e AS (SELECT frame_id, src AS a, dst AS b FROM pairs WHERE {test} UNION ALL SELECT frame_id, dst, src FROM pairs WHERE {test}),
cc AS (SELECT frame_id, CAST("row" * {COLS} + col AS BIGINT) AS id, CAST("row" * {COLS} + col AS BIGINT) AS root FROM {source} UNION SELECT e.frame_id, e.b, cc.root FROM cc JOIN e ON e.frame_id = cc.frame_id AND e.a = cc.id WHERE cc.root < e.b),
rooted AS (SELECT frame_id, id, min(root) AS root FROM cc GROUP BY 1, 2),
lab AS (SELECT frame_id, id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY root) AS INTEGER) AS label FROM rooted)"""


LABELLED = PTS + _labels("px", "angle", SEPARATION) + ", clusters AS (SELECT p.*, label FROM pts p JOIN lab ON lab.frame_id = p.frame_id AND lab.id = p.point_idx)"
MIN_SIZE, MAX_SIZE = 5, 100
SIZED = LABELLED + f", sized AS (SELECT * FROM clusters QUALIFY count(*) OVER (PARTITION BY frame_id, label) BETWEEN {MIN_SIZE} AND {MAX_SIZE})"
_BOUNDS = ", ".join(f"{f}({c}) AS {f}_{c}" for f in ("min", "max") for c in "xyz")
_FLAT = "(" + " OR ".join(f"max_{c} <= min_{c}" for c in "xyz") + ")"
_SHAPE = ", ".join(
    [f"CASE WHEN {_FLAT} THEN 0.0 ELSE (min_{c} + max_{c}) / 2 END AS center_{c}" for c in "xyz"] + [f"CASE WHEN {_FLAT} THEN 0.0 ELSE max_{c} - min_{c} END AS scale_{c}" for c in "xyz"] + [f"CASE WHEN {_FLAT} THEN -1.0 ELSE (max_x - min_x) * (max_y - min_y) * (max_z - min_z) END AS volume"]
)
BOXES = SIZED + f", bounds AS (SELECT frame_id, label, count(*) AS n_points, {_BOUNDS} FROM sized GROUP BY 1, 2), boxes AS (SELECT *, {_SHAPE} FROM bounds)"
BOX_COLUMNS = [f"{n}_{c}" for n in ("min", "max", "center", "scale") for c in "xyz"] + ["volume"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_image(px(spark, sf_dir), SENSOR, "angle", SEPARATION)


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pts(spark, sf_dir)
    return cluster.cluster(points, points, _labelled(spark, sf_dir), MIN_SIZE, MAX_SIZE)


# range images ------------------------------------------------------------------------------------------


@register(PX + ' SELECT frame_id, "row", col, depth, n_points FROM px')
def range_image_max(spark, sf_dir):
    return px(spark, sf_dir)


@register(PX + " SELECT frame_id, count(*) AS n_pixels, CAST(sum(n_points) AS BIGINT) AS n_points, max(n_points) AS most FROM px GROUP BY 1")
def points_per_pixel(spark, sf_dir):
    return px(spark, sf_dir).groupBy("frame_id").agg(F.count("*").alias("n_pixels"), F.sum("n_points").alias("n_points"), F.max("n_points").alias("most"))


@register(PTS + f' SELECT frame_id, point_idx, {r("x")} AS x, {r("y")} AS y, {r("z")} AS z FROM pts WHERE "row" = 3 AND col = 10')
def pixel_lookup(spark, sf_dir):
    points = pts(spark, sf_dir)
    found = project.points_of_pixel(points.select("frame_id", "point_idx", "x", "y", "z"), points.select("frame_id", "point_idx", "row", "col"), 3, 10)
    return rounded(found.select("frame_id", "point_idx", "x", "y", "z"), "x", "y", "z")


@register(PTS + f" SELECT frame_id, point_idx, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z, ring FROM pts")
def unproject_points(spark, sf_dir):
    return rounded(pts(spark, sf_dir).select("frame_id", "point_idx", "x", "y", "z", "ring"), "x", "y", "z")


EMB = PX + ", p AS (SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS point_idx, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z, CAST(vec_id % 16 AS INTEGER) AS ring FROM embeddings)"


@register(
    EMB
    + f""", d AS (SELECT *, sqrt(x * x + y * y + z * z) AS dist FROM p WHERE sqrt(x * x + y * y + z * z) >= 0.01),
b AS (SELECT frame_id, dist, (SELECT arg_min(r, abs(ra - asin(z / dist))) FROM sr) AS "row", (SELECT arg_min(c, abs(ca - atan2(y, x))) FROM sc) AS col FROM d)
SELECT frame_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, {r("max(dist)")} AS depth, count(*) AS n_points FROM b GROUP BY 1, 2, 3"""
)
def spherical_bins(spark, sf_dir):
    return rounded(project.to_pixels(project.binned(emb3(spark, sf_dir), SENSOR)), "depth")


@register(
    EMB
    + f""", d AS (SELECT *, sqrt(x * x + y * y) AS dist FROM p WHERE sqrt(x * x + y * y) >= 0.01),
b AS (SELECT frame_id, ring, dist, (SELECT arg_min(c, abs(ca - atan2(y, x))) FROM sc) AS col FROM d)
SELECT frame_id, ring AS "row", CAST(col AS INTEGER) AS col, {r("max(dist)")} AS depth, count(*) AS n_points FROM b GROUP BY 1, 2, 3"""
)
def ring_bins(spark, sf_dir):
    return rounded(project.to_pixels(project.binned(emb3(spark, sf_dir), SENSOR, "ring")), "depth")


@register(PX + ", fix(k, v) AS (VALUES " + ", ".join(f"({k}, {_num(v)})" for k, v in enumerate(CORRECTIONS_64)) + f""") SELECT frame_id, "row", col, {r("depth - v")} AS depth FROM px JOIN fix ON k = "row" """)
def depth_corrections(spark, sf_dir):
    return rounded(fix_depth(px(spark, sf_dir)).select("frame_id", "row", "col", "depth"), "depth")


@register(PX + f""" SELECT frame_id, col, 15 - "row" AS "row", {r("depth - avg(depth) OVER (PARTITION BY frame_id, col)")} AS residual FROM px""")
def calibration_residual(spark, sf_dir):
    return rounded(objects.calibration_residual(px(spark, sf_dir), ROWS), "residual")


@register(PX + ' SELECT frame_id, "row", col, depth FROM px WHERE frame_id % 4 = 0')
def frame_sampling(spark, sf_dir):
    return sampled(px(spark, sf_dir), 4).select("frame_id", "row", "col", "depth")


# ground ------------------------------------------------------------------------------------------------


@register(DENSE + f""", near AS (SELECT g.*, (SELECT 1) AS one FROM grid g)
SELECT a.frame_id, a."row", a.col, {r("CASE WHEN any_value(a.depth) > 0 THEN any_value(a.depth) ELSE sum(0.5 * b.depth) END")} AS depth
FROM near a CROSS JOIN (VALUES (-2), (2)) k(k) JOIN near b ON b.frame_id = a.frame_id AND b.col = a.col AND b."row" = {ROWS - 1} - abs({ROWS - 1} - abs(a."row" + k)) GROUP BY 1, 2, 3""")
def repair_depth_uniform(spark, sf_dir):
    return rounded(ground.repair_depth_uniform(px(spark, sf_dir), SENSOR), "depth")


@register(DENSE + _repaired() + f' SELECT frame_id, CAST("row" AS INTEGER) AS "row", col, {r("depth")} AS depth FROM repaired')
def repair_depth_sequential(spark, sf_dir):
    return rounded(ground.repair_depth(px(spark, sf_dir), SENSOR), "depth")


@register(DENSE + _slopes("grid") + f' SELECT frame_id, "row", col, {r("angle")} AS angle FROM slopes')
def angle_image(spark, sf_dir):
    return rounded(ground.angle_image(px(spark, sf_dir), SENSOR), "angle")


def _smoothed(window: int):
    def query(spark, sf_dir):
        return rounded(ground.smooth_slopes(px(spark, sf_dir), SENSOR, window), "angle")

    return query


for _w in ground.SMOOTHING:
    register(DENSE + _slopes("grid") + _smooth("slopes", _w) + f' SELECT frame_id, "row", col, {r("angle")} AS angle FROM smooth', f"smooth_angles_{_w}")(_smoothed(_w))


def _prepared(spark, sf_dir):
    return ground.prepared(px(spark, sf_dir), SENSOR, WINDOW)


@register(PREPARED + f' SELECT frame_id, CAST("row" AS INTEGER) AS "row", col, {r(f"CASE WHEN angle > {_num(GROUND)} THEN depth ELSE 0.0 END")} AS depth FROM smooth')
def zero_out_ground_threshold(spark, sf_dir):
    return rounded(ground.zero_ground_threshold(_prepared(spark, sf_dir), GROUND).select("frame_id", "row", "col", "depth"), "depth")


SEEDS = PREPARED + """, low AS (SELECT frame_id, col, max("row") FILTER (depth >= 0.001 OR "row" = 0) AS low FROM smooth GROUP BY 1, 2),
seeds AS (SELECT s.frame_id, s.col, s."row", s.angle <= pi() / 6 AS seed, s.depth FROM smooth s JOIN low l ON l.frame_id = s.frame_id AND l.col = s.col AND l.low = s."row")"""


@register(SEEDS + ' SELECT frame_id, col, CAST("row" AS INTEGER) AS "row", seed FROM seeds')
def ground_seeds(spark, sf_dir):
    return ground.ground_seeds(_prepared(spark, sf_dir), SENSOR)


FLOOD = SEEDS + f""", joined AS (SELECT a.frame_id, a."row" AS r1, a.col AS c1, a.depth AS d1, b."row" AS r2, b.col AS c2, b.depth AS d2 FROM smooth a JOIN smooth b ON b.frame_id = a.frame_id AND ((b.col = a.col AND abs(b."row" - a."row") = 1) OR (b."row" = a."row" AND (b.col = (a.col + 1) % {COLS} OR a.col = (b.col + 1) % {COLS}))) WHERE abs(a.angle - b.angle) < {_num(GROUND)}),
flood AS (SELECT frame_id, "row", col, depth FROM seeds WHERE seed UNION SELECT j.frame_id, j.r2, j.c2, j.d2 FROM flood f JOIN joined j ON j.frame_id = f.frame_id AND j.r1 = f."row" AND j.c1 = f.col WHERE f.depth >= 0.001),
mask AS (SELECT s.frame_id, CAST(s."row" AS INTEGER) AS "row", s.col, s.depth, f.frame_id IS NOT NULL AS flooded FROM smooth s LEFT JOIN (SELECT DISTINCT frame_id, "row", col FROM flood) f ON f.frame_id = s.frame_id AND f."row" = s."row" AND f.col = s.col),
ground AS (SELECT *, coalesce(max(CAST(flooded AS INTEGER)) OVER (PARTITION BY frame_id, col ORDER BY "row" ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) = 1 AS ground FROM mask)"""


@register(FLOOD + ' SELECT frame_id, "row", col, flooded, ground FROM ground')
def ground_mask(spark, sf_dir):
    return ground.ground_mask(_prepared(spark, sf_dir), SENSOR, GROUND, WINDOW).select("frame_id", "row", "col", "flooded", "ground")


@register(FLOOD + f' SELECT frame_id, "row", col, {r("CASE WHEN ground THEN 0.0 ELSE depth END")} AS depth FROM ground')
def ground_removed(spark, sf_dir):
    return rounded(ground.remove_ground(px(spark, sf_dir), SENSOR, 9.0, WINDOW), "depth")


@register(
    PX
    + f""", ends AS (SELECT frame_id, col, coalesce(max(depth) FILTER ("row" = 4), 0.0) AS a, coalesce(max(depth) FILTER ("row" = 7), 0.0) AS b FROM px WHERE "row" IN (4, 7) GROUP BY 1, 2), t AS (SELECT max(ra) FILTER (r = 4) AS va, max(ra) FILTER (r = 7) AS vb FROM sr)
SELECT frame_id, col, {r("CASE WHEN a >= 0.001 AND b >= 0.001 THEN atan2(abs(a * sin(va) - b * sin(vb)), abs(a * cos(va) - b * cos(vb))) ELSE 0.0 END")} AS angle FROM ends CROSS JOIN t"""
)
def line_angle(spark, sf_dir):
    return rounded(ground.line_angle(px(spark, sf_dir), SENSOR, 4, 7), "angle")


# differences, labels, colours ---------------------------------------------------------------------------


def _edges(kind: str):
    def query(spark, sf_dir):
        return rounded(labels.edge_table(px(spark, sf_dir), SENSOR, kind).select("frame_id", "src", "dst", "axis", "diff"), "diff")

    return query


def _labels_of(kind: str, threshold: float, step: int = 1, native: bool = False):
    def query(spark, sf_dir):
        return labels.label_image(px(spark, sf_dir), SENSOR, kind, threshold, step, step, native)

    return query


_LABEL_ROWS = f' SELECT frame_id, CAST(id // {COLS} AS INTEGER) AS "row", CAST(id % {COLS} AS INTEGER) AS col, label FROM lab'
for _kind, _threshold in (("simple", SIMPLE), ("angle", SEPARATION), ("line_dist", LINE)):
    register(PX + _pairs("px", VALUES[_kind]) + f" SELECT frame_id, src, dst, axis, {r('diff')} AS diff FROM pairs", f"diff_{_kind}")(_edges(_kind))
    register((PX + _labels("px", _kind, _threshold) + _LABEL_ROWS) if _kind != "simple" else None, f"labels_{_kind}")(_labels_of(_kind, _threshold))
# holes take the label of a neighbour within the threshold
ORACLES["labels_simple"] = DENSE + _pairs("grid", VALUES["simple"]) + f""", t AS (SELECT frame_id, src AS a, dst AS b, da, db FROM pairs WHERE diff < {_num(SIMPLE)} UNION ALL SELECT frame_id, dst, src, db, da FROM pairs WHERE diff < {_num(SIMPLE)}),
e AS (SELECT * FROM t WHERE da >= 0.001 AND db >= 0.001),
cc AS (SELECT frame_id, CAST("row" * {COLS} + col AS BIGINT) AS id, CAST("row" * {COLS} + col AS BIGINT) AS root FROM px UNION SELECT e.frame_id, e.b, cc.root FROM cc JOIN e ON e.frame_id = cc.frame_id AND e.a = cc.id WHERE cc.root < e.b),
inner_lab AS (SELECT frame_id, id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY min(root)) AS INTEGER) AS label FROM cc GROUP BY 1, 2),
lab AS (SELECT * FROM inner_lab UNION ALL SELECT t.frame_id, t.b, min(label) FROM t JOIN inner_lab i ON i.frame_id = t.frame_id AND i.id = t.a WHERE t.da >= 0.001 AND t.db < 0.001 GROUP BY 1, 2)""" + _LABEL_ROWS
register(PX + _labels("px", "angle", SEPARATION, 2) + _LABEL_ROWS, "labels_step2")(_labels_of("angle", SEPARATION, 2))
_PALETTE = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(colors.PALETTE))


@register(PX + _labels("px", "angle", SEPARATION) + f", pal(k, c0, c1, c2) AS (VALUES {_PALETTE})" + f' SELECT frame_id, CAST(id // {COLS} AS INTEGER) AS "row", CAST(id % {COLS} AS INTEGER) AS col, label, c0, c1, c2 FROM lab JOIN pal ON pal.k = label % 200')
def label_colors(spark, sf_dir):
    return colors.labels_to_color(_labelled(spark, sf_dir)).select("frame_id", "row", "col", "label", "color.*")


def _diff_colors(kind: str, scale: float):
    def query(spark, sf_dir):
        image = px(spark, sf_dir)
        edges = labels.edge_table(image, SENSOR, kind)
        own = edges.select("frame_id", F.col("src").alias("id"), "axis", "diff").groupBy("frame_id", "id").agg(*(F.max(F.when(F.col("axis") == a, F.col("diff"))).alias(a) for a in ("row", "col")))
        values = image.withColumn("id", F.col("row").cast("long") * COLS + F.col("col")).select("frame_id", "id", "depth").join(own, ["frame_id", "id"], "left")
        unit = F.degrees if kind == "angle" else (lambda c: c)
        color = colors.diff_color(F.col("depth"), *(F.coalesce(unit(F.col(a)), F.lit(0.0)) for a in ("row", "col")), scale)
        return values.withColumn("color", color).select("frame_id", "id", "color.*")

    return query


def _diff_colors_sql(kind: str, scale: float) -> str:
    byte = lambda v: f"255 - CAST(trunc(255 * {v} / {scale}) AS INTEGER) % 256"
    unit = "degrees(diff)" if kind == "angle" else "diff"
    return PX + _pairs("px", VALUES[kind]) + f""", own AS (SELECT frame_id, src, coalesce(max({unit}) FILTER (axis = 'row'), 0.0) AS vr, coalesce(max({unit}) FILTER (axis = 'col'), 0.0) AS vc FROM pairs GROUP BY 1, 2)
SELECT px.frame_id, CAST("row" * {COLS} + col AS BIGINT) AS id, {byte("coalesce(vr, 0.0)")} AS c0, {byte("coalesce(vc, 0.0)")} AS c1, 0 AS c2 FROM px LEFT JOIN own ON own.frame_id = px.frame_id AND own.src = px."row" * {COLS} + px.col"""


for _kind, _scale in (("angle", 90.0), ("line_dist", 20.0)):
    register(_diff_colors_sql(_kind, _scale), f"diff_colors_{_kind}")(_diff_colors(_kind, _scale))


# clusters and objects -----------------------------------------------------------------------------------


@register(LABELLED + f" SELECT frame_id, label, point_idx, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM clusters")
def cluster_points(spark, sf_dir):
    points = pts(spark, sf_dir)
    found = cluster.cluster_points(points, points, _labelled(spark, sf_dir))
    return rounded(found.select("frame_id", "label", "point_idx", "x", "y", "z"), "x", "y", "z")


@register(LABELLED + " SELECT frame_id, label, count(*) AS size FROM clusters GROUP BY 1, 2")
def cluster_sizes(spark, sf_dir):
    points = pts(spark, sf_dir)
    return cluster.cluster_points(points, points, _labelled(spark, sf_dir)).groupBy("frame_id", "label").agg(F.count("*").alias("size"))


@register(SIZED + " SELECT frame_id, label, count(*) AS size FROM sized GROUP BY 1, 2")
def size_filter(spark, sf_dir):
    return _clusters(spark, sf_dir).groupBy("frame_id", "label").agg(F.count("*").alias("size"))


TOLERANCE = 2.0


@register(
    PTS
    + f""", few AS (SELECT * FROM pts WHERE frame_id % 10 = 0), e AS (SELECT a.frame_id, a.point_idx AS a, b.point_idx AS b FROM few a JOIN few b ON a.frame_id = b.frame_id AND a.point_idx <> b.point_idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {TOLERANCE * TOLERANCE}),
cc AS (SELECT frame_id, point_idx AS id, point_idx AS root FROM few UNION SELECT e.frame_id, e.b, cc.root FROM cc JOIN e ON e.frame_id = cc.frame_id AND e.a = cc.id WHERE cc.root < e.b),
lab AS (SELECT frame_id, id AS point_idx, min(root) AS label FROM cc GROUP BY 1, 2) SELECT frame_id, point_idx, label FROM lab QUALIFY count(*) OVER (PARTITION BY frame_id, label) BETWEEN 2 AND 1000"""
)
def euclidean_clusters(spark, sf_dir):
    return cluster.euclidean_cluster(pts(spark, sf_dir), TOLERANCE, 2, 1000, skip=10).select("frame_id", "point_idx", "label")


@register(BOXES + " SELECT frame_id, label, n_points, " + ", ".join(f"{r(c)} AS {c}" for c in BOX_COLUMNS) + " FROM boxes")
def bbox(spark, sf_dir):
    return rounded(objects.bboxes(_clusters(spark, sf_dir)), *BOX_COLUMNS)


_LOW = ", ".join([f"greatest(a.min_{c}, b.min_{c}) AS min_{c}" for c in "xyz"] + [f"least(a.max_{c}, b.max_{c}) AS max_{c}" for c in "xyz"])


@register(BOXES + f", crossed AS (SELECT a.frame_id, a.label AS label_a, b.label AS label_b, {_LOW} FROM boxes a JOIN boxes b ON a.frame_id = b.frame_id AND a.label < b.label), shaped AS (SELECT *, {_SHAPE} FROM crossed) SELECT frame_id, label_a, label_b, " + ", ".join(f"{r(c)} AS {c}" for c in BOX_COLUMNS) + " FROM shaped WHERE volume > 0")
def bbox_intersections(spark, sf_dir):
    return rounded(objects.bbox_intersections(objects.bboxes(_clusters(spark, sf_dir))), *BOX_COLUMNS)


OBJECTS = SIZED + ", obj AS (SELECT frame_id, label, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 0.0 END AS extent_x, CASE WHEN max(x) > min(x) THEN max(y) - min(y) ELSE 0.0 END AS extent_y, CASE WHEN max(x) > min(x) THEN max(z) - min(z) ELSE 0.0 END AS extent_z FROM sized GROUP BY 1, 2)"
_OBJECT = [f"{n}_{c}" for n in ("center", "extent") for c in "xyz"]


@register(OBJECTS + " SELECT frame_id, label, " + ", ".join(f"{r(c)} AS {c}" for c in _OBJECT) + " FROM obj")
def object_box(spark, sf_dir):
    return rounded(objects.object_boxes(_clusters(spark, sf_dir)), *_OBJECT)


@register(OBJECTS + " SELECT frame_id, label, extent_z >= 0.3 AS shown, extent_x * extent_y * extent_z > 20 OR greatest(extent_x, extent_y, extent_z) > 5 AS large, extent_x * extent_y * extent_z < 30 AND greatest(extent_x, extent_y, extent_z) < 6 AS marked FROM obj")
def box_class(spark, sf_dir):
    return objects.box_classes(objects.object_boxes(_clusters(spark, sf_dir))).select("frame_id", "label", "shown", "large", "marked")


@register()
def object_hull(spark, sf_dir):
    """Outline of each object, with the area of its polygon."""
    hulls = objects.object_hulls(_clusters(spark, sf_dir))
    turned = F.concat(F.slice("hull", 2, F.greatest(F.size("hull"), F.lit(1))), F.slice("hull", 1, 1))
    area = F.abs(F.aggregate(F.zip_with("hull", turned, lambda a, b: a.x * b.y - b.x * a.y), F.lit(0.0), lambda s, v: s + v)) / 2
    return rounded(hulls.select("frame_id", "label", "min_z", "height", F.size("hull").alias("n_corners"), area.alias("area")), "min_z", "height", "area")


@register(SIZED + f" SELECT frame_id, label, {r('min(z)')} AS min_z, {r('max(z) - min(z)')} AS height FROM sized GROUP BY 1, 2 HAVING max(z) - min(z) >= 0.3")
def object_heights(spark, sf_dir):
    """Foot and height of the outlines that are shown."""
    return rounded(objects.object_hulls(_clusters(spark, sf_dir)).select("frame_id", "label", "min_z", "height"), "min_z", "height")


@register()
def segmentation(spark, sf_dir):
    """The whole plan on the points of the view: ground off, labels, clusters."""
    points = pts(spark, sf_dir).drop("row", "col", "depth")
    found = segment(points, SENSOR, Settings(ground=9.0, window=WINDOW, min_size=MIN_SIZE))
    return found.groupBy("frame_id", "label").agg(F.count("*").alias("size"), F.min("point_idx").alias("first_point"))


@register()
def labels_native(spark, sf_dir):
    """Labels without a Python kernel, as for images that do not fit a worker."""
    return _labels_of("angle", SEPARATION, native=True)(spark, sf_dir)


ORACLES["labels_native"] = PX + _labels("px", "angle", SEPARATION) + _LABEL_ROWS


# poses, angles, names, time ------------------------------------------------------------------------------


@register(PTS + f" SELECT frame_id, point_idx, {r('cos(frame_id * 0.1) * x - sin(frame_id * 0.1) * y + frame_id')} AS x, {r('sin(frame_id * 0.1) * x + cos(frame_id * 0.1) * y - 1')} AS y, {r('z')} AS z, ring FROM pts")
def transform_points(spark, sf_dir):
    points = pts(spark, sf_dir)
    poses = points.select("frame_id").distinct().withColumn("pose", pose.planar(F.col("frame_id").cast("double"), -1.0, F.col("frame_id") * 0.1))
    return rounded(objects.transform_points(points, poses).select("frame_id", "point_idx", "x", "y", "z", "ring"), "x", "y", "z")


_A, _B = "(s_suppkey % 13) * 0.2", "(s_nationkey % 7) * 0.3 - 1.0"


@register(
    f"""WITH t AS (SELECT s_suppkey, CAST(s_suppkey % 10 AS DOUBLE) - CAST(s_nationkey % 5 AS DOUBLE) AS dx, CAST(s_suppkey % 3 AS DOUBLE) - 1 AS dy, CAST({_A} AS DOUBLE) AS a, CAST({_B} AS DOUBLE) AS b FROM supplier)
SELECT s_suppkey, {r("cos(b) * dx + sin(b) * dy")} AS x, {r("cos(b) * dy - sin(b) * dx")} AS y, {r("cos(a - b)")} AS cos_theta, {r("sin(a - b)")} AS sin_theta FROM t"""
)
def local_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    own = pose.planar(F.expr("cast(s_suppkey % 10 as double)"), F.expr("cast(s_suppkey % 3 as double)"), F.expr(f"cast({_A} as double)"))
    other = pose.planar(F.expr("cast(s_nationkey % 5 as double)"), F.lit(1.0), F.expr(f"cast({_B} as double)"))
    local = rows.select("s_suppkey", pose.in_local_frame(own, other).alias("p"))
    return rounded(local.select("s_suppkey", F.get("p", F.lit(3)).alias("x"), F.get("p", F.lit(7)).alias("y"), F.get("p", F.lit(0)).alias("cos_theta"), F.get("p", F.lit(4)).alias("sin_theta")), "x", "y", "cos_theta", "sin_theta")


@register(
    f"""WITH t AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS x, CAST((s_suppkey % 29) * 0.1 + 0.05 AS DOUBLE) AS roll, CAST((s_suppkey % 11) * 0.1 - 0.5 AS DOUBLE) AS pitch, CAST((s_suppkey % 17) * 0.1 - 0.8 AS DOUBLE) AS yaw FROM supplier)
SELECT s_suppkey, {r("x")} AS x, {r("roll")} AS roll, {r("pitch")} AS pitch, {r("yaw")} AS yaw FROM t"""
)
def pose_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    turn = [F.expr(f"cast({e} as double)") for e in ("(s_suppkey % 29) * 0.1 + 0.05", "(s_suppkey % 11) * 0.1 - 0.5", "(s_suppkey % 17) * 0.1 - 0.8")]
    there = rows.select("s_suppkey", pose.from_vector(F.col("s_suppkey").cast("double"), F.lit(0.0), F.lit(0.0), *turn).alias("p"))
    back = there.select("s_suppkey", pose.to_vector(F.col("p")).alias("v"))
    return rounded(back.select("s_suppkey", "v.x", "v.roll", "v.pitch", "v.yaw"), "x", "roll", "pitch", "yaw")


@register(f"SELECT event_id, {r('value * 10 + 360 * (CASE WHEN value * 10 > 360 THEN -ceil((value * 10 - 360) / 360) WHEN value * 10 < 0 THEN ceil((0 - value * 10) / 360) ELSE 0 END)')} AS degrees FROM events")
def normalize_angle(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", angles.normalize(F.col("value") * 10, 0.0, 360.0).alias("degrees")), "degrees")


@register("SELECT page_id, url, CAST(CASE WHEN regexp_matches(url, '[0-9]') THEN TRY_CAST(list_extract(regexp_extract_all(url, '[0-9]+'), -1) AS BIGINT) ELSE 0 END AS BIGINT) AS number, row_number() OVER (ORDER BY CASE WHEN regexp_matches(url, '[0-9]') THEN TRY_CAST(list_extract(regexp_extract_all(url, '[0-9]+'), -1) AS BIGINT) ELSE 0 END, url, page_id) AS place FROM pages")
def file_numeric_order(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", path_number(F.col("url")).alias("number"))
    # a list of files: sorted as a whole, as the reader's list is
    return rows.withColumn("place", F.row_number().over(Window.orderBy("number", "url", "page_id")).cast("long"))


@register("SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 97 AS VARCHAR)) >= 6 THEN CAST(o_orderkey * 97 AS VARCHAR) ELSE lpad(CAST(o_orderkey * 97 AS VARCHAR), 6, '0') END AS name FROM orders")
def padded_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", padded(F.col("o_orderkey") * 97).alias("name"))


_EV = "WITH ev AS (SELECT user_id AS key, ts, value, event_type AS kind, event_id FROM events), a AS (SELECT * FROM ev WHERE kind = 'click'), b AS (SELECT * FROM ev WHERE kind = 'purchase')"
MAX_DT = 86_400.0


@register(
    _EV
    + """ SELECT a.key, a.event_id AS frame_id, b.event_id AS odom_id FROM a JOIN b ON a.key = b.key AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000
QUALIFY row_number() OVER (PARTITION BY a.key, a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts, b.event_id) = 1"""
)
def nearest_odometry(spark, sf_dir):
    readings = ev(spark, sf_dir)
    frames = readings.where("kind = 'click'").select("key", "ts", F.col("event_id").alias("frame_id"))
    odom = readings.where("kind = 'purchase'").select("key", "ts", F.col("event_id").alias("id"))
    return sync_nearest(frames, odom, MAX_DT, ["key"]).select("key", "frame_id", "odom_id")


@register(_EV + " SELECT a.key, a.event_id AS frame_id, epoch_us(b.ts) AS odom_us FROM a ASOF LEFT JOIN (SELECT DISTINCT key, ts FROM b) b ON a.key = b.key AND a.ts >= b.ts")
def asof_odometry(spark, sf_dir):
    readings = ev(spark, sf_dir)
    frames = readings.where("kind = 'click'").select("key", "ts", F.col("event_id").alias("frame_id"))
    odom = readings.where("kind = 'purchase'").select("key", "ts", F.col("event_id").alias("id"))
    return nearest_asof(frames, odom, ["key"]).select("key", "frame_id", F.unix_micros("odom_ts").alias("odom_us"))


# sources, sensors, sinks and streams -----------------------------------------------------------------------

_SINGLE = ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}" for c in "xyz")


def _scans(fmt: str):
    def query(spark, sf_dir):
        """One file a frame, written and read back; the frame is the number in the file's name."""
        folder = shared_folder(spark, f"scans-{fmt}")
        save_scans(pts(spark, sf_dir), folder, fmt).count()
        rows = read_scans(spark, folder, fmt)
        return rounded(rows.select(path_number(F.col("path")).alias("frame_id"), "point_idx", *(F.col(c).cast("double") for c in "xyz"), "ring"), "x", "y", "z", digits=4)

    return query


for _fmt, _ring in (("bin", "0"), ("txt", "0"), ("pcd", "ring")):
    register(PTS + f" SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS point_idx, {_SINGLE}, CAST({_ring} AS INTEGER) AS ring FROM pts", f"scans_{_fmt}")(_scans(_fmt))


@register(DENSE + f' SELECT frame_id, "row", col, round(depth - CASE WHEN depth >= 0.001 THEN v ELSE 0 END, 4) + 0.0 AS depth FROM grid JOIN (VALUES ' + ", ".join(f"({k}, {_num(v)})" for k, v in enumerate(CORRECTIONS_64[:ROWS])) + ') fix(k, v) ON k = "row"')
def scans_png(spark, sf_dir):
    """Depth images of 16 bits, written and read back with the error of each row taken off."""
    folder = shared_folder(spark, "scans-png")
    save_images(px(spark, sf_dir), folder, ROWS, COLS, PNG_SCALE).count()
    rows = read_depth_png(spark, folder, corrections=CORRECTIONS_64)
    return rounded(rows.select(path_number(F.col("path")).alias("frame_id"), "row", "col", F.col("depth").cast("double")), "depth", digits=4)


@register(PTS + f" SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) - 1 AS point_idx, {_SINGLE}, CAST(ring AS INTEGER) AS ring FROM pts")
def message_points(spark, sf_dir):
    """Points packed into messages of a frame each and unpacked again."""
    rows = decode_messages(message_bytes(pts(spark, sf_dir)), (0, 4, 8, 16), 18)
    return rounded(rows.select("frame_id", "point_idx", *(F.col(c).cast("double") for c in "xyz"), "ring"), "x", "y", "z", digits=4)


@register(PTS + f" SELECT frame_id, point_idx, {_SINGLE}, CAST(ring AS INTEGER) AS ring FROM pts")
def labelled_points(spark, sf_dir):
    rows = from_labelled(to_labelled(pts(spark, sf_dir)))
    return rounded(rows.select("frame_id", "point_idx", *(F.col(c).cast("double") for c in "xyz"), "ring"), "x", "y", "z", digits=4)


_PRESETS = {"16": (15, -15, 16), "32": (10, -30, 32), "64 equal": (2, -24, 64), "sphere": (-90, 90, 180)}


@register("WITH p(name, top, bottom, n, cols) AS (VALUES " + ", ".join(f"('{k}', {a}e0, {b}e0, {n}, {360 if k == 'sphere' else 870})" for k, (a, b, n) in _PRESETS.items()) + """)
SELECT name, n AS n_rows, cols AS n_cols, round(radians(top), 3) + 0.0 AS first_row, round(radians(top + (bottom - top) * (n - 1) / n), 2) + 0.0 AS last_row, round(radians(-180), 3) AS first_col, round(radians(-180 + 360e0 * (cols - 1) / cols), 2) AS last_col, round(abs(radians((bottom - top) / n)), 4) AS row_step FROM p
UNION ALL SELECT '64', 64, 870, round(radians(2), 3), round(radians(-8.87 - 16 * 31e0 / 32), 2), round(radians(-180), 3), round(radians(-180 + 360e0 * 869 / 870), 2), round(radians(10.5e0 / 32), 4)""")
def sensor_presets(spark, sf_dir):
    """Size and angles of the sensors that are built in."""
    made = {"16": Sensor.vlp_16(), "32": Sensor.hdl_32(), "64": Sensor.hdl_64(), "64 equal": Sensor.hdl_64_equal(), "sphere": Sensor.full_sphere(1.0)}
    rows = [(k, s.rows, s.cols, s.angle_from_row(0), s.angle_from_row(s.rows - 1), s.angle_from_col(0), s.angle_from_col(s.cols - 1), s.row_alphas[0]) for k, s in made.items()]
    df = spark.createDataFrame(rows, "name string, n_rows int, n_cols int, first_row double, last_row double, first_col double, last_col double, row_step double")
    digits = {"first_row": 3, "last_row": 2, "first_col": 3, "last_col": 2, "row_step": 4}
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


@register(PX + ", fix(k, v) AS (VALUES " + ", ".join(f"({k}, {_num(v)})" for k, v in enumerate(CORRECTIONS_64[:ROWS])) + f""") SELECT frame_id, "row", col, {r("depth - v")} AS depth FROM px JOIN fix ON k = "row" """)
def correct_pixels(spark, sf_dir):
    """The sensor's own error of each row taken off a projected image."""
    return rounded(project.correct(px(spark, sf_dir).select("frame_id", "row", "col", "depth"), replace(SENSOR, corrections=CORRECTIONS_64[:ROWS])), "depth")


@register(
    f"""WITH t AS (SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, CAST((s_suppkey % 31) * 0.2 - 3.0 AS DOUBLE) AS a, CAST((s_suppkey % 7) * 0.1 AS DOUBLE) AS p FROM supplier)
SELECT s_suppkey, x, y, 2.0e0 AS z, {r("a")} AS theta, {r("cos(p)")} AS pitch_00, {r("0 - sin(p)")} AS pitch_02, {r("0 - x")} AS back_x, {r("0 - y")} AS back_y, 1.0e0 AS back_00 FROM t"""
)
def pose_setters(spark, sf_dir):
    """Position, heading and pitch set one by one and read back; a pose negated."""
    rows = table(spark, sf_dir, "supplier")
    own = pose.with_theta(pose.with_position(pose.identity(), F.col("s_suppkey").cast("double"), F.col("s_nationkey").cast("double"), 2.0), F.expr("cast((s_suppkey % 31) * 0.2 - 3.0 as double)"))
    rows = rows.select("s_suppkey", own.alias("p"), F.expr("cast((s_suppkey % 7) * 0.1 as double)").alias("pitch"))
    rows = rows.select("s_suppkey", pose.position(F.col("p")).alias("at"), pose.theta(F.col("p")).alias("theta"), pose.with_pitch(F.col("p"), F.col("pitch")).alias("q"), pose.negated(F.col("p")).alias("n"))
    entry = lambda c, k: F.get(c, F.lit(k))
    out = rows.select("s_suppkey", "at.x", "at.y", "at.z", "theta", entry("q", 0).alias("pitch_00"), entry("q", 2).alias("pitch_02"), entry("n", 3).alias("back_x"), entry("n", 7).alias("back_y"), entry("n", 0).alias("back_00"))
    return rounded(out, "theta", "pitch_00", "pitch_02", "back_x", "back_y")


@register(
    f"""WITH q AS (SELECT event_id, CAST((event_id % 13) * 0.2 AS DOUBLE) AS a, CAST(event_id AS DOUBLE) AS x FROM events)
SELECT event_id, {r("cos(a)")} AS e00, {r("0 - sin(a)")} AS e01, {r("sin(a)")} AS e10, x, 1.0e0 AS e22 FROM q"""
)
def odometry_poses(spark, sf_dir):
    """Poses of odometry messages: a unit quaternion about the upright axis and a position."""
    half = F.expr("cast((event_id % 13) * 0.2 as double)") / 2
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "events").select("event_id", odometry_pose(zero, zero, F.sin(half), F.cos(half), F.col("event_id").cast("double"), zero, zero).alias("p"))
    entry = lambda k: F.get("p", F.lit(k))
    return rounded(rows.select("event_id", entry(0).alias("e00"), entry(1).alias("e01"), entry(4).alias("e10"), entry(3).alias("x"), entry(10).alias("e22")), "e00", "e01", "e10")


_MOVED = {"x": "cos(frame_id * 0.1) * {0}_x - sin(frame_id * 0.1) * {0}_y + frame_id", "y": "sin(frame_id * 0.1) * {0}_x + cos(frame_id * 0.1) * {0}_y - 1", "z": "{0}_z"}


@register(BOXES + ", moved AS (SELECT frame_id, label, " + ", ".join(f"{f}({e.format('min')}, {e.format('max')}) AS {n}_{c}" for n, f in (("min", "least"), ("max", "greatest")) for c, e in _MOVED.items()) + f" FROM boxes), shaped AS (SELECT *, {_SHAPE} FROM moved) SELECT frame_id, label, " + ", ".join(f"{r(c)} AS {c}" for c in BOX_COLUMNS) + " FROM shaped")
def box_moved(spark, sf_dir):
    boxes = objects.bboxes(_clusters(spark, sf_dir)).drop("n_points")
    moved = objects.move_box(boxes, pose.planar(F.col("frame_id").cast("double"), -1.0, F.col("frame_id") * 0.1))
    return rounded(moved.select("frame_id", "label", *BOX_COLUMNS), *BOX_COLUMNS)


@register(PX + ' SELECT frame_id, "row", col, depth FROM px WHERE depth > 10')
def stream_share(spark, sf_dir):
    """Frames replayed as a stream through a pipeline, whose sink writes what it gets; a removed sink gets nothing."""
    folder = shared_folder(spark, "stream")
    frames = px(spark, sf_dir).select("frame_id", "row", "col", "depth")
    frames.repartition(4, "frame_id").write.parquet(f"{folder}/frames")
    flow = Pipeline(lambda rows: rows.where("depth > 10"))
    removed = flow.add_sink(lambda rows, batch: rows.write.mode("append").parquet(f"{folder}/shared"))
    flow.add_sink(lambda rows, batch: rows.write.mode("append").parquet(f"{folder}/shared"))
    flow.remove_sink(removed)
    flow.start(replay(spark, f"{folder}/frames", frames.schema), f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(frames.schema).parquet(f"{folder}/shared")
