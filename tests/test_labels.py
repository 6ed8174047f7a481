import math
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangescan.functions.diff import ArrayMath, diff
from rangescan.operators import components
from rangescan.operators.components import written
from rangescan.operators.labels import edge_table, label_grid, label_image, neighbourhood, roots
from rangescan.plans.sensor import Sensor, Span, from_degrees


def square(n):
    span = Span.by_count(from_degrees(0), from_degrees(n), n)
    return Sensor.from_spans([span], [span])


def frame(spark, image):
    return spark.createDataFrame([(0, r, c, float(v)) for (r, c), v in np.ndenumerate(image)], "frame_id long, row int, col int, depth double")


def labels_of(df, shape):
    out = np.zeros(shape, int)
    for x in df.collect():
        out[x.row, x.col] = x.label
    return out.tolist()


MULTI = [[0.5, 1, 0.5, 1, 0.5], [1, 1, 1, 1, 0.5], [0.5, 0.5, 1, 0.5, 0.5], [1, 1, 1, 0.5, 1], [1, 1, 1, 0.5, 1]]
MULTI_LABELS = [[1, 2, 3, 2, 1], [2, 2, 2, 2, 1], [1, 1, 2, 1, 1], [2, 2, 2, 1, 2], [2, 2, 2, 1, 2]]
vertical, horizontal = np.ones((5, 5)), np.ones((5, 5))
vertical[:, 2] = 0.5
horizontal[2] = 0.5
CASES = [
    (np.ones((4, 4)), np.ones((4, 4), int).tolist()),
    (np.add.outer(range(5), range(5)) * 0.1 + 10, np.ones((5, 5), int).tolist()),
    (vertical, [[1, 1, 2, 1, 1]] * 5),
    (horizontal, [[1] * 5] * 2 + [[2] * 5] + [[3] * 5] * 2),
    (np.array(MULTI), MULTI_LABELS),
]


@pytest.mark.parametrize("native", [False, True])
@pytest.mark.parametrize("image,expected", CASES)
def test_known_images(spark, image, expected, native):
    if native and image.shape == (4, 4):
        pytest.skip("one native case of this kind is enough")
    got = label_image(frame(spark, image), square(len(image)), "angle", math.radians(20), native=native)
    assert labels_of(got, image.shape) == expected


def test_neighbourhood_order():
    assert neighbourhood(1, 1) == [(-1, 0), (1, 0), (0, -1), (0, 1)]
    assert neighbourhood(2, 1) == [(-2, 0), (2, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def test_edges_of_equal_depths(spark):
    for kind, value in (("angle", math.pi / 2), ("line_dist", 1.0)):
        rows = edge_table(frame(spark, np.ones((4, 4))), square(4), kind).collect()
        assert len(rows) == 12 + 16
        assert [r["diff"] for r in rows] == pytest.approx([value] * len(rows), abs=0.01)
        assert (3 * 4 + 3, 3 * 4 + 0) in {(r.src, r.dst) for r in rows}  # over the column border


def test_unknown_difference():
    with pytest.raises(ValueError):
        diff("none")
    assert diff("angle_precomputed") is diff("angle")


def flood(depth, sensor, kind, threshold):
    """Labels by the plain search: label a pixel, go on from it unless it is a hole."""
    rows, cols = depth.shape
    labels = np.zeros(depth.shape, int)
    label = 0

    def alpha(a, b):
        if {a[1], b[1]} == {0, cols - 1}:
            return sensor.col_alphas[-1]
        return sensor.row_alphas[min(a[0], b[0])] if a[0] != b[0] else sensor.col_alphas[min(a[1], b[1])]

    for start in np.ndindex(depth.shape):
        if labels[start] or depth[start] < 0.001:
            continue
        label += 1
        queue = deque([start])
        while queue:
            at = queue.popleft()
            if labels[at]:
                continue
            labels[at] = label
            if depth[at] < 0.001:
                continue
            for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                to = (at[0] + dr, (at[1] + dc) % cols)
                if 0 <= to[0] < rows and not labels[to] and kind.satisfied(kind.value(depth[at], depth[to], alpha(at, to), ArrayMath), threshold):
                    queue.append(to)
    return labels


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_set_form_equals_the_search(data):
    rows, cols = data.draw(st.integers(3, 6)), data.draw(st.integers(3, 7))
    depth = np.array(data.draw(st.lists(st.sampled_from([0.0, 1.0, 1.3, 2.0, 5.0]), min_size=rows * cols, max_size=rows * cols))).reshape(rows, cols)
    sensor = Sensor(tuple(math.radians(2 * k) for k in range(rows)), tuple(math.radians(k * 360 / cols) for k in range(cols)), 2 * math.pi)
    name, threshold = data.draw(st.sampled_from([("simple", 0.5), ("simple", 1.1), ("angle", 0.3), ("line_dist", 0.4)]))
    assert label_grid(depth, depth, sensor, diff(name), threshold).tolist() == flood(depth, sensor, diff(name), threshold).tolist()


def test_native_labels_reach_holes(spark):
    image = np.array([[0.0, 1, 5], [5, 5, 5], [9, 9, 0]])
    pixels = frame(spark, image).where("depth > 0")
    want = labels_of(label_image(pixels, square(3), "simple", 1.5), (3, 3))
    assert labels_of(label_image(pixels, square(3), "simple", 1.5, native=True), (3, 3)) == want and want[0][0] == 1


def test_empty_table(spark):
    assert label_image(frame(spark, np.ones((4, 4))).where("depth < 0"), square(4)).count() == 0


def test_native_rounds_shrink(spark, monkeypatch):
    rows, cols = 48, 4  # a snake, the longest way through an image
    image = np.zeros((rows, cols))
    image[::2] = 1
    for k, r in enumerate(range(1, rows, 2)):
        image[r, 2 if k % 2 else 0] = 1
    vertices = [(f, r * cols + c) for f in (0, 1) for r, c in zip(*np.nonzero(image), strict=True)]
    known = set(vertices)
    edges = [(f, v, v + d) for f, v in vertices for d in (1, cols) if (f, v + d) in known and (d > 1 or (v + 1) % cols)]
    edges = [e for e in edges if not (e[0] == 1 and e[2] == 40 * cols + 2)]  # and some not joined in the second frame
    sizes = []

    def counted(df, label):
        out = written(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    ints = lambda t: [tuple(map(int, x)) for x in t]
    got = components.min_labels(spark.createDataFrame(ints(vertices), "frame_id long, id long"), spark.createDataFrame(ints(edges), "frame_id long, src long, dst long"))
    want = {}
    for f in (0, 1):
        own = np.array([e[1:] for e in edges if e[0] == f])
        root = roots(rows * cols, own[:, 0], own[:, 1])
        want |= {(f, int(v)): int(root[v]) for g, v in vertices if g == f}
    assert {(r.frame_id, r.id): r.root for r in got.collect()} == want
    assert sum(sizes) < 6 * len(vertices), sizes  # every round wrote all vertices twice
