"""Sensor model: the vertical angle of each row and the horizontal angle of each column of a range image."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slack of angle comparisons: the float32 machine epsilon.
EPSILON = float(np.finfo(np.float32).eps)


def from_degrees(a: float) -> float:
    """Radians, rounded to float32 as angles are stored."""
    return float(np.float32(a * math.pi / 180))


@dataclass(frozen=True)
class Span:
    """A fan of beams from ``start`` to ``end`` (radians), ``step`` apart; ``count`` beams, the end itself left out."""

    start: float
    end: float
    count: int
    step: float

    @classmethod
    def by_step(cls, start: float, end: float, step: float) -> Span:
        return cls(start, end, math.floor((end - start) / step), step)

    @classmethod
    def by_count(cls, start: float, end: float, count: int) -> Span:
        return cls(start, end, count, float(np.float32((end - start) / count)) if count else 0.0)

    @property
    def width(self) -> float:
        return abs(self.end - self.start)

    @property
    def valid(self) -> bool:
        return self.count > 0 and self.step != 0

    def angles(self) -> np.ndarray:
        """Beam angles by repeated float32 addition of the step."""
        if self.count <= 0:
            return np.zeros(0, np.float32)
        parts = np.full(self.count, np.float32(self.step), np.float32)
        parts[0] = np.float32(self.start)
        return np.add.accumulate(parts, dtype=np.float32)


def _degrees(start: float, end: float, count: int) -> Span:
    return Span.by_count(from_degrees(start), from_degrees(end), count)


@dataclass(frozen=True)
class Sensor:
    """Angles of rows and columns in radians; ``corrections`` are per-row depth errors in metres."""

    row_angles: tuple[float, ...]
    col_angles: tuple[float, ...]
    h_width: float
    corrections: tuple[float, ...] = ()

    @classmethod
    def from_spans(cls, vertical: list[Span], horizontal: list[Span], corrections: tuple[float, ...] = ()) -> Sensor:
        if not vertical or not horizontal or not all(s.valid for s in (*vertical, *horizontal)):
            raise ValueError("Projection parameters invalid.")
        rows, cols = (tuple(float(a) for s in spans for a in s.angles()) for spans in (vertical, horizontal))
        return cls(rows, cols, abs(horizontal[-1].end - horizontal[0].start), corrections).checked()

    @classmethod
    def vlp_16(cls) -> Sensor:
        return cls.from_spans([_degrees(15, -15, 16)], [_degrees(-180, 180, 870)])

    @classmethod
    def hdl_32(cls) -> Sensor:
        return cls.from_spans([_degrees(10, -30, 32)], [_degrees(-180, 180, 870)])

    @classmethod
    def hdl_64_equal(cls) -> Sensor:
        return cls.from_spans([_degrees(2, -24, 64)], [_degrees(-180, 180, 870)])

    @classmethod
    def hdl_64(cls) -> Sensor:
        return cls.from_spans([_degrees(2, -8.5, 32), _degrees(-8.87, -24.87, 32)], [_degrees(-180, 180, 870)])

    @classmethod
    def full_sphere(cls, step: float = 5.0) -> Sensor:
        return cls.from_spans([_degrees(-90, 90, round(180 / step))], [_degrees(-180, 180, round(360 / step))])

    @classmethod
    def preset(cls, beams: int) -> Sensor:
        """By number of beams, as the command line gives it: 16, 32 or 64."""
        makers = {16: cls.vlp_16, 32: cls.hdl_32, 64: cls.hdl_64}
        if beams not in makers:
            raise ValueError(f"no sensor with {beams} beams")
        return makers[beams]()

    @classmethod
    def from_config(cls, path: str) -> Sensor:
        """Read ``cols;rows;h_start;h_end;v_1;...;v_n`` in degrees; lines that begin with # are comments.

        Further data lines add their angles. Raises ValueError for a line without a vertical angle and
        for a number of vertical angles other than ``rows``; a missing file is FileNotFoundError.
        """
        rows: list[float] = []
        cols: list[float] = []
        span = None
        with open(path, encoding="utf-8") as f:
            for line in f:
                line = line.rstrip("\n")
                if line.startswith("#"):
                    continue
                fields = line.split(";")
                if len(fields) < 5:
                    raise ValueError("format of line is wrong")
                span = _degrees(float(fields[2]), float(fields[3]), int(fields[0]))
                cols += [float(np.float32(span.start + span.step * c)) for c in range(span.count)]
                rows += [from_degrees(float(x)) for x in fields[4:]]
                if len(rows) != int(fields[1]):
                    raise ValueError("wrong config")
        if span is None:
            raise ValueError("Projection parameters invalid.")
        return cls(tuple(rows), tuple(cols), span.width).checked()

    def checked(self) -> Sensor:
        if not self.row_angles or not self.col_angles:
            raise ValueError("Projection parameters arrays not filled.")
        return self

    @property
    def rows(self) -> int:
        return len(self.row_angles)

    @property
    def cols(self) -> int:
        return len(self.col_angles)

    def angle_from_row(self, row: int) -> float:
        """0 for a row that doesn't exist."""
        return self.row_angles[row] if 0 <= row < self.rows else 0.0

    def angle_from_col(self, col: int) -> float:
        """Columns wrap around once."""
        return self.col_angles[col + self.cols if col < 0 else col - self.cols if col >= self.cols else col]

    @cached_property
    def row_alphas(self) -> tuple[float, ...]:
        """Angle to the next row; 0 for the last."""
        return (*(abs(b - a) for a, b in zip(self.row_angles, self.row_angles[1:], strict=False)), 0.0)

    @cached_property
    def col_alphas(self) -> tuple[float, ...]:
        """Angle to the next column; the last one wraps around."""
        last = abs(abs(self.col_angles[0] - self.col_angles[-1]) - self.h_width)
        return (*(abs(b - a) for a, b in zip(self.col_angles, self.col_angles[1:], strict=False)), last)

    def row_table(self, spark: SparkSession) -> DataFrame:
        """(row, row_angle, row_sin, row_cos, row_alpha, correction): one line a row, small enough to broadcast."""
        fix = self.corrections if len(self.corrections) == self.rows else (0.0,) * self.rows
        lines = [(r, a, math.sin(a), math.cos(a), d, c) for r, (a, d, c) in enumerate(zip(self.row_angles, self.row_alphas, fix, strict=True))]
        return spark.createDataFrame(lines, "row int, row_angle double, row_sin double, row_cos double, row_alpha double, correction double")

    def col_table(self, spark: SparkSession) -> DataFrame:
        lines = [(c, a, math.sin(a), math.cos(a), d) for c, (a, d) in enumerate(zip(self.col_angles, self.col_alphas, strict=True))]
        return spark.createDataFrame(lines, "col int, col_angle double, col_sin double, col_cos double, col_alpha double")


def _closest(angles: tuple[float, ...], angle: Column) -> Column:
    """Index of the nearest angle of a monotonous list; ends are clamped, a tie goes to the smaller index.

    A cell grid as fine as the smallest gap gives a candidate in one step, the next two decide.
    """
    n, up = len(angles), angles[0] < angles[-1]
    sorted_angles = list(angles if up else angles[::-1])
    if n == 1:
        return F.lit(0)
    gap = min(b - a for a, b in zip(sorted_angles, sorted_angles[1:], strict=False))
    low, cells = sorted_angles[0], int((sorted_angles[-1] - sorted_angles[0]) / gap) + 2
    first = (np.searchsorted(sorted_angles, [low + k * gap for k in range(cells)], side="right") - 1).clip(0).tolist()
    cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((angle - low) / gap).cast("int")))
    table, values = F.lit(first), F.lit(sorted_angles)
    start = F.get(table, cell)
    at = lambda k: F.get(values, F.least(F.lit(n - 1), k))
    # the last angle that is not above: the candidate or one of the next two (an angle may lie just off its cell)
    under = start + F.when(at(start + 2) <= angle, 2).when(at(start + 1) <= angle, 1).otherwise(0)
    under = F.greatest(F.lit(0), F.least(F.lit(n - 2), F.when(at(start) > angle, start - 1).otherwise(under)))
    to_low, to_high = F.abs(angle - at(under)), F.abs(at(under + 1) - angle)
    higher = (to_high < to_low) if up else (to_high <= to_low)
    found = under + higher.cast("int")
    return found if up else F.lit(n - 1) - found


def row_of(angle: Column, sensor: Sensor) -> Column:
    return _closest(sensor.row_angles, angle).cast("int")


def col_of(angle: Column, sensor: Sensor) -> Column:
    return _closest(sensor.col_angles, angle).cast("int")
