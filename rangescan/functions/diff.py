"""Differences of neighbouring pixels: one definition each, for columns and for numpy arrays alike.

A difference is a value for a pair of depths and the angle between their beams, and a test of that
value against a threshold that says whether the pixels belong together. Register others with
``DIFFS[name] = Diff(...)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import functions as F


class ColumnMath:
    greatest, least, atan2, sin, cos, abs = map(staticmethod, (F.greatest, F.least, F.atan2, F.sin, F.cos, F.abs))


class ArrayMath:
    greatest, least, atan2, sin, cos, abs = map(staticmethod, (np.maximum, np.minimum, np.arctan2, np.sin, np.cos, np.abs))


def _beta(m: Any, a: Any, b: Any, alpha: Any) -> Any:
    """Angle at the farther of two points, between its beam and the line to the nearer point."""
    far, near = m.greatest(a, b), m.least(a, b)
    return m.abs(m.atan2(near * m.sin(alpha), far - near * m.cos(alpha)))


@dataclass(frozen=True)
class Diff:
    name: str
    #: (math, first, second, alpha) -> value
    of: Callable[[Any, Any, Any, Any], Any]
    #: neighbours belong together above the threshold; else below it
    above: bool

    def value(self, a: Any, b: Any, alpha: Any, m: Any = ColumnMath) -> Any:
        return self.of(m, a, b, alpha)

    def satisfied(self, value: Any, threshold: float) -> Any:
        return value > threshold if self.above else value < threshold


DIFFS = {
    "simple": Diff("simple", lambda m, a, b, alpha: m.abs(a - b), above=False),
    "angle": Diff("angle", _beta, above=True),
    "line_dist": Diff("line_dist", lambda m, a, b, alpha: m.greatest(a, b) * m.sin(_beta(m, a, b, alpha)), above=True),
}
#: The precomputed kinds differ only in when values are made: the edge table is what they keep.
ALIASES = {"angle_precomputed": "angle", "line_dist_precomputed": "line_dist"}


def diff(name: str) -> Diff:
    name = ALIASES.get(name, name)
    if name not in DIFFS:
        raise ValueError(f"no difference named {name!r}")
    return DIFFS[name]
