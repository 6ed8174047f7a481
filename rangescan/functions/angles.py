"""Angles as double columns in radians; degrees only at the edges."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of comparisons: float32 machine epsilon.
EPSILON = 2.0**-23


def normalize(angle: Column, low: float = 0.0, high: float = 2 * math.pi) -> Column:
    """Shift by whole spans into [low, high]; both ends are closed, so an angle inside stays as it is."""
    span = high - low
    turns = F.when(angle > high, -F.ceil((angle - high) / span)).when(angle < low, F.ceil((low - angle) / span)).otherwise(F.lit(0))
    return angle + turns * span


def less(a: Column, b: Column) -> Column:
    return a < b - EPSILON


def greater(a: Column, b: Column) -> Column:
    return a > b + EPSILON


def floor_degrees(angle: Column) -> Column:
    """Floor to a whole degree."""
    return F.radians(F.floor(F.degrees(angle)).cast("double"))
