"""Planar expressions: distances, scales and the position on a Hilbert curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import as_col

HILBERT_BITS = 16
HILBERT_MAX = (1 << HILBERT_BITS) - 1


def distance_2d(x1, y1, x2, y2) -> Column:
    return F.hypot(as_col(x2) - as_col(x1), as_col(y2) - as_col(y1))


def axis_distance(value, low, high) -> Column:
    """Distance of a value to an interval, 0 inside."""
    v, lo, hi = as_col(value), as_col(low), as_col(high)
    return F.greatest(lo - v, F.lit(0.0), v - hi)


def linear_scale(value, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Map [low, high] onto [to_low, to_high]; swap the target to invert an axis.

    A domain of width zero counts as width one.
    """
    width = float(high) - float(low) or 1.0
    return F.lit(float(to_low)) + (as_col(value) - float(low)) * (float(to_high) - float(to_low)) / width


def hilbert(x, y) -> Column:
    """Position of integer (x, y), 16 bits each, on the Hilbert curve.

    The curve starts at (0, 0), climbs the y axis first and ends at
    (65535, 0). One fold over the bits, high to low: each step adds the
    quadrant's share and turns the remaining square.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("d"),
        as_col(x).cast("long").alias("x"),
        as_col(y).cast("long").alias("y"),
    )

    def step(acc: Column, level: Column) -> Column:
        side = F.pow(F.lit(2.0), level).cast("long")
        px, py = acc["x"], acc["y"]
        right, upper = px >= side, py >= side
        share = F.when(right, F.when(upper, 2).otherwise(3)).otherwise(F.when(upper, 1).otherwise(0))
        lx, ly = px % side, py % side  # position inside the quadrant
        turned_x = F.when(upper, lx).when(right, side - 1 - ly).otherwise(ly)
        turned_y = F.when(upper, ly).when(right, side - 1 - lx).otherwise(lx)
        return F.struct(
            (acc["d"] + side * side * share).alias("d"),
            turned_x.alias("x"),
            turned_y.alias("y"),
        )

    levels = F.sequence(F.lit(HILBERT_BITS - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, step, lambda acc: acc["d"])


def hilbert_cell(value, low: float, high: float) -> Column:
    """A coordinate on the 16-bit grid over [low, high]."""
    width = float(high) - float(low) or 1.0
    return F.floor(F.lit(float(HILBERT_MAX)) * (as_col(value) - float(low)) / width)
