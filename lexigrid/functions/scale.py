"""Scales, labels and colours of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def log_scale(v: Column, most: Column) -> Column:
    """log1p of a value over log1p of the greatest; 0 unless both are positive."""
    return F.when((v <= 0) | (most <= 0), F.lit(0.0)).otherwise(F.log1p(v) / F.log1p(most))


def ratio_scale(v: Column, kind: str = "linear") -> Column:
    """A ratio from 0 to 1 as ``linear``, ``sqrt`` or ``log`` (four decades); 0 if not positive."""
    scaled = {"linear": v, "sqrt": F.sqrt(v), "log": F.greatest((F.log10(F.greatest(v, F.lit(0.0001))) + 4) / 4, F.lit(0.0))}[kind]
    return F.when(v <= 0, F.lit(0.0)).otherwise(scaled)


def _fifth(share: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip((0.2, 0.4, 0.6, 0.8), names, strict=False))):
        out = F.when(share <= bound, name).otherwise(out)
    return out


def region_label(col: Column, row: Column, cols: int, rows: int) -> Column:
    across = _fifth(col / F.lit(cols - 1), ("Left", "Center-Left", "Center", "Center-Right", "Right"))
    down = _fifth(row / F.lit(rows - 1), ("Top", "Upper", "Middle", "Lower", "Bottom"))
    return F.concat(down, F.lit(", "), across)


def cell_pixel(cell: Column, cells: int, most: Column) -> Column:
    """Where a raw grid's cell starts, in pixels."""
    return F.round(cell / F.lit(cells) * most).cast("int")


def ramp(v: Column, stops: list[tuple[float, tuple[int, int, int]]]) -> Column:
    """A colour between stops (place, rgb), linear in each part, as an array of three integers."""
    v = clamp(v, stops[0][0], stops[-1][0])
    out = F.array(*(F.lit(x) for x in stops[-1][1]))
    for (a, low), (b, high) in reversed(list(zip(stops, stops[1:], strict=False))):
        t = (v - a) / (b - a)
        out = F.when(v <= b, F.array(*(F.round(F.lit(float(x)) + t * (y - x)).cast("int") for x, y in zip(low, high, strict=True)))).otherwise(out)
    return out


def signed_ramp(v: Column, below: list, above: list) -> Column:
    """A ramp for each sign of a value from -1 to 1."""
    return F.when(v < 0, ramp(-v, below)).otherwise(ramp(v, above))
