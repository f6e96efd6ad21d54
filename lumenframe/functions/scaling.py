"""Value ranges, automatic scaling and conversion of whole arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.types import DOUBLE_MAX, LogicalType, of

MODES = ("noscale", "autoscale", "noupscale", "upscale")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_values(values: Column, kind: str = "double") -> Column:
    """Elements that are neither NaN nor infinite (NaN is the largest value to Spark, so it must go first)."""
    return F.filter(F.transform(values, lambda x: x.cast(kind)), finite)


def array_range(values: Column) -> Column:
    """struct<low, high> over the finite elements; null if there are none."""
    v = finite_values(values)
    return F.when(F.size(v) > 0, F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")))


def channel_range(values: Column, fields: list[str]) -> Column:
    """Box around colours or complex numbers: a struct<low, high> for each field."""
    field = lambda f: F.transform(values, lambda x: x[f])
    return F.struct(*[array_range(field(f)).alias(f) for f in fields])


def image_range(low: Column, high: Column) -> Column:
    """Aggregate of chunk ranges."""
    return F.struct(F.min(low).alias("low"), F.max(high).alias("high"))


def holds_range(low: Column, high: Column, t: LogicalType) -> Column:
    return (low >= float(t.low)) & (high <= float(t.high))


def major_type(low: Column, low_type: Column, high: Column, high_type: Column, candidates: list[str]) -> Column:
    """The type of one extreme that holds the other too; null if neither does."""
    out = F.lit(None).cast("string")
    for name in reversed(candidates):
        t = of(name)
        fits = holds_range(low, high, t)
        out = F.when(((high_type == name) | (low_type == name)) & fits, name).otherwise(out)
    return out


def scaling(low: Column, high: Column, source: str | LogicalType, target: str | LogicalType, mode: str = "autoscale") -> Column:
    """struct<scale, offset> that maps a range into a type.

    Only integer targets are scaled.  The offset moves a range that lies on one side of 0 (or goes to an unsigned
    type) to 0; the scale makes the extreme nearest to its limit reach it; automatic scaling never enlarges integers.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    s, t = of(source), of(target)
    one, zero = F.lit(1.0), F.lit(0.0)
    same = s == t and mode == "autoscale"
    if same or mode == "noscale" or not t.is_integer or s.kind in ("bool", "complex"):
        return F.struct(one.alias("scale"), zero.alias("offset"))
    if mode == "autoscale" and (s.is_integer or s.kind == "color"):
        mode = "noupscale"
    dmin, dmax = float(t.low), float(t.high)
    mn, mx = low.cast("double"), high.cast("double")
    offset = F.when((mn > 0) | F.lit(dmin == 0), -mn).when((mx < 0) | F.lit(dmax == 0), -mx).otherwise(zero)
    largest = F.lit(DOUBLE_MAX)

    def reach(limit: float, value: Column) -> Column:
        ratio = F.when(value != 0, F.lit(limit) / F.nullif(value, zero)).otherwise(largest)
        return F.when(ratio == 0, largest).otherwise(ratio)

    scale = F.least(reach(dmax, mx + offset), reach(dmin, mn + offset))
    if mode == "noupscale":
        scale = F.least(scale, one)
    moved = F.when(scale == 1, F.when((mn > dmin) & (mx < dmax), zero).otherwise(offset)).otherwise(offset * scale)
    return F.struct(scale.alias("scale"), moved.alias("offset"))


def round_away(x: Column) -> Column:
    """Half away from zero, as ties go in array conversion."""
    return F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5))


def convert_value(x: Column, scale: Column, offset: Column, target: str | LogicalType) -> Column:
    t = of(target)
    y = x.cast("double") * scale + offset
    if t.kind == "bool":
        return x != 0
    return round_away(y).try_cast(t.carrier) if t.is_integer else y.cast(t.carrier)


def convert_array(values: Column, target: str | LogicalType, scale: Column | None = None, offset: Column | None = None) -> Column:
    """Every element scaled, moved and rounded; without scale and offset the cheap conversion."""
    t = of(target)
    if scale is None:
        return F.transform(values, lambda x: x != 0 if t.kind == "bool" else round_away(x.cast("double")).try_cast(t.carrier) if t.is_integer else x.cast(t.carrier))
    return F.transform(values, lambda x: convert_value(x, scale, offset, t))


def convert_fields_array(values: Column, fields: list[str], target: str | LogicalType, scale: Column, offset: Column) -> Column:
    """Colours or complex numbers, field by field with one scaling."""
    return F.transform(values, lambda x: F.struct(*[convert_value(x[f], scale, offset, target).alias(f) for f in fields]))
