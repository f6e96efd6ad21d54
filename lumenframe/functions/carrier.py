"""Typed voxels of any logical type in one column: a struct of arrays, of which the one that fits the type is there.

``whole`` holds integers up to 64 bits with sign, ``big`` unsigned 64-bit ones, ``real`` floats and doubles, ``color`` three channels, ``complex``
two parts.  So 64-bit numbers keep all their digits and colours stay one voxel each.  All functions are Columns; the type of a chunk is in its ``type_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import scaling as S
from lumenframe.functions.types import LogicalType, of

FIELDS = {
    "whole": "bigint",
    "big": "decimal(20,0)",
    "real": "double",
    "color": "struct<r:int,g:int,b:int>",
    "complex": "struct<re:double,im:double>",
}
SCHEMA = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in FIELDS.items()) + ">"


def field_of(t: str | LogicalType) -> str:
    """The field that holds a type's voxels."""
    t = of(t)
    if t.kind in ("color", "complex"):
        return t.kind
    if t.kind == "real":
        return "real"
    if t.kind in ("integer", "bool"):
        return "big" if t.name == "u64bit" else "whole"
    raise ValueError(f"there are no voxels of type {t.name}")


def hold(values: Column, t: str | LogicalType) -> Column:
    """An array of a type's values as typed voxels."""
    own = field_of(t)
    empty = {n: F.lit(None).cast(f"array<{k}>") for n, k in FIELDS.items()}
    cast = F.transform(values, lambda x: x.cast("int").cast("bigint") if of(t).kind == "bool" else x.cast(FIELDS[own]))
    return F.struct(*[(cast if n == own else empty[n]).alias(n) for n in FIELDS])


def values(voxels: Column, t: str | LogicalType) -> Column:
    """The array of a type's values; null for chunks of a type with another field."""
    return voxels[field_of(t)]


def each(voxels: Column, f: Callable[[Column], Column]) -> Column:
    """f on the array that is there; it must give an array of the same elements."""
    return F.struct(*[F.when(voxels[n].isNotNull(), f(voxels[n])).alias(n) for n in FIELDS])


def size(voxels: Column) -> Column:
    return F.coalesce(*[F.when(voxels[n].isNotNull(), F.size(voxels[n])) for n in FIELDS])


def flip(voxels: Column, dims: Column, axis: str) -> Column:
    return each(voxels, lambda v: A.flip(v, dims, axis))


def splice(voxels: Column, block: Column) -> Column:
    """Blocks of ``block`` voxels, each with the same fields."""
    n = F.ceil(size(voxels) / block).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: each(voxels, lambda v: F.slice(v, i * block + 1, block)))


def gathered(chunks: Column) -> Column:
    """Typed voxels of one field, an array of them in order, as one."""
    return F.struct(*[F.when(F.exists(chunks, lambda c: c[n].isNotNull()), F.flatten(F.transform(F.filter(chunks, lambda c: c[n].isNotNull()), lambda c: c[n]))).alias(n) for n in FIELDS])


def value_range(voxels: Column) -> Column:
    """struct<low, high> as decimals, exact for whole numbers of 64 bits, over the finite values; of colours over all channels.  Null for complex ones."""
    limits = F.lit(None).cast("struct<low:decimal(38,10),high:decimal(38,10)>")
    exact = lambda v: F.when(F.size(v) > 0, F.struct(F.array_min(v).cast("decimal(38,10)").alias("low"), F.array_max(v).cast("decimal(38,10)").alias("high")))
    real = S.finite_values(voxels["real"])
    near = F.when(F.size(real) > 0, F.struct(F.array_min(real).try_cast("decimal(38,10)").alias("low"), F.array_max(real).try_cast("decimal(38,10)").alias("high")))
    channels = F.flatten(F.transform(voxels["color"], lambda x: F.array(x["r"], x["g"], x["b"])))
    return F.coalesce(exact(voxels["whole"]), exact(voxels["big"]), near, exact(channels), limits)


def _number(x: Column, source: LogicalType, target: LogicalType, scale: Column | None, offset: Column | None) -> Column:
    """One number in another type.  Whole numbers without a scaling never pass through a double; what doesn't fit is null."""
    if target.kind == "bool":
        return (x != 0).cast("bigint")
    whole = source.is_integer or source.kind in ("bool", "color")
    if not (target.is_integer or target.kind == "color"):
        y = x.cast("double") if scale is None else x.cast("double") * scale + offset
        return y.cast("float").cast("double") if target.bytes and target.name in ("float", "complex_float") else y
    low, high = (F.lit(str(v)).cast("decimal(20,0)") for v in (target.low, target.high))
    fits = lambda y: F.when((y >= low) & (y <= high), y)
    plain = fits(x.cast("decimal(20,0)")) if whole else fits(S.round_away(x.cast("double")).try_cast("decimal(20,0)"))
    if scale is None:
        return plain
    scaled = fits(S.round_away(x.cast("double") * scale + offset).try_cast("decimal(20,0)"))
    return F.when((scale == 1) & (offset == 0), plain).otherwise(scaled)


def converted(voxels: Column, source: str | LogicalType, target: str | LogicalType, scale: Column | None = None, offset: Column | None = None) -> Column:
    """Typed voxels of one type in another: numbers to numbers, complex ones (without an imaginary part) or grey colours, colours to colours, complex to complex.

    Colours and complex numbers don't become numbers.  Each channel of a colour has the same scaling; complex numbers have none.
    """
    s, t = of(source), of(target)
    if s == t:
        return voxels
    if s.kind == t.kind == "color":
        one = lambda x: F.struct(*[_number(x[k], s, t, scale, offset).cast("int").alias(k) for k in "rgb"])
    elif s.kind == t.kind == "complex":
        part = (lambda y: y.cast("float").cast("double")) if t.name == "complex_float" else (lambda y: y)
        one = lambda x: F.struct(*[part(x[k]).alias(k) for k in ("re", "im")])
    elif s.is_number and t.kind == "complex":
        one = lambda x: F.struct(_number(x, s, t, scale, offset).alias("re"), F.lit(0.0).alias("im"))
    elif s.is_number and t.kind == "color":
        one = lambda x: F.struct(*[_number(x, s, t, scale, offset).cast("int").alias(k) for k in "rgb"])
    elif s.is_number and t.is_number:
        one = lambda x: _number(x, s, t, scale, offset)
    else:
        raise ValueError(f"{s.name} doesn't become {t.name}")
    return hold(F.transform(values(voxels, s), one), t)


def text_of(voxels: Column, t: str | LogicalType) -> Column:
    """``n#a|b|c``; a colour is ``{r,g,b}``, a complex number ``(re,im)``."""
    v = values(voxels, t)
    kind = of(t).kind
    if kind == "color":
        v = F.transform(v, lambda x: F.concat(F.lit("{"), F.concat_ws(",", x["r"], x["g"], x["b"]), F.lit("}")))
    elif kind == "complex":
        v = F.transform(v, lambda x: F.concat(F.lit("("), F.concat_ws(",", x["re"], x["im"]), F.lit(")")))
    return A.text_of(v)
