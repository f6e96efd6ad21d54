"""Operations on dense arrays: one array column, first index fastest, with a dims struct<c, r, s, t>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("c", "r", "s", "t")


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once: inside lambdas a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def volume(dims: Column) -> Column:
    return dims["c"].cast("long") * dims["r"] * dims["s"] * dims["t"]


def linear_index(dims: Column, x: Column, y: Column, z: Column, t: Column) -> Column:
    return x.cast("long") + dims["c"] * (y + dims["r"].cast("long") * (z + dims["s"].cast("long") * t))


def coordinates(dims: Column, index: Column) -> Column:
    """struct<x, y, z, t> of a linear index."""
    c, r, s = (dims[a].cast("long") for a in "crs")
    div = lambda a, b: F.floor(a / b).cast("long")
    return F.struct((index % c).alias("x"), (div(index, c) % r).alias("y"), (div(index, c * r) % s).alias("z"), div(index, c * r * s).alias("t"))


def in_range(dims: Column, x: Column, y: Column, z: Column, t: Column) -> Column:
    inside = F.lit(True)
    for a, v in zip(AXES, (x, y, z, t)):
        inside = inside & (v >= 0) & (v < dims[a])
    return inside


def relevant_dims(dims: Column) -> Column:
    """Number of the highest dimension longer than 1 (0 if none is)."""
    return F.when(dims["t"] > 1, 4).when(dims["s"] > 1, 3).when(dims["r"] > 1, 2).when(dims["c"] > 1, 1).otherwise(0)


def field_of_view(dims: Column, size: Column, gap: Column | None = None) -> Column:
    """struct<x, y, z>: voxel size times count, and the gaps between; an unknown gap counts as none."""
    parts = []
    for a, f in zip("crs", "xyz"):
        extra = F.coalesce(gap[f], F.lit(0.0)) * (dims[a] - 1) if gap is not None else F.lit(0.0)
        parts.append((size[f] * dims[a] + extra).alias(f))
    return F.struct(*parts)


def splice(values: Column, block: int | Column) -> Column:
    """Blocks of ``block`` elements; the last may be shorter."""
    b = F.lit(block) if isinstance(block, int) else block
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), b)).otherwise(F.array().cast("array<int>"))
    return bind(values, lambda v: F.transform(starts, lambda i: F.slice(v, i, b)))


def copy_range(target: Column, source: Column, source_start: Column, source_end: Column, at: Column) -> Column:
    """``target`` with elements source_start..source_end (both included, from 0) of ``source`` put at ``at``."""
    n = source_end - source_start + 1
    return F.concat(F.slice(target, F.lit(1), at), F.slice(source, source_start + 1, n), F.slice(target, at + n + 1, F.greatest(F.size(target) - at - n, F.lit(0))))


def copy_slice(values: Column, dims: Column, z: Column, t: Column) -> Column:
    """One slice of a chunk."""
    n = dims["c"] * dims["r"]
    return F.slice(values, (n * (z + dims["s"] * t) + 1).cast("int"), n)


def flip(values: Column, dims: Column, axis: str) -> Column:
    """Mirrored along one axis (c, r, s or t)."""
    k = AXES.index(axis)
    below = F.lit(1)
    for a in AXES[:k]:
        below = below * dims[a]
    n = dims[axis]
    here = lambda i: F.floor(i / below).cast("int") % n
    return bind(values, lambda v: F.transform(v, lambda _, i: F.get(v, (i + below * (n - 1 - 2 * here(i))).cast("int"))))


def count_different(a: Column, b: Column) -> Column:
    """Elements that differ; arrays of unequal length differ in all elements of the longer."""
    unequal = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    return F.when(F.size(a) == F.size(b), unequal).otherwise(F.greatest(F.size(a), F.size(b)))


def text_of(values: Column) -> Column:
    """``n#a|b|c``."""
    return F.concat(F.size(values).cast("string"), F.lit("#"), F.array_join(F.transform(values, lambda x: x.cast("string")), "|"))


def get_voxel(values: Column, dims: Column, x: Column, y: Column, z: Column, t: Column) -> Column:
    """The element at a place; null outside."""
    return F.when(in_range(dims, x, y, z, t), F.get(values, linear_index(dims, x, y, z, t).cast("int")))


def set_voxel(values: Column, index: Column, value: Column) -> Column:
    return F.transform(values, lambda x, i: F.when(i == index, value).otherwise(x))


def map_voxels(values: Column, dims: Column, f) -> Column:
    """f(value, x, y, z, t) on every element, with its place."""
    div = lambda a, b: F.floor(a / b).cast("int")
    c, r, s = dims["c"], dims["r"], dims["s"]
    return F.transform(values, lambda v, i: f(v, i % c, div(i, c) % r, div(i, c * r) % s, div(i, c * r * s)))


def zeros(n: int | Column, kind: str = "double") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), n)


def swap_bytes(x: Column, width: int) -> Column:
    """An integer with its ``width`` bytes in reverse order, as a signed number of that width."""
    word = F.lpad(F.substring(F.hex(x.cast("bigint")), -2 * width, 2 * width), 2 * width, "0") if width < 8 else F.lpad(F.hex(x.cast("bigint")), 16, "0")
    swapped = F.concat(*[F.substring(word, 2 * k + 1, 2) for k in reversed(range(width))])
    value = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    half, whole = (F.lit(str(1 << (8 * width - k))).cast("decimal(20,0)") for k in (1, 0))
    return F.when(value >= half, value - whole).otherwise(value).cast("bigint")


def unpack_bits(byte: Column) -> Column:
    """The eight bits of a byte, most significant first."""
    return F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.floor(byte / F.pow(F.lit(2.0), k)).cast("int") % 2)


def pack_bits(bits: Column) -> Column:
    """Bytes of eight bits each, most significant first; a last short group is filled up with 0."""
    return F.transform(splice(bits, 8), lambda g: F.aggregate(F.concat(g, F.array_repeat(F.lit(0), F.lit(8) - F.size(g))), F.lit(0), lambda a, b: a * 2 + b))


def spliced_property(values: Column, parts: Column, at: Column) -> Column:
    """What part ``at`` of ``parts`` gets of a list-valued property: one value if they divide evenly, else null."""
    stride = F.size(values) / parts
    return F.when(F.size(values) % parts == 0, F.slice(values, (at * stride + 1).cast("int"), stride.cast("int")))
