"""Matrices of any size as arrays of rows: product, transpose, inverse, and affine maps.  All functions are Columns.

Unlike ``geometry``, whose 3 x 3 matrices are spelled out, these take their size from the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.arrays import bind


def rows_of(m: Column) -> Column:
    return F.size(m)


def columns_of(m: Column) -> Column:
    return F.size(F.get(m, F.lit(0)))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def literal(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def identity(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(_places(n), lambda i: F.transform(_places(n), lambda j: F.when(i == j, 1.0).otherwise(0.0)))


def element(m: Column, row: Column | int, column: Column | int) -> Column:
    at = lambda i: F.lit(i) if isinstance(i, int) else i
    return F.get(F.get(m, at(row)), at(column))


def transposed(m: Column) -> Column:
    return bind(m, lambda a: F.transform(_places(columns_of(a)), lambda j: F.transform(a, lambda r: F.get(r, j))))


def dot(a: Column, b: Column) -> Column:
    """Of two vectors; null if they aren't equally long."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def apply(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return bind(v, lambda own: F.transform(m, lambda r: dot(r, own)))


def multiply(a: Column, b: Column) -> Column:
    """Matrix times matrix; null if the sizes don't fit."""
    product = bind(transposed(b), lambda t: F.transform(a, lambda r: F.transform(t, lambda c: dot(r, c))))
    return F.when(columns_of(a) == rows_of(b), product)


def chain(*ms: Column) -> Column:
    """The product of several, from the left."""
    out = ms[0]
    for m in ms[1:]:
        out = multiply(out, m)
    return out


def inverse(m: Column) -> Column:
    """By elimination with the largest pivot of each column; null for a singular or non-square matrix."""
    n = rows_of(m)
    start = F.zip_with(m, identity(n), lambda r, e: F.concat(r, e))

    def eliminate(a: Column, k: Column) -> Column:
        size = lambda r: F.abs(F.get(r, k))
        below = F.slice(a, k + 1, F.size(a) - k)
        largest = F.array_max(F.transform(below, size))
        at = k + F.array_position(F.transform(below, size), largest).cast("int") - 1

        def clear(pivot: Column) -> Column:
            scaled = F.transform(pivot, lambda x: x / F.nullif(F.get(pivot, k), F.lit(0.0)))
            swapped = F.transform(a, lambda r, i: F.when(i == at, F.get(a, k)).otherwise(r))
            return bind(scaled, lambda p: F.transform(swapped, lambda r, i: F.when(i == k, p).otherwise(F.zip_with(r, p, lambda x, y: x - F.get(r, k) * y))))

        return F.when(largest > 0, bind(F.get(a, at), clear))

    square = F.forall(m, lambda r: F.size(r) == n) & (n > 0)
    done = F.aggregate(_places(n), F.when(square, start), lambda a, k: F.when(a.isNotNull(), eliminate(a, k)))
    return F.transform(done, lambda r: F.slice(r, n + 1, n))


def affine(m: Column, offset: Column) -> Column:
    """A matrix and an offset as one matrix of one more row and column."""
    last = F.transform(_places(columns_of(m) + 1), lambda j: F.when(j == columns_of(m), 1.0).otherwise(0.0))
    return F.concat(F.zip_with(m, offset, lambda r, x: F.concat(r, F.array(x))), F.array(last))


def map_point(m: Column, point: Column) -> Column:
    """A point under an affine map."""
    return F.slice(apply(m, F.concat(point, F.array(F.lit(1.0)))), F.lit(1), F.size(point))
