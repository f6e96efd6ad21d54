"""Vectors (structs x, y, z), 3x3 matrices and image orientation as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.convert import fuzzy_equal as number_fuzzy_equal

Number = Column | float | int


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class Vec(dict):
    """Three component Columns.  Steps of arithmetic stay apart from structs, whose fields would carry all three along."""


Vector = Column | Vec


def vector(x: Number, y: Number, z: Number) -> Vec:
    return Vec(x=_c(x), y=_c(y), z=_c(z))


def struct(v: Vector) -> Column:
    """A struct column of a vector."""
    return F.struct(*[v[k].alias(k) for k in "xyz"]) if isinstance(v, Vec) else v


def each(f, *vectors: Vector) -> Vec:
    """f over the components of some vectors."""
    return vector(*[f(*[v[k] for v in vectors]) for k in "xyz"])


def add(a: Vector, b: Vector) -> Vec:
    return each(lambda x, y: x + y, a, b)


def subtract(a: Vector, b: Vector) -> Vec:
    return each(lambda x, y: x - y, a, b)


def scaled(a: Vector, k: Number) -> Vec:
    return each(lambda x: x * _c(k), a)


def negated(a: Vector) -> Vec:
    return each(lambda x: -x, a)


def dot(a: Vector, b: Vector) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Vector, b: Vector) -> Vec:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def square_length(a: Vector) -> Column:
    return dot(a, a)


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Vector, zero: Vector | None = None) -> Vec:
    """Unit vector; a zero vector gives ``zero`` (null by default)."""
    n = length(a)
    if zero is None:
        return each(lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0.0))), a)
    return each(lambda x, o: F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(o), a, zero)


def product(a: Vector) -> Column:
    return a["x"] * a["y"] * a["z"]


def total(a: Vector) -> Column:
    return a["x"] + a["y"] + a["z"]


def lexical_key(a: Vector) -> list[Column]:
    """Sort columns: the last component counts most."""
    return [a["z"], a["y"], a["x"]]


def largest_component(a: Vector) -> Column:
    """Index of the component that is largest in size; of equals the first."""
    x, y, z = F.abs(a["x"]), F.abs(a["y"]), F.abs(a["z"])
    return F.when((x >= y) & (x >= z), 0).when(y >= z, 1).otherwise(2)


Matrix = tuple[Vec, Vec, Vec]  # rows


def matrix(rows: list[list[float]]) -> Matrix:
    return tuple(vector(*r) for r in rows)  # type: ignore[return-value]


def from_columns(a: Vector, b: Vector, c: Column) -> Matrix:
    return tuple(vector(a[k], b[k], c[k]) for k in "xyz")  # type: ignore[return-value]


def transposed(m: Matrix) -> Matrix:
    return from_columns(*m)


def apply(m: Matrix, v: Vector) -> Vec:
    return vector(*[dot(r, v) for r in m])


def multiply(a: Matrix, b: Matrix) -> Matrix:
    columns = [vector(*[r[k] for r in b]) for k in "xyz"]
    return tuple(vector(*[dot(r, c) for c in columns]) for r in a)  # type: ignore[return-value]


def determinant(m: Matrix) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inverse(m: Matrix) -> Matrix:
    """Closed form; components are null where the matrix is singular."""
    d = F.nullif(determinant(m), F.lit(0.0))
    a, b, c = cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])
    return from_columns(*[scaled(v, F.lit(1.0) / d) for v in (a, b, c)])


def spacing(size: Vector, gap: Vector | None = None) -> Vec:
    """Voxel size and gap together; 0 counts as 1."""
    both = add(size, gap) if gap is not None else size
    return each(lambda x: F.when(x == 0, 1.0).otherwise(x), both)


def orientation(row: Vector, column: Vector, slice_: Vector, step: Vector) -> Matrix:
    """Columns are the direction vectors times the spacing along them."""
    return from_columns(scaled(row, step["x"]), scaled(column, step["y"]), scaled(slice_, step["z"]))


def index_to_physical(m: Matrix, origin: Vector, index: Vector) -> Vec:
    return add(apply(m, index), origin)


def physical_to_index(inverse_m: Matrix, origin: Vector, place: Vector) -> Column:
    """Nearest voxel, half away from zero."""
    raw = apply(inverse_m, subtract(place, origin))
    near = lambda x: F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)).cast("int")
    return F.struct(*[near(raw[k]).alias(k) for k in "xyz"])


def transform_about_origin(t: Matrix, origin: Vector, r: Matrix) -> tuple[Vec, Matrix]:
    """Origin and orientation after a transform of physical space."""
    return apply(t, origin), multiply(t, r)


def transform_about_center(t: Matrix, origin: Vector, r: Matrix, dims: tuple[Column, Column, Column], step: Vector) -> tuple[Vec, Matrix]:
    """Origin and orientation after a transform of the image's own axes about its center."""
    half = vector(*[(n * step[k] - step[k]) * 0.5 for n, k in zip(dims, "xyz")])
    center = add(apply(r, half), origin)
    local = apply(inverse(r), subtract(origin, center))
    return add(apply(r, apply(transposed(t), local)), center), multiply(r, t)


def main_orientation(row: Vector, column: Vector) -> Column:
    """Name of the axis the image plane stands on, within 45 degrees; ``reversed_`` if it points the other way."""
    n = cross(normalized(row), normalized(column))
    angle = {k: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n[k]))) / math.pi for k in "xyz"}
    folded = {k: F.when(a > 0.5, F.abs(a - 1)).otherwise(a) for k, a in angle.items()}
    out = F.lit(None).cast("string")
    for k, name in reversed((("z", "axial"), ("x", "sagittal"), ("y", "coronal"))):
        out = F.when(folded[k] <= 0.25, F.when(angle[k] > 0.5, f"reversed_{name}").otherwise(name)).otherwise(out)
    return out


def image_dimension_of_axis(row: Vector, column: Vector, slice_: Vector, axis: str) -> Column:
    """Which image dimension (0, 1, 2) runs most along a scanner axis (x, y or z)."""
    return largest_component(vector(row[axis], column[axis], slice_[axis]))


def flipped_geometry(origin: Vector, direction: Vector, step: Vector, count: Column) -> tuple[Vec, Vec]:
    """Origin and direction after the axis is walked from its other end."""
    return add(origin, scaled(direction, step * (count - 1))), negated(direction)


def quaternion_to_matrix(b: Vector, c: Column, d: Column, qfac: Column) -> Matrix:
    """Rotation of a unit quaternion whose real part follows from the others; ``qfac`` -1 turns the third axis."""
    a = F.sqrt(F.greatest(F.lit(0.0), 1 - (b * b + c * c + d * d)))
    q = F.when(qfac < 0, -1.0).otherwise(1.0)
    return (
        vector(a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c) * q),
        vector(2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b) * q),
        vector(2 * (b * d - a * c), 2 * (c * d + a * b), (a * a + d * d - b * b - c * c) * q),
    )


def matrix_to_quaternion(m: Matrix) -> Column:
    """struct<b, c, d, qfac> of an orthonormal matrix."""
    q = F.when(determinant(m) < 0, -1.0).otherwise(1.0)
    (r00, r01, r02), (r10, r11, r12), (r20, r21, r22) = [[r["x"], r["y"], r["z"] * q] for r in m]
    trace = r00 + r11 + r22 + 1
    sizes = {"b": 1 + r00 - r11 - r22, "c": 1 + r11 - r00 - r22, "d": 1 + r22 - r00 - r11}
    root = lambda x: F.sqrt(F.greatest(x, F.lit(1e-300)))
    a = 0.5 * root(trace)
    by_a = (0.25 * (r21 - r12) / a, 0.25 * (r02 - r20) / a, 0.25 * (r10 - r01) / a)
    b = 0.5 * root(sizes["b"])
    by_b = (b, 0.25 * (r01 + r10) / b, 0.25 * (r02 + r20) / b, 0.25 * (r21 - r12) / b)
    c = 0.5 * root(sizes["c"])
    by_c = (0.25 * (r01 + r10) / c, c, 0.25 * (r12 + r21) / c, 0.25 * (r02 - r20) / c)
    d = 0.5 * root(sizes["d"])
    by_d = (0.25 * (r02 + r20) / d, 0.25 * (r12 + r21) / d, d, 0.25 * (r10 - r01) / d)
    sign = lambda parts: [F.when(parts[3] < 0, -p).otherwise(p) for p in parts[:3]]
    picks = [by_a, sign(by_b), sign(by_c), sign(by_d)]
    choose = lambda i: F.when(trace > 0.5, picks[0][i]).when(sizes["b"] > 1, picks[1][i]).when(sizes["c"] > 1, picks[2][i]).otherwise(picks[3][i])
    return F.struct(choose(0).alias("b"), choose(1).alias("c"), choose(2).alias("d"), q.alias("qfac"))


def least(a: Vector, b: Vector) -> Vec:
    """The smaller of each component."""
    return each(F.least, a, b)


def greatest(a: Vector, b: Vector) -> Vec:
    """The larger of each component."""
    return each(F.greatest, a, b)


def fuzzy_equal(a: Vector, b: Vector, scale: int = 1, single: bool = True) -> Column:
    """Whether all components are apart by no more than ``scale`` rounding steps; other than for numbers, signs count."""
    near = [(a[k] * b[k] >= 0) & number_fuzzy_equal(_c(a[k]), _c(b[k]), scale, single) for k in "xyz"]
    return near[0] & near[1] & near[2]
