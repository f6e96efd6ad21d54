"""The 27 logical value types and their Spark carriers.

Unsigned types travel in the next wider signed carrier; range checks and scaling use the logical limits.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogicalType:
    id: int
    name: str
    carrier: str
    kind: str  # bool, integer, real, color, vector, list, text, complex, time
    low: int | float | None = None
    high: int | float | None = None
    bytes: int | None = None

    @property
    def is_integer(self) -> bool:
        return self.kind == "integer"

    @property
    def is_number(self) -> bool:
        return self.kind in ("bool", "integer", "real")


def _whole(id_: int, bits: int, signed: bool, carrier: str) -> LogicalType:
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    return LogicalType(id_, f"{'s' if signed else 'u'}{bits}bit", carrier, "integer", low, high, bits // 8)


FLOAT_MAX, DOUBLE_MAX = 3.4028234663852886e38, 1.7976931348623157e308


def _struct(fields: str, of: str) -> str:
    return "struct<" + ",".join(f"{f}:{of}" for f in fields) + ">"


# Numbers, names and element types, in order.
TYPES: tuple[LogicalType, ...] = (
    LogicalType(1, "boolean", "boolean", "bool", 0, 1, 1),
    _whole(2, 8, True, "tinyint"), _whole(3, 8, False, "smallint"),
    _whole(4, 16, True, "smallint"), _whole(5, 16, False, "int"),
    _whole(6, 32, True, "int"), _whole(7, 32, False, "bigint"),
    _whole(8, 64, True, "bigint"), _whole(9, 64, False, "decimal(20,0)"),
    LogicalType(10, "float", "float", "real", -FLOAT_MAX, FLOAT_MAX, 4),
    LogicalType(11, "double", "double", "real", -DOUBLE_MAX, DOUBLE_MAX, 8),
    LogicalType(12, "color24", _struct("rgb", "smallint"), "color", 0, 255, 3),
    LogicalType(13, "color48", _struct("rgb", "int"), "color", 0, 65535, 6),
    LogicalType(14, "fvector3", _struct("xyz", "float"), "vector", bytes=12),
    LogicalType(15, "dvector3", _struct("xyz", "double"), "vector", bytes=24),
    LogicalType(16, "fvector4", _struct("xyzt", "float"), "vector", bytes=16),
    LogicalType(17, "dvector4", _struct("xyzt", "double"), "vector", bytes=32),
    LogicalType(18, "ivector4", _struct("xyzt", "int"), "vector", bytes=16),
    LogicalType(19, "list_int", "array<int>", "list"),
    LogicalType(20, "list_double", "array<double>", "list"),
    LogicalType(21, "list_string", "array<string>", "list"),
    LogicalType(22, "string", "string", "text"),
    LogicalType(23, "selection", "struct<value:string,code:int,entries:array<string>>", "text"),
    LogicalType(24, "complex_float", "struct<re:float,im:float>", "complex", bytes=8),
    LogicalType(25, "complex_double", "struct<re:double,im:double>", "complex", bytes=16),
    LogicalType(26, "timestamp", "timestamp_ntz", "time"),
    LogicalType(27, "date", "date", "time"),
)

BY_NAME = {t.name: t for t in TYPES}
BY_ID = {t.id: t for t in TYPES}


def of(t: str | int | LogicalType) -> LogicalType:
    """A type by name, number or itself."""
    return t if isinstance(t, LogicalType) else BY_ID[t] if isinstance(t, int) else BY_NAME[t]


def array_id(t: str | int | LogicalType) -> int:
    """Number of the array type over an element type."""
    return of(t).id << 8


def type_map(arrays: bool = False) -> dict[int, str]:
    """Numbers and names of all scalar (or array) types."""
    return {array_id(t): f"{t.name}*" for t in TYPES} if arrays else {t.id: t.name for t in TYPES}
