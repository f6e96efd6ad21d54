"""What every reader gives and every writer takes: chunk rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

VECTORS = ("indexOrigin", "rowVec", "columnVec", "sliceVec", "voxelSize", "voxelGap")
_V = "struct<x:double,y:double,z:double>"
SCHEMA = (
    "source string, part int, type_id string, dims struct<c:int,r:int,s:int,t:int>, sequenceNumber int, acquisitionNumber bigint, acquisitionTime double, "
    + ", ".join(f"{v} {_V}" for v in VECTORS)
    + ", repetitionTime double, props map<string,string>, voxels array<double>"
)

# Numpy types of the numeric types.
DTYPES = {"s8bit": "i1", "u8bit": "u1", "s16bit": "i2", "u16bit": "u2", "s32bit": "i4", "u32bit": "u4", "s64bit": "i8", "u64bit": "u8", "float": "f4", "double": "f8"}
NAMES = {np.dtype(v): k for k, v in DTYPES.items()}


class FormatError(ValueError):
    """A file that isn't what its reader expects."""


@dataclass
class Chunk:
    voxels: np.ndarray  # flat, first index fastest
    dims: tuple[int, int, int, int]
    type_id: str
    sequenceNumber: int = 0
    acquisitionNumber: int = 0
    acquisitionTime: float | None = None
    indexOrigin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    rowVec: tuple[float, float, float] = (1.0, 0.0, 0.0)
    columnVec: tuple[float, float, float] = (0.0, 1.0, 0.0)
    sliceVec: tuple[float, float, float] | None = None
    voxelSize: tuple[float, float, float] = (1.0, 1.0, 1.0)
    voxelGap: tuple[float, float, float] | None = None
    repetitionTime: float | None = None
    props: dict[str, str] = field(default_factory=dict)

    def usual(self) -> Chunk:
        """With the usual geometry where a vector is missing."""
        for name in ("indexOrigin", "rowVec", "columnVec", "voxelSize"):
            if getattr(self, name) is None:
                setattr(self, name, Chunk.__dataclass_fields__[name].default)
        return self

    def head(self, source: str, part: int) -> tuple:
        """The row without its voxels."""
        v = lambda x: None if x is None else tuple(float(k) for k in x)
        return (
            source, part, self.type_id, tuple(int(d) for d in self.dims), self.sequenceNumber, self.acquisitionNumber, self.acquisitionTime,
            *[v(getattr(self, n)) for n in VECTORS], self.repetitionTime, self.props,
        )

    def row(self, source: str, part: int) -> tuple:
        return (*self.head(source, part), self.voxels.astype(float).tolist())


def chunk_of(row) -> Chunk:
    """A chunk from a row of the schema."""
    r = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)
    v = lambda x: None if x is None else (x["x"], x["y"], x["z"])
    return Chunk(
        np.array(r["voxels"], DTYPES.get(r["type_id"], "f8")), tuple(r["dims"][k] for k in "crst"), r["type_id"], r["sequenceNumber"] or 0, r["acquisitionNumber"] or 0, r["acquisitionTime"],
        *[v(r[n]) for n in VECTORS], r["repetitionTime"], dict(r["props"] or {}),
    )
