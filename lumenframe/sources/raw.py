"""Typed views of raw bytes."""

from __future__ import annotations

import math

import numpy as np

from lumenframe.sources.model import DTYPES, Chunk, FormatError


def view(data: bytes, type_id: str, offset: int = 0, count: int | None = None, swap: bool = False) -> np.ndarray:
    """Elements of a type from a byte offset on, maybe with reversed bytes."""
    dtype = np.dtype(DTYPES[type_id]).newbyteorder(">" if swap else "<")
    count = (len(data) - offset) // dtype.itemsize if count is None else count
    if offset + count * dtype.itemsize > len(data):
        raise FormatError("the data end before the last element")
    return np.frombuffer(data, dtype, count, offset).astype(dtype.newbyteorder("="))


def decode(data: bytes, type_id: str = "u8bit", dims: tuple[int, ...] | None = None, offset: int = 0, swap: bool = False) -> list[Chunk]:
    """One chunk; without dims the data must be a square."""
    if dims is None:
        n = (len(data) - offset) // np.dtype(DTYPES[type_id]).itemsize
        side = math.isqrt(n)
        if side * side != n:
            raise FormatError(f"{n} elements are no square; give dims")
        dims = (side, side)
    full = (*dims, 1, 1, 1)[:4]
    return [Chunk(view(data, type_id, offset, math.prod(full), swap), full, type_id)]


def encode(chunks: list[Chunk], swap: bool = False) -> bytes:
    return b"".join(c.voxels.astype(np.dtype(DTYPES[c.type_id]).newbyteorder(">" if swap else "<")).tobytes() for c in chunks)
