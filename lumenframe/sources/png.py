"""PNG files: grey and RGB, 8 and 16 bits."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from lumenframe.sources.model import Chunk, FormatError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _unfilter(raw: bytes, height: int, width: int, pixel: int) -> np.ndarray:
    """Rows without their filters (left, above, average, nearest of three)."""
    out = np.zeros((height + 1, width + pixel), np.uint8)
    at = 0
    for y in range(1, height + 1):
        kind, line = raw[at], np.frombuffer(raw, np.uint8, width, at + 1).astype(np.int64)
        at += width + 1
        above, row = out[y - 1].astype(np.int64), out[y]
        if kind == 0:
            row[pixel:] = line
        elif kind == 2:
            row[pixel:] = line + above[pixel:]
        elif kind in (1, 3, 4):
            for x in range(width):
                a, b, c = int(row[x]), int(above[x + pixel]), int(above[x])
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    da, db, dc = abs(q - a), abs(q - b), abs(q - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                row[x + pixel] = (int(line[x]) + p) & 255
        else:
            raise FormatError(f"row filter {kind} is unknown")
    return out[1:, pixel:]


def decode(data: bytes, dialect: str = "", name: str = "") -> list[Chunk]:
    """One slice; with dialect ``stacked`` its number is the last number in the file's name."""
    if not data.startswith(SIGNATURE):
        raise FormatError("no PNG signature")
    at, body, header = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            header = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if header is None:
        raise FormatError("no header")
    width, height, bits, color, _, _, interlaced = header
    if bits not in (8, 16) or color not in CHANNELS or interlaced:
        raise FormatError("only plain grey and RGB images of 8 or 16 bits are read")
    channels, size = CHANNELS[color], bits // 8
    rows = _unfilter(zlib.decompress(body), height, width * channels * size, channels * size)
    values = rows.reshape(-1).view(">u2" if size == 2 else "u1").reshape(height, width, channels)
    kept = values[:, :, :3] if channels >= 3 else values[:, :, :1]
    digits = re.findall(r"\d+", name.rsplit("/", 1)[-1])
    number = int(digits[-1]) if dialect == "stacked" and digits else 0
    kind = ("color48" if size == 2 else "color24") if channels >= 3 else ("u16bit" if size == 2 else "u8bit")
    voxels = np.ascontiguousarray(kept).reshape(-1).astype(np.uint16 if size == 2 else np.uint8)
    dims = (width * kept.shape[2], height, 1, 1)
    return [Chunk(voxels, dims, kind, acquisitionNumber=number, indexOrigin=(0.0, 0.0, float(number)), props={"channels": str(kept.shape[2])})]


def encode(chunk: Chunk) -> bytes:
    """The first slice of a chunk."""
    channels = int(chunk.props.get("channels", "1"))
    wide = chunk.type_id in ("u16bit", "color48")
    width, height = chunk.dims[0] // channels, chunk.dims[1]
    pixels = chunk.voxels[: chunk.dims[0] * height].astype(">u2" if wide else "u1").reshape(height, -1)
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def block(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", width, height, 16 if wide else 8, 2 if channels == 3 else 0, 0, 0, 0)
    return SIGNATURE + block(b"IHDR", header) + block(b"IDAT", zlib.compress(raw)) + block(b"IEND", b"")


def slices(chunk: Chunk, dialect: str = "") -> list[Chunk]:
    """A chunk per slice; with dialect ``middle`` the middle one only."""
    per = chunk.dims[0] * chunk.dims[1]
    count = chunk.dims[2] * chunk.dims[3]
    which = [count // 2] if dialect == "middle" else range(count)
    return [Chunk(chunk.voxels[k * per : (k + 1) * per], (*chunk.dims[:2], 1, 1), chunk.type_id, acquisitionNumber=k, props=chunk.props) for k in which]
