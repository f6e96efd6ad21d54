"""Vista files: an attribute list in text, then big-endian image data."""

from __future__ import annotations

import re

import numpy as np

from lumenframe.sources.model import Chunk, FormatError

# The pixel representations of the format.
REPN = {"bit": "u1", "ubyte": "u1", "sbyte": "i1", "short": ">i2", "ushort": ">u2", "long": ">i4", "float": ">f4", "double": ">f8"}
TYPE = {"bit": "u8bit", "ubyte": "u8bit", "sbyte": "s8bit", "short": "s16bit", "ushort": "u16bit", "long": "s32bit", "float": "float", "double": "double"}
BACK = {"u8bit": "ubyte", "s8bit": "sbyte", "s16bit": "short", "s32bit": "long", "float": "float", "double": "double"}
DIALECTS = ("functional", "map", "anatomical", "onlyfirst")
_IMAGE = re.compile(r"\bimage:\s*image\s*\{(.*?)\}", re.S)
_FIELD = re.compile(r'^\s*([\w]+):\s*(?:"([^"]*)"|(\S+))\s*$', re.M)


def images(data: bytes) -> list[tuple[dict[str, str], np.ndarray]]:
    """Attributes and voxels of every image in a file."""
    if not data.startswith(b"V-data"):
        raise FormatError("no Vista signature")
    end = data.find(b"\f\n")
    if end < 0:
        raise FormatError("the attribute list doesn't end")
    head, body = data[:end].decode("latin-1"), data[end + 2 :]
    out = []
    for m in _IMAGE.finditer(head):
        f = {k: a or b for k, a, b in _FIELD.findall(m[1])}
        try:
            repn, at, n = f["repn"], int(f["data"]), int(f["length"])
            values = np.frombuffer(body, REPN[repn], n // np.dtype(REPN[repn]).itemsize, at)
        except (KeyError, ValueError) as e:
            raise FormatError(f"incomplete image: {e}") from e
        out.append((f, values.astype(values.dtype.newbyteorder("="))))
    return out


def _numbers(text: str | None, n: int) -> list[float]:
    found = [float(x) for x in (text or "").split()]
    return (found + [1.0] * n)[:n]


def decode(data: bytes, dialect: str = "") -> list[Chunk]:
    """A chunk per image.  Functional images hold the time steps of one slice, anatomical ones a volume, maps a volume of floats.

    Without a dialect several short images are functional, one float image a map, anything else anatomical.
    """
    found = images(data)
    if dialect and dialect not in DIALECTS:
        raise FormatError(f"dialect {dialect} is unknown")
    if dialect == "onlyfirst":
        found = found[:1]
    kind = dialect if dialect in DIALECTS[:3] else "functional" if len(found) > 1 and all(f["repn"] == "short" for f, _ in found) else "map" if len(found) == 1 and found[0][0]["repn"] == "float" else "anatomical"
    out = []
    for number, (f, values) in enumerate(found):
        bands, rows, columns = (int(f.get(k, "1")) for k in ("nbands", "nrows", "ncolumns"))
        size = _numbers(f.get("voxel"), 3)
        tr = float(f["repetition_time"]) if f.get("repetition_time", "").replace(".", "", 1).isdigit() else None
        dims = (columns, rows, 1, bands) if kind == "functional" else (columns, rows, bands, 1)
        z = float(number) * size[2] if kind == "functional" else 0.0
        out.append(Chunk(values, dims, TYPE[f["repn"]], acquisitionNumber=number, indexOrigin=(0.0, 0.0, z), voxelSize=tuple(size), repetitionTime=tr, props={f"Vista/{k}": v for k, v in f.items() if k not in ("data", "length")}))
    return out


def encode(chunks: list[Chunk]) -> bytes:
    """Each slice of a four-dimensional chunk as a functional image, other chunks as volumes; unknown types as short."""
    heads, body = [], b""
    for c in chunks:
        repn = BACK.get(c.type_id, "short")
        v = c.voxels if c.type_id in BACK else np.clip(np.rint(c.voxels), -32768, 32767)
        cube = v.reshape(c.dims[3], c.dims[2], c.dims[1], c.dims[0])
        parts = [cube[:, s] for s in range(c.dims[2])] if c.dims[3] > 1 else [cube[0]]
        for p in parts:
            raw = np.ascontiguousarray(p).astype(REPN[repn]).tobytes()
            voxel = " ".join(f"{x:g}" for x in c.voxelSize)
            extra = f"\trepetition_time: {c.repetitionTime:g}\n" if c.repetitionTime else ""
            heads.append(f'\timage: image {{\n\tdata: {len(body)}\n\tlength: {len(raw)}\n\tnbands: {p.shape[0]}\n\tnrows: {p.shape[1]}\n\tncolumns: {p.shape[2]}\n\trepn: {repn}\n\tvoxel: "{voxel}"\n{extra}\t}}\n')
            body += raw
    return ("V-data 2 {\n" + "".join(heads) + "}\n").encode("latin-1") + b"\f\n" + body
