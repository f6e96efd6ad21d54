"""NIfTI-1 files: header, geometry, slice timing, JSON extension; and back.

Files count axes to the right, front and top; chunks to the left, back and top, so x and y change sign both ways.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

from lumenframe.sources.model import Chunk, FormatError

# Data type codes of the format.
CODES = {2: "u8bit", 4: "s16bit", 8: "s32bit", 16: "float", 64: "double", 256: "s8bit", 512: "u16bit", 768: "u32bit", 1024: "s64bit", 1280: "u64bit"}
BY_TYPE = {v: k for k, v in CODES.items()}
RGB24, BITS = 128, 1
#: Factors to millimetres and milliseconds by unit code.
SPACE, TIME = {0: 1.0, 1: 1000.0, 2: 1.0, 3: 0.001}, {0: 1000.0, 8: 1000.0, 16: 1.0, 24: 0.001}
#: Slice orders: sequential and alternating, up and down, and alternating from the second slice.
ORDERS = {1: "seq_inc", 2: "seq_dec", 3: "alt_inc", 4: "alt_dec", 5: "alt_inc2", 6: "alt_dec2"}
HEADER = 348


def acquisition_order(code: int, n: int) -> list[int]:
    """For each slice its place in time."""
    kind = ORDERS.get(code, "seq_inc")
    first = 1 if kind.endswith("2") else 0
    walk = list(range(n)) if kind.startswith("seq") else [*range(first, n, 2), *range(1 - first, n, 2)]
    if "dec" in kind:
        walk = [n - 1 - s for s in walk]
    out = [0] * n
    for time, s in enumerate(walk):
        out[s] = time
    return out


def order_code(times: list[float]) -> int:
    """The slice order of acquisition times (0 if it is none that the format knows)."""
    ranks = [sorted(times).index(t) for t in times]
    return next((c for c in ORDERS if acquisition_order(c, len(times)) == ranks), 0) if len(times) > 1 else 0


def spm_description(tr: float | None = None, te: float | None = None, fa: float | None = None) -> str:
    return "/".join(f"{k}={v:g}{unit}" for k, v, unit in (("TR", tr, "ms"), ("TE", te, "ms"), ("FA", fa, "deg")) if v is not None)


def parse_spm_description(text: str) -> dict[str, float]:
    names = {"TR": "repetitionTime", "TE": "echoTime", "FA": "flipAngle"}
    return {names[k]: float(v) for k, v in re.findall(r"(TR|TE|FA)=([0-9.]+)(?:ms|deg)", text)}


def _flipped(v) -> tuple[float, float, float]:
    return (-float(v[0]), -float(v[1]), float(v[2]))


def _quaternion(b: float, c: float, d: float, qfac: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array(
        [[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]]
    )
    r[:, 2] *= qfac
    return r


def decode(data: bytes, dialect: str = "") -> list[Chunk]:
    """One chunk per volume set; dialect ``slices`` gives a chunk per slice with its own acquisition number."""
    if len(data) < HEADER:
        raise FormatError("shorter than a header")
    end = next((e for e in "<>" if struct.unpack_from(e + "i", data)[0] == HEADER), None)
    if end is None or data[344:347] not in (b"n+1", b"ni1"):
        raise FormatError("no NIfTI-1 header")
    get = lambda form, at: struct.unpack_from(end + form, data, at)
    dim, (code, _), pix = get("8h", 40), get("2h", 70), get("8f", 76)
    shape = [max(1, d) for d in dim[1 : 1 + max(1, dim[0])]] + [1] * 7
    dims, channels = tuple(shape[:4]), shape[4]
    offset = int(get("f", 108)[0]) or 352
    n = int(np.prod(dims)) * channels
    if code == BITS:
        values, kind = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, offset))[:n], "u8bit"
    elif code == RGB24:
        values, kind, dims = np.frombuffer(data, np.uint8, 3 * n, offset), "u8bit", (dims[0] * 3, *dims[1:])
    elif code in CODES:
        from lumenframe.sources.raw import view

        kind = CODES[code]
        values = view(data, kind, offset, n, swap=end == ">")
    else:
        raise FormatError(f"data type {code} is unknown")
    slope, inter = get("2f", 112)
    if slope not in (0.0, 1.0) or (inter and slope):
        values, kind = values * float(slope) + float(inter), "double"
    units = data[123]
    mm, ms = SPACE.get(units & 7, 1.0), TIME.get(units & 56, 1000.0)
    size = tuple(abs(float(p)) * mm or 1.0 for p in pix[1:4])
    qform, sform = get("2h", 252)
    if sform > 0:
        m = np.array([get("4f", at) for at in (280, 296, 312)], float)
        axes, origin = m[:, :3] * mm, m[:, 3] * mm
        size = tuple(float(np.linalg.norm(axes[:, k])) or 1.0 for k in range(3))
        axes = axes / np.array(size)
    elif qform > 0:
        b, c, d, x, y, z = get("6f", 256)
        axes, origin = _quaternion(b, c, d, -1.0 if pix[0] < 0 else 1.0), np.array([x, y, z]) * mm
    else:
        axes, origin = np.diag([-1.0, -1.0, 1.0]), np.zeros(3)
    description = data[148:228].split(b"\0")[0].decode("latin-1")
    props = {"description": description, **{k: str(v) for k, v in parse_spm_description(description).items()}}
    if len(data) > 356 and data[348] and offset > 360:
        at = 352
        while at + 8 <= offset:
            length, kind_of = get("2i", at)
            if length < 8:
                break
            body = data[at + 8 : at + length].rstrip(b"\0")
            if kind_of == 0 and body.startswith(b"{"):
                props |= {k: v if isinstance(v, str) else json.dumps(v) for k, v in _flat(json.loads(body)).items()}
            at += length
    tr = float(pix[4]) * ms if pix[4] else None
    common = dict(type_id=kind, rowVec=_flipped(axes[:, 0]), columnVec=_flipped(axes[:, 1]), sliceVec=_flipped(axes[:, 2]), voxelSize=size, repetitionTime=tr, props=props)
    if dialect != "slices":
        return [Chunk(values, dims, indexOrigin=_flipped(origin), **common)]
    order = acquisition_order(data[122], dims[2])
    duration = float(get("f", 132)[0]) * ms
    out, flat = [], values.reshape(-1)
    per = dims[0] * dims[1]
    for t in range(dims[3]):
        for s in range(dims[2]):
            at = (t * dims[2] + s) * per
            place = origin + axes[:, 2] * size[2] * s
            out.append(Chunk(flat[at : at + per], (dims[0], dims[1], 1, 1), indexOrigin=_flipped(place), acquisitionNumber=order[s] + t * dims[2], acquisitionTime=order[s] * duration + t * (tr or 0.0), **common))
    return out


def _flat(tree: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in tree.items():
        out |= _flat(v, f"{prefix}{k}/") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def encode(chunks: list[Chunk], extension: bool = False) -> bytes:
    """An image of one or more chunks in order: equal slices or volumes of one type."""
    first = chunks[0]
    kind = first.type_id if first.type_id in BY_TYPE else "double"
    values = np.concatenate([c.voxels for c in chunks])
    c, r, s, t = first.dims
    if len(chunks) > 1:
        places = len({ch.indexOrigin for ch in chunks})
        s, t = (places, len(chunks) // places) if s == 1 and t == 1 else (s, t * len(chunks))
    axes = np.array([_flipped(first.rowVec), _flipped(first.columnVec), _flipped(first.sliceVec or np.cross(first.rowVec, first.columnVec))]).T
    origin = np.array(_flipped(first.indexOrigin))
    gap = first.voxelGap or (0.0, 0.0, 0.0)
    step = [a + b for a, b in zip(first.voxelSize, gap)]
    body = b""
    if extension and first.props:
        text = json.dumps(first.props).encode()
        length = -(-(len(text) + 8) // 16) * 16
        body = struct.pack("<2i", length, 0) + text.ljust(length - 8, b"\0")
    h = bytearray(352)
    struct.pack_into("<i", h, 0, HEADER)
    struct.pack_into("<8h", h, 40, 4 if t > 1 else 3, c, r, s, t, 1, 1, 1)
    struct.pack_into("<2h", h, 70, BY_TYPE[kind], 8 * np.dtype(_numpy(kind)).itemsize)
    struct.pack_into("<8f", h, 76, 1.0, *step, (first.repetitionTime or 0.0) / 1000, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352.0 + len(body), 1.0, 0.0)
    h[123] = 2 | 8
    finite = values[np.isfinite(values)] if values.dtype.kind == "f" else values
    struct.pack_into("<2f", h, 124, float(finite.max()) if len(finite) else 0.0, float(finite.min()) if len(finite) else 0.0)
    text = first.props.get("description") or spm_description(first.repetitionTime)
    h[148 : 148 + min(79, len(text))] = text.encode("latin-1", "replace")[:79]
    struct.pack_into("<2h", h, 252, 0, 1)
    for k, at in enumerate((280, 296, 312)):
        struct.pack_into("<4f", h, at, *(axes[k] * step), origin[k])
    h[344:348] = b"n+1\0"
    h[348] = 1 if body else 0
    return bytes(h) + body + values.astype("<" + _numpy(kind)).tobytes()


def _numpy(kind: str) -> str:
    from lumenframe.sources.model import DTYPES

    return DTYPES[kind]
