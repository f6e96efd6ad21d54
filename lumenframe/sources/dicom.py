"""DICOM files, explicit or implicit little endian, uncompressed: tags to properties, pixels to chunks, mosaics to volumes."""

from __future__ import annotations

import struct

import numpy as np

from lumenframe.sources.model import Chunk, FormatError

# Value representations with long length fields, and the tags that have a meaning of their own.
LONG = frozenset((b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"UC", b"UR", b"OL"))
NUMERIC = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
TAGS = {
    (0x0008, 0x0008): "ImageType", (0x0008, 0x0021): "SeriesDate", (0x0008, 0x0031): "SeriesTime", (0x0008, 0x0032): "AcquisitionTime", (0x0008, 0x103E): "SeriesDescription",
    (0x0010, 0x0010): "PatientsName", (0x0010, 0x0040): "PatientsSex", (0x0010, 0x1010): "PatientsAge", (0x0010, 0x1030): "PatientsWeight",
    (0x0018, 0x0050): "SliceThickness", (0x0018, 0x0080): "RepetitionTime", (0x0018, 0x0081): "EchoTime", (0x0018, 0x0088): "SpacingBetweenSlices", (0x0018, 0x1314): "FlipAngle",
    (0x0020, 0x0011): "SeriesNumber", (0x0020, 0x0012): "AcquisitionNumber", (0x0020, 0x0013): "InstanceNumber", (0x0020, 0x0032): "ImagePositionPatient", (0x0020, 0x0037): "ImageOrientationPatient",
    (0x0028, 0x0002): "SamplesPerPixel", (0x0028, 0x0010): "Rows", (0x0028, 0x0011): "Columns", (0x0028, 0x0030): "PixelSpacing", (0x0028, 0x0100): "BitsAllocated", (0x0028, 0x0103): "PixelRepresentation",
    (0x0019, 0x100A): "NumberOfImagesInMosaic",
}
IMPLICIT = {"Rows": b"US", "Columns": b"US", "BitsAllocated": b"US", "PixelRepresentation": b"US", "SamplesPerPixel": b"US", "NumberOfImagesInMosaic": b"US"}
PIXELS = (0x7FE0, 0x0010)
SYNTAX_IMPLICIT, SYNTAX_EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"


def tags(data: bytes) -> tuple[dict[str, str], bytes]:
    """Properties by name (unknown tags as (gggg,eeee)) and the pixel bytes."""
    if len(data) < 132 or data[128:132] != b"DICM":
        raise FormatError("no DICOM prefix")
    at, explicit, following, out, pixels = 132, True, True, {}, b""
    while at + 8 <= len(data):
        group, element = struct.unpack_from("<2H", data, at)
        named = TAGS.get((group, element), f"({group:04x},{element:04x})")
        if group == 2 or explicit:
            vr = data[at + 4 : at + 6]
            if vr in LONG:
                n, start = struct.unpack_from("<I", data, at + 8)[0], at + 12
            else:
                n, start = struct.unpack_from("<H", data, at + 6)[0], at + 8
        else:
            vr, n, start = IMPLICIT.get(named, b"LO"), struct.unpack_from("<I", data, at + 4)[0], at + 8
        if n == 0xFFFFFFFF:
            end = data.find(b"\xfe\xff\xdd\xe0", start)
            n = (end if end >= 0 else len(data)) - start
            at = start + n + 8
        else:
            at = start + n
        body = data[start : start + n]
        if (group, element) == PIXELS:
            pixels = body
        elif vr in NUMERIC:
            size = struct.calcsize(NUMERIC[vr])
            out[named] = "\\".join(f"{v:g}" if isinstance(v, float) else str(v) for v in struct.unpack(f"<{n // size}{NUMERIC[vr]}", body[: n // size * size]))
        elif vr in LONG:
            out[named] = body.hex()
        else:
            out[named] = body.decode("latin-1").rstrip("\0 ")
        if (group, element) == (2, 0x10):
            syntax = out[named]
            if syntax not in (SYNTAX_IMPLICIT, SYNTAX_EXPLICIT):
                raise FormatError(f"transfer syntax {syntax} isn't read")
            following = syntax == SYNTAX_EXPLICIT
        if group == 2 and at + 2 <= len(data) and struct.unpack_from("<H", data, at)[0] != 2:
            explicit = following
    return out, pixels


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in text.split("\\")] if text else []


def decode(data: bytes, dialect: str = "") -> list[Chunk]:
    p, pixels = tags(data)
    try:
        rows, columns, bits = int(p["Rows"]), int(p["Columns"]), int(p.get("BitsAllocated", "16"))
    except KeyError as e:
        raise FormatError(f"no {e}") from e
    samples, signed = int(p.get("SamplesPerPixel", "1")), p.get("PixelRepresentation", "0") == "1"
    kind = f"{'s' if signed else 'u'}{bits}bit" if samples == 1 else ("color24" if bits == 8 else "color48")
    dtype = f"<{'i' if signed else 'u'}{bits // 8}"
    need = rows * columns * samples
    if bits not in (8, 16, 32) or len(pixels) < need * (bits // 8):
        raise FormatError("pixels are missing or of an unknown width")
    values = np.frombuffer(pixels, dtype, need)
    spacing, direction, origin = _numbers(p.get("PixelSpacing")) or [1.0, 1.0], _numbers(p.get("ImageOrientationPatient")) or [1.0, 0, 0, 0, 1.0, 0], _numbers(p.get("ImagePositionPatient")) or [0.0] * 3
    thick = float(p.get("SliceThickness") or 1.0)
    gap = float(p["SpacingBetweenSlices"]) - thick if p.get("SpacingBetweenSlices") else 0.0
    chunk = Chunk(
        values, (columns * samples, rows, 1, 1), kind, int(float(p.get("SeriesNumber") or 0)), int(float(p.get("InstanceNumber") or p.get("AcquisitionNumber") or 0)),
        indexOrigin=tuple(origin), rowVec=tuple(direction[:3]), columnVec=tuple(direction[3:]), voxelSize=(spacing[1], spacing[0], thick), voxelGap=(0.0, 0.0, gap),
        repetitionTime=float(p["RepetitionTime"]) if p.get("RepetitionTime") else None, props={f"DICOM/{k}": v for k, v in p.items()} | _normalised(p),
    )
    if "MOSAIC" in p.get("ImageType", "") and p.get("NumberOfImagesInMosaic") and dialect != "keepmosaic":
        return [mosaic(chunk, int(p["NumberOfImagesInMosaic"]))]
    return [chunk]


def _normalised(p: dict[str, str]) -> dict[str, str]:
    """Properties under their common names."""
    names = {"SeriesDescription": "sequenceDescription", "PatientsName": "subjectName", "PatientsSex": "subjectGender", "PatientsAge": "subjectAge", "PatientsWeight": "subjectWeigth", "EchoTime": "echoTime", "FlipAngle": "flipAngle"}
    out = {new: p[old] for old, new in names.items() if p.get(old)}
    if p.get("SeriesDate"):
        out["sequenceStart"] = p["SeriesDate"] + "T" + p.get("SeriesTime", "000000")
    return out


def mosaic(chunk: Chunk, images: int) -> Chunk:
    """A square sheet of tiles as a volume; the origin moves from the sheet's corner to the first tile's."""
    across = int(np.ceil(np.sqrt(images)))
    width, height = chunk.dims[0] // across, chunk.dims[1] // across
    tiles = chunk.voxels.reshape(across, height, across, width).transpose(0, 2, 1, 3).reshape(across * across, height * width)[:images]
    row, column = np.array(chunk.rowVec), np.array(chunk.columnVec)
    shift = row * (chunk.dims[0] - width) / 2 * chunk.voxelSize[0] + column * (chunk.dims[1] - height) / 2 * chunk.voxelSize[1]
    origin = tuple(float(x) for x in np.array(chunk.indexOrigin) + shift)
    return Chunk(tiles.reshape(-1), (width, height, images, 1), chunk.type_id, chunk.sequenceNumber, chunk.acquisitionNumber, chunk.acquisitionTime, origin, chunk.rowVec, chunk.columnVec, chunk.sliceVec, chunk.voxelSize, chunk.voxelGap, chunk.repetitionTime, chunk.props)
