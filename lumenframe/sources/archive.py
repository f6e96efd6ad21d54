"""Compressed files and archives: what is inside, by name."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
from collections.abc import Iterator

from lumenframe.sources.model import FormatError

COMPRESSED = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress, "lzma": lzma.decompress}
TARS = ("tar", "tar.gz", "tgz", "tar.bz2", "tbz", "tar.xz", "txz")


def is_archive(name: str) -> bool:
    return any(name.lower().endswith("." + s) for s in (*COMPRESSED, *TARS))


def members(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files inside, in order; a compressed file is one without its last suffix."""
    low = name.lower()
    if any(low.endswith("." + s) for s in TARS):
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    if m.isfile():
                        yield f"{name}/{m.name}", t.extractfile(m).read()
        except tarfile.TarError as e:
            raise FormatError(str(e)) from e
        return
    suffix = low.rsplit(".", 1)[-1]
    if suffix not in COMPRESSED:
        raise FormatError(f"{suffix} is no compressed format")
    try:
        yield name[: -len(suffix) - 1], COMPRESSED[suffix](data)
    except (OSError, EOFError, lzma.LZMAError) as e:
        raise FormatError(str(e)) from e


def compress(name: str, data: bytes) -> bytes:
    """Bytes as the last suffix of ``name`` says."""
    packers = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "lzma": lambda d: lzma.compress(d, lzma.FORMAT_ALONE)}
    suffix = name.lower().rsplit(".", 1)[-1]
    return packers[suffix](data) if suffix in packers else data
