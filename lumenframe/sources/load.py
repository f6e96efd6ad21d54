"""Scan files into chunks and write images to files.

Formats are chosen by the longest suffix that fits (``a.tar.gz`` first as an archive, then as a compressed file) and by
dialect; of several that fit, the first that doesn't fail wins.  Files are read by Spark and decoded where they are read.
"""

from __future__ import annotations

import importlib.util
import os
import subprocess
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions.arrays import splice
from lumenframe.functions.names import split_suffix
from lumenframe.sources import archive, dicom, nifti, png, raw, vista
from lumenframe.sources.model import SCHEMA, Chunk, FormatError, chunk_of


@dataclass(frozen=True)
class Format:
    name: str
    suffixes: tuple[str, ...]
    decode: Callable[[bytes, str, str], list[Chunk]]  # bytes, dialect, file name
    dialects: tuple[str, ...] = ()
    encode: Callable[[list[Chunk]], bytes] | None = None


REGISTRY: dict[str, list[Format]] = {}


def register_format(f: Format) -> None:
    """Make a format known under its suffixes (in front of others of the same suffix)."""
    for s in f.suffixes:
        REGISTRY.setdefault(s.lower(), []).insert(0, f)


register_format(Format("raw", ("raw",), lambda d, _, __: raw.decode(d), encode=raw.encode))
register_format(Format("vista", ("v",), lambda d, dialect, _: vista.decode(d, dialect), vista.DIALECTS, vista.encode))
register_format(Format("dicom", ("dcm", "ima"), lambda d, dialect, _: dicom.decode(d, dialect), ("keepmosaic",)))
def _one_png(chunks: list[Chunk]) -> bytes:
    if len(chunks) != 1 or chunks[0].dims[2] * chunks[0].dims[3] != 1:
        raise FormatError("a PNG file holds one slice; name chunks one by one, or take png.slices")
    if chunks[0].type_id not in ("u8bit", "u16bit", "color24", "color48"):
        raise FormatError(f"a PNG file holds no {chunks[0].type_id}")
    return png.encode(chunks[0])


register_format(Format("png", ("png",), lambda d, dialect, name: png.decode(d, dialect, name), ("stacked", "middle"), _one_png))
register_format(Format("nifti", ("nii",), lambda d, dialect, _: nifti.decode(d, dialect), ("slices", "fsl", "spm"), nifti.encode))


#: Modules of formats found by ``discover``; tasks import them when they need them.
DISCOVERED: list[str] = []
_imported: set[str] = set()


def _known_modules(names: tuple[str, ...]) -> None:
    for name in names:
        if name not in _imported:
            register_format(importlib.import_module(name).factory())
            _imported.add(name)


def discover(spark: SparkSession, folder: str, pattern: str = "*_format.py") -> dict[str, str]:
    """Formats of the modules in a folder: each has a ``factory()`` that gives its ``Format``.

    The modules are sent to the executors.  Returns the reason for every module that couldn't be used; the others are known from now on.
    """
    failed = {}
    for f in sorted(Path(folder).glob(pattern)):
        try:
            if f.stem not in sys.modules:
                spec = importlib.util.spec_from_file_location(f.stem, f)
                sys.modules[f.stem] = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(sys.modules[f.stem])
            _known_modules((f.stem,))
        except Exception as e:  # noqa: BLE001  a foreign module may fail in any way; it is reported
            sys.modules.pop(f.stem, None)
            failed[f.name] = f"{type(e).__name__}: {e}"
            continue
        spark.sparkContext.addPyFile(str(f))
        if f.stem not in DISCOVERED:
            DISCOVERED.append(f.stem)
    return failed


def formats_for(name: str, suffix: str = "", dialect: str = "") -> list[Format]:
    """Formats of a file, longest suffix first; those without the dialect are left out if one is asked for."""
    low, found = (suffix or name).lower().lstrip("."), []
    for s in sorted(REGISTRY, key=len, reverse=True):
        if low == s or low.endswith("." + s):
            found += [f for f in REGISTRY[s] if not dialect or dialect in f.dialects]
    return found


def decode_file(name: str, data: bytes, suffix: str = "", dialect: str = "") -> tuple[list[Chunk], str | None]:
    """Chunks of a file and the reason why there are none; of an archive, its readable members and the reasons of the others."""
    if not suffix and archive.is_archive(name):
        try:
            chunks, reasons = [], []
            for inner, body in archive.members(name, data):
                got, why = decode_file(inner, body, "", dialect)
                chunks += got
                if why:
                    reasons.append(why)
            return chunks, "; ".join(reasons) or (None if chunks else "the archive is empty")
        except FormatError as e:
            return [], f"{name}: {e}"
    reasons = []
    for f in formats_for(name, suffix, dialect):
        try:
            return f.decode(data, dialect, name), None
        except (FormatError, ValueError, IndexError, KeyError, OverflowError) as e:
            reasons.append(f"{f.name}: {e}")
    return [], f"{name}: " + ("; ".join(reasons) or "no format fits")


RESULT = SCHEMA + ", error string"
#: Voxels of an Arrow batch, about; a larger chunk is a batch of its own.
BATCH_VOXELS = 1 << 22


def scan(spark: SparkSession, paths: list[str] | str, suffix: str = "", dialect: str = "") -> DataFrame:
    """Chunks of files and of the files directly in folders, one row each; what no format reads (a file, members of an archive) gives an error row."""
    modules = tuple(DISCOVERED)
    # whole files stand in a row, so a batch holds few
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _known_modules(modules)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                chunks, error = decode_file(path, content.as_py(), suffix, dialect)
                batch, voxels = [], 0
                for k, c in enumerate(chunks):
                    if batch and voxels + c.voxels.size > BATCH_VOXELS:
                        yield _arrow(batch)
                        batch, voxels = [], 0
                    batch.append((c.head(c.props.get("source", path), k), c.voxels, None))
                    voxels += c.voxels.size
                if error:
                    batch.append(((path, len(chunks), *[None] * (len(RESULT_ARROW) - 4)), None, error))
                if batch:
                    yield _arrow(batch)

    return files.mapInArrow(run, RESULT)


def load_raw(spark: SparkSession, paths: list[str] | str, type_id: str = "u8bit", dims: tuple[int, ...] | None = None, offset: int = 0, swap: bool = False, voxel_size: tuple[float, float, float] | None = None, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """A chunk per raw file, with ``arrival``.  Without ``dims`` a file must be a square; one that doesn't fit ends the query."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                c = raw.decode(content.as_py(), type_id, dims, offset, swap)[0]
                c.voxelSize, c.indexOrigin = voxel_size or c.voxelSize, origin or c.indexOrigin
                yield _arrow([(c.head(path, 0), c.voxels, None)])

    d = files.mapInArrow(run, RESULT).drop("error")
    return d.withColumn("arrival", F.concat("source", F.lit("#"), F.lpad(F.col("part").cast("string"), 9, "0")))


def _arrow_schema() -> pa.Schema:
    vector = pa.struct([(k, pa.float64()) for k in "xyz"])
    fields = [("source", pa.string()), ("part", pa.int32()), ("type_id", pa.string()), ("dims", pa.struct([(k, pa.int32()) for k in "crst"])), ("sequenceNumber", pa.int32()), ("acquisitionNumber", pa.int64()), ("acquisitionTime", pa.float64())]
    fields += [(v, vector) for v in ("indexOrigin", "rowVec", "columnVec", "sliceVec", "voxelSize", "voxelGap")]
    return pa.schema([*fields, ("repetitionTime", pa.float64()), ("props", pa.map_(pa.string(), pa.string())), ("voxels", pa.list_(pa.float64())), ("error", pa.string())])


RESULT_ARROW = _arrow_schema()
HEAD_ARROW = pa.schema(list(RESULT_ARROW)[:-2])


def _arrow(rows: list[tuple[tuple, np.ndarray | None, str | None]]) -> pa.RecordBatch:
    """(head, voxels, error) of each row as a batch; voxels go from their arrays to Arrow without Python numbers."""
    heads = pa.RecordBatch.from_pylist([_named(HEAD_ARROW, h) for h, _, _ in rows], schema=HEAD_ARROW)
    flat = [np.asarray(v, np.float64).reshape(-1) for _, v, _ in rows if v is not None]
    ends = np.cumsum([0 if v is None else v.size for _, v, _ in rows], dtype=np.int32)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.array([v is None for _, v, _ in rows] + [False]))
    voxels = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0)))
    return pa.RecordBatch.from_arrays([*heads.columns, voxels.cast(RESULT_ARROW.field("voxels").type), pa.array([e for _, _, e in rows], pa.string())], schema=RESULT_ARROW)


def _named(schema: pa.Schema, row: tuple) -> dict:
    out = {}
    for f, v in zip(schema, row):
        if isinstance(v, tuple):
            v = dict(zip([c.name for c in f.type], v))
        elif isinstance(v, dict):
            v = list(v.items())
        out[f.name] = v
    return out


def load(spark: SparkSession, paths: list[str] | str, suffix: str = "", dialect: str = "") -> DataFrame:
    """Chunks with ``arrival`` (source and part), ready for assembly."""
    d = scan(spark, paths, suffix, dialect).filter("error is null").drop("error")
    return d.withColumn("arrival", F.concat("source", F.lit("#"), F.lpad(F.col("part").cast("string"), 9, "0")))


def failures(spark: SparkSession, paths: list[str] | str, suffix: str = "", dialect: str = "") -> DataFrame:
    return scan(spark, paths, suffix, dialect).filter("error is not null").select("source", "error")


def load_list(spark: SparkSession, list_file: str, suffix: str = "", dialect: str = "") -> DataFrame:
    """Chunks of the files that are named in a text file, one a line, or in the standard input (``-``).  Names come to the driver; files don't."""
    if list_file == "-":
        names = [x.strip() for x in sys.stdin if x.strip()]
    else:
        names = [r[0].strip() for r in spark.read.text(list_file).toLocalIterator() if r[0].strip()]
    return load(spark, names, suffix, dialect)


def load_process(spark: SparkSession, command: list[str], suffix: str = "", dialect: str = "", allowed: bool = False) -> DataFrame:
    """Chunks of the files that a program prints, one a line.  It runs on the driver and only if ``allowed``."""
    if not allowed:
        raise PermissionError("pass allowed=True to run a program for file names")
    out = subprocess.run(command, check=True, capture_output=True, text=True).stdout
    return load(spark, [x.strip() for x in out.splitlines() if x.strip()], suffix, dialect)


def encode_file(name: str, chunks: list[Chunk], formats: tuple[str, ...] = ()) -> tuple[bytes | None, str | None, list[str]]:
    """The bytes of a file, the format that made them, and the reasons of those that refused before.

    The formats of the suffix that write are tried in turn, or the named ``formats`` whatever the suffix.  If all refuse there are reasons only.
    """
    packed = name.rsplit(".", 1)[0] if name.rsplit(".", 1)[-1].lower() in archive.COMPRESSED else name
    known = {f.name: f for group in REGISTRY.values() for f in group}
    encoders = [known[n] for n in formats if n in known and known[n].encode] if formats else [f for f in formats_for(packed) if f.encode]
    reasons = []
    for f in encoders:
        try:
            return archive.compress(name, f.encode(chunks)), f.name, reasons
        except (FormatError, ValueError, IndexError, KeyError, OverflowError, TypeError) as e:
            reasons.append(f"{f.name}: {e}")
    return None, None, reasons or ["no format writes this suffix"]


def sliced(chunks: DataFrame, name: str = "file_name", order: str = "lookup", middle: bool = False) -> DataFrame:
    """A chunk per slice, each with a file name of its own: ``name_001.png``, ...; with ``middle`` the middle slice of every file only, under its name.

    For formats that hold one slice.  Numbers run through the chunks of a file in order and are as wide as the last one.
    """
    stem, suffix = split_suffix(F.col(name), [])
    per = (F.col("dims")["s"] * F.col("dims")["t"]).cast("long")
    chunks_of = Window.partitionBy(name)
    d = chunks.withColumns({"__before": F.coalesce(F.sum(per).over(chunks_of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum(per).over(chunks_of)})
    block = F.col("dims")["c"] * F.col("dims")["r"]
    d = d.select("*", F.posexplode(splice(F.col("voxels"), block)).alias("__i", "__v")).withColumn("__n", F.col("__before") + F.col("__i"))
    if middle:
        d, label = d.filter(F.col("__n") == F.floor(F.col("__all") / 2)), F.col(name)
    else:
        label = F.concat(stem, F.lit("_"), F.lpad((F.col("__n") + 1).cast("string"), F.length(F.col("__all").cast("string")), "0"), suffix)
    one = F.lit(1)
    flat = F.struct(F.col("dims")["c"].alias("c"), F.col("dims")["r"].alias("r"), one.alias("s"), one.alias("t"))
    return d.withColumns({name: label, "dims": flat, "voxels": F.col("__v"), order: F.col("__n")}).drop("__before", "__all", "__i", "__v", "__n")


def write(chunks: DataFrame, folder: str, name: str = "file_name", order: str = "lookup", formats: tuple[str, ...] = ()) -> DataFrame:
    """One file per name from its chunks in order; (file_name, bytes, error, format, refused) per file.

    The first format that takes the chunks writes them; ``refused`` has the reasons of those before it.  ``folder`` is one that all executors share.  An image's chunks meet in one task, as its file is one piece.
    """
    schema = "file_name string, bytes long, error string, format string, refused string"
    modules = tuple(DISCOVERED)

    def saved(target: str, held: list[tuple[object, Chunk]]) -> tuple:
        held.sort(key=lambda x: (x[0] is None or x[0] != x[0], 0 if x[0] is None else x[0]))  # without a place: last
        error, size = None, 0
        data, used, reasons = encode_file(target, [c for _, c in held], formats)
        try:
            if data is None:
                raise FormatError("; ".join(reasons))
            temporary = os.path.join(folder, f".{os.path.basename(target)}.part")
            with open(temporary, "wb") as f:
                f.write(data)
            os.replace(temporary, os.path.join(folder, target))  # a second attempt puts the same file there
            size = len(data)
        except (FormatError, OSError) as e:
            error = str(e)
        return target, size, error, used, "; ".join(reasons) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file after another: only the chunks of one file are held, and what was written goes out with its batch."""
        _known_modules(modules)
        fields = ("file_name", "bytes", "error", "format", "refused")
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=fields)
        current, held = None, []
        for b in batches:
            done = []
            names, places, voxels = b.column(name).to_pylist(), b.column(order).to_pylist(), b.column("voxels")
            heads = b.drop_columns(["voxels"]).to_pylist()
            for i, target in enumerate(names):
                target = str(target)
                if held and target != current:
                    done.append(saved(current, held))
                    held = []
                v = voxels[i].values
                current = target
                held.append((places[i], chunk_of(heads[i] | {"voxels": None if v is None else v.to_numpy(zero_copy_only=False)})))
            if done:
                yield out(done)
        if held:
            yield out([saved(current, held)])

    return chunks.repartition(F.col(name)).sortWithinPartitions(name).mapInArrow(run, schema)


def __getattr__(name: str):
    if name == "ChunkSource":  # its module needs this one
        from lumenframe.sources.sink import ChunkSource

        return ChunkSource
    raise AttributeError(name)
