"""Chunks to files through Spark's writer, and files to chunks through Spark's reader: ``spark.read/df.write.format("chunks")``.

Files are reached by Arrow's file systems, so a path may be a plain folder or a URI (``file:``, ``s3:``, ``gs:``, ``hdfs:``) that driver and executors share.

A writing task puts the files of its rows under a temporary folder of its own attempt and reports their names; only the driver's commit moves
them to their place, so an attempt that dies leaves nothing there, and a job that fails is aborted without a trace.  A rerun replaces files of the same
name.  All rows of a file must reach one task, one file after another: ``write_chunks`` arranges that.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenframe.sources.load import RESULT_ARROW, _arrow, decode_file, encode_file
from lumenframe.sources.model import SCHEMA, FormatError, chunk_of

FAILURES = "_failures.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    found, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return found, inner


def visible(name: str) -> bool:
    return not name.startswith(("_", "."))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (temporary path, file name, bytes), and (file name, reason) of what no format took."""

    files: list[tuple[str, str, int]]
    failed: list[tuple[str, str]]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite, self.job = self.options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.name, self.order = self.options.get("filename", "file_name"), self.options.get("order", "lookup")
        self.formats = tuple(x.strip() for x in self.options.get("formats", "").split(",") if x.strip())

    def _temporary(self) -> str:
        return f"{located(self.path)[1]}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file after another: only the chunks of one file are held."""
        system, _ = located(self.path)
        task = TaskContext.get()
        folder = f"{self._temporary()}/{task.partitionId()}-{task.taskAttemptId()}"
        out, current, held, done = Written([], []), None, [], set()

        def flush() -> None:
            if current is None:
                return
            chunks = [c for _, c in sorted(held, key=lambda x: x[0])]
            data, _, reasons = encode_file(current, chunks, self.formats)
            if data is None:
                out.failed.append((current, "; ".join(reasons)))
                return
            system.create_dir(folder, recursive=True)
            at = f"{folder}/{len(out.files)}"
            with system.open_output_stream(at) as f:
                f.write(data)
            out.files.append((at, current, len(data)))

        for b in iterator:
            names = b.column(self.name).to_pylist()
            places = b.column(self.order).to_pylist() if self.order in b.schema.names else [0] * len(b)
            for i, name in enumerate(names):
                if name is None or "/" in name:
                    raise FormatError(f"a file name is needed, without folders: {name}")
                if name != current:
                    flush()
                    done.add(current)
                    current, held = name, []
                    if name in done:
                        raise FormatError(f"the rows of {name} don't come together; write_chunks sorts them")
                held.append((places[i], _chunk(b, i)))
        flush()
        return out

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        names = [name for m in told for _, name, _ in m.files]
        failed = [f for m in told for f in m.failed]
        doubled = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if doubled or (failed and self.options.get("ignoreerrors", "false").lower() != "true"):
            self.abort(messages)
            raise FormatError(f"written by more than one task: {', '.join(doubled[:5])}" if doubled else f"{failed[0][0]}: {failed[0][1]}")
        system, base = located(self.path)
        system.create_dir(base, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(base)):
                if f.type == fs.FileType.File and (visible(f.base_name) or f.base_name == FAILURES) and f.base_name not in set(names):
                    system.delete_file(f.path)
        for m in told:
            for at, name, _ in m.files:
                system.move(at, f"{base}/{name}")
        if failed:
            with system.open_output_stream(f"{base}/{FAILURES}") as f:
                f.write("".join(json.dumps({"file_name": n, "error": e}) + "\n" for n, e in failed).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, _ = located(self.path)
        if system.get_file_info(self._temporary()).type != fs.FileType.NotFound:
            system.delete_dir(self._temporary())


def _chunk(batch: pa.RecordBatch, i: int):
    """The chunk in a row; its voxels come from Arrow as they are."""
    head = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "voxels"}
    row = {n: None for n in ("sequenceNumber", "acquisitionNumber", "acquisitionTime", "indexOrigin", "rowVec", "columnVec", "sliceVec", "voxelSize", "voxelGap", "repetitionTime", "props")} | head
    voxels = batch.column("voxels")[i]
    c = chunk_of(row | {"voxels": voxels.values.to_numpy(zero_copy_only=False)})
    return c.usual()


class ChunkReader(DataSourceReader):
    """A partition per file; chunks leave as Arrow batches."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}  # Spark hands names in lower case

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        system, inner = located(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [InputPartition(inner)]
        found = system.get_file_info(fs.FileSelector(inner))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and visible(f.base_name)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.options["path"])
        with system.open_input_stream(partition.value, compression=None) as f:
            chunks, error = decode_file(partition.value, f.read(), self.options.get("suffix", ""), self.options.get("dialect", ""))
        if error and self.options.get("ignoreerrors", "false").lower() != "true":
            raise FormatError(error)
        for k, c in enumerate(chunks):
            b = _arrow([(c.head(partition.value, k), c.voxels, None)])
            yield b.select([n for n in RESULT_ARROW.names if n != "error"])


class ChunkSource(DataSource):
    """``spark.read.format("chunks").option("dialect", ...).load(path)`` and ``df.write.format("chunks").save(path)``.

    Reading: a file, or a member of an archive, that no format reads ends the query, unless the option ``ignoreErrors`` is true.
    Writing: rows of the chunk schema with ``file_name`` and ``lookup`` (other columns by the options ``fileName`` and ``order``); ``formats`` names formats to
    try in turn instead of those of the suffix; what no format takes ends the job, or goes to ``_failures.json`` with ``ignoreErrors``.
    """

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChunkReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(dict(self.options), overwrite)


def write_chunks(chunks: DataFrame, path: str, mode: str = "append", file_name: str = "file_name", order: str = "lookup", **options: str) -> None:
    """Save chunks under their file names; rows of a file meet in one task, in order."""
    chunks.sparkSession.dataSource.register(ChunkSource)
    dealt = chunks.repartition(F.col(file_name)).sortWithinPartitions(file_name, order)
    dealt.write.format("chunks").mode(mode).options(fileName=file_name, order=order, **options).save(path)
