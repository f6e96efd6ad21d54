"""Live feed as chunks: records put together from datagrams, untiled, with geometry and properties from their headers.

State is an open record's header (one small value) and a list of its parts.  Every batch only appends the parts that came, so a record that is
spread over many batches writes each byte once; the list is read when the record is whole.  Open records end by a timer of their sender.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), as only that one keeps lists.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenframe.sources.model import SCHEMA, Chunk
from lumenframe.streaming.datagrams import FINISHED, HEADER, untile

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = SCHEMA + ", complete boolean"

_LINE = re.compile(r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", re.M)
_TAG = re.compile(r"<([A-Za-z_]\w*)>\s*\n(.*?)\n\s*</\1>", re.S)

# Numpy types of the feed's data types; the order and signs of directions by slice orientation and phase direction
# (row and column are each the read or phase vector, times signs); the axis along which slices are ordered; genders by number.
DATA_TYPES = {"byte": "u1", "short": "<u2", "long": "<u4", "float": "<f4"}
DIRECTIONS = {
    ("TRANSVERSE", "COL"): (("phase", (-1, -1, -1)), ("read", (-1, 1, 1))),
    ("TRANSVERSE", "ROW"): (("read", (1, 1, 1)), ("phase", (1, 1, 1))),
    ("SAGITTAL", "COL"): (("phase", (1, 1, 1)), ("read", (1, 1, 1))),
    ("SAGITTAL", "ROW"): (("read", (1, 1, 1)), ("phase", (-1, -1, -1))),
    ("CORONAL", "COL"): (("phase", (1, 1, 1)), ("read", (-1, -1, -1))),
    ("CORONAL", "ROW"): (("read", (1, 1, 1)), ("phase", (1, 1, 1))),
}
SLICE_AXIS = {"TRANSVERSE": 2, "SAGITTAL": 0, "CORONAL": 1}
GENDERS = {1: "female", 2: "male"}
#: Added to the sequence number of motion-corrected series, so that they are series of their own.
CORRECTED = 10_000


def header(data: bytes) -> dict[str, str]:
    """Fields of a header: tags on lines of their own around a value, or name=value lines."""
    text = data.decode("latin-1")
    body = text[len(HEADER) :] if data.startswith(HEADER) else text
    return {k: v.strip() for k, v in _TAG.findall(body)} | dict(_LINE.findall(body))


def _number(f: dict[str, str], name: str, default: float = 0.0) -> float:
    m = re.match(r"\s*[-+]?\d+(\.\d*)?([eE][-+]?\d+)?", f.get(name, ""))
    return float(m[0]) if m else default


def _vector(text: str | None) -> tuple[float, float, float] | None:
    parts = [p for p in re.split(r"[,\s]+", (text or "").strip()) if p]
    try:
        return tuple(float(p) for p in parts) if len(parts) == 3 else None  # type: ignore[return-value]
    except ValueError:
        return None


def record_size(f: dict[str, str]) -> int:
    return int(_number(f, "data_size_in_bytes"))


def geometry(f: dict[str, str], width: int, height: int, images: int) -> dict:
    """Directions, origin, voxel size and gap; what the header doesn't tell stays at its default."""
    plane = f.get("slice_orientation", "").strip().upper()
    straight = abs(int(_number(f, "inplane_rotation"))) < math.pi / 4
    phase = "COL" if straight == (plane == "TRANSVERSE") else "ROW"
    out: dict = {"InPlanePhaseEncodingDirection": phase}
    vectors = {"read": _vector(f.get("read_vector")), "phase": _vector(f.get("phase_vector"))}
    normal, fov = _vector(f.get("slice_norm_vector")), {"read": int(_number(f, "fov_read")), "phase": int(_number(f, "fov_phase"))}
    thick = _number(f, "slice_thickness")
    if normal:
        out["sliceVec"] = normal
    if (plane, phase) not in DIRECTIONS or None in vectors.values():
        return out
    (row_of, row_sign), (column_of, column_sign) = DIRECTIONS[plane, phase]
    row, column = (tuple(x * s for x, s in zip(vectors[k], sign, strict=True)) for k, sign in ((row_of, row_sign), (column_of, column_sign)))
    out |= {"rowVec": row, "columnVec": column}
    # columns span the other field of view than their direction's name says
    across, down = fov[column_of], fov[row_of]
    out["voxelSize"] = (across / max(1, width), down / max(1, height), thick)
    places = [p for p in (_vector(f.get(f"slice_position_{k}")) for k in range(max(1, images))) if p]
    if places:
        axis = SLICE_AXIS[plane]
        low, high = min(places, key=lambda p: p[axis]), max(places, key=lambda p: p[axis])
        out["indexOrigin"] = tuple(x - r * across / 2 - c * down / 2 for x, r, c in zip(low, row, column, strict=True))
        if images > 1:
            out["voxelGap"] = (0.0, 0.0, math.dist(low, high) / (images - 1) - thick)
    return out


def chunk(f: dict[str, str], data: bytes | None, sender: str) -> tuple:
    """A row of the chunk schema and whether it is complete."""
    mosaic, moved = f.get("mosaic", "").lower() == "yes", f.get("motion_corrected", "").lower() == "yes"
    width, height = int(_number(f, "width", _number(f, "columns"))), int(_number(f, "height", _number(f, "rows")))
    images = max(1, int(_number(f, "images_in_mosaic", _number(f, "images", 1))))
    across = math.ceil(math.sqrt(images))
    if mosaic:
        width, height = width // across, height // across
    g = geometry(f, width, height, images)
    props = {"subjectName": f.get("patient_name", ""), "subjectGender": GENDERS.get(int(_number(f, "patient_sex")), "other"), "sequenceDescription": f.get("sequence_description", ""), "InPlanePhaseEncodingDirection": g.pop("InPlanePhaseEncodingDirection")}
    props["DICOM/ImageType"] = ("MOCO\\WAS_MOSAIC" if moved else "WAS_MOSAIC") if mosaic else ""
    voxels, complete = np.zeros(0), data is not None
    if complete:
        kind = np.dtype(DATA_TYPES.get(f.get("data_type", "short").strip().lower(), "<u2"))
        raw = np.frombuffer(data[: len(data) // kind.itemsize * kind.itemsize], kind).astype(np.float32)
        if images > 1 and raw.size == across * across * width * height:
            raw = untile(raw, width, height, images)
        complete = raw.size == width * height * images
        voxels = raw if complete else voxels
    number = int(_number(f, "meas_uid")) + (CORRECTED if moved and mosaic else 0)
    c = Chunk(voxels, (width, height, images, 1), "float", number, int(_number(f, "acquisition_number", _number(f, "acquisition"))), repetitionTime=_number(f, "repetition_time") or None, props=props, **g)
    return (*c.row(sender, 0), complete)


_NAMES = [p.split()[0] for p in re.split(r",\s*(?![^<]*>)", OUT)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    plain = lambda v, n: dict(zip("crst" if n == "dims" else "xyz", v, strict=True)) if isinstance(v, tuple) else v
    return pd.DataFrame([[plain(v, n) for n, v in zip(_NAMES, r, strict=True)] for r in rows], columns=_NAMES)


class Assembler(StatefulProcessor):
    """Datagrams of a sender in, chunks out."""

    def __init__(self, timeout_ms: int | None) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "fields string, size long, have long")
        self.parts = handle.getListState("parts", "payload binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sender, out = key[0], []
        fields, size, have, stored = None, 0, 0, False  # stored: parts of the open record stand in the state
        if self.open.exists():
            text, size, have = self.open.get()
            fields, stored = json.loads(text), have > 0
        new: list[bytes] = []

        def end(complete: bool) -> None:
            nonlocal fields, stored, new
            data = None
            if complete:
                data = (b"".join(bytes(p[0]) for p in self.parts.get()) if stored else b"") + b"".join(new)
            out.append(chunk(fields, data[:size] if complete else None, sender))
            if stored:
                self.parts.clear()
            fields, stored, new = None, False, []

        for payload in pd.concat(list(rows)).sort_values("seq", kind="stable")["payload"]:
            payload = bytes(payload)
            if payload.startswith((HEADER, FINISHED)) or not payload:
                if fields is not None:
                    end(False)
                if payload.startswith(HEADER):
                    fields, have, new = header(payload), 0, []
                    size = record_size(fields)
            elif fields is not None:
                new.append(payload)
                have += len(payload)
                if have >= size:
                    end(True)
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if fields is None:
            self.open.clear()
        else:
            self.open.update((json.dumps(fields), size, have))
            if new:
                self.parts.appendList([(p,) for p in new])
            if self.timeout_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            out.append(chunk(json.loads(self.open.get()[0]), None, key[0]))
            self.open.clear()
            self.parts.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def chunks(datagrams: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """Chunks of a stream of (sender, seq, payload), in the order of ``seq`` inside a batch, and whether they are complete.

    A record that a new header, the series' end or a timer cuts short comes out without voxels and with complete = false.  Without a
    timeout (None) open records wait for ever.
    """
    if datagrams.sparkSession.conf.get(STORE) != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    return datagrams.groupBy("sender").transformWithStateInPandas(Assembler(timeout_ms), OUT, "Append", "None" if timeout_ms is None else "ProcessingTime")


class rocks_state:
    """The state store with lists, for the streams started in a ``with`` block."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(STORE, self.before)
