"""Live feed: datagrams with a text header that opens a record and binary parts that follow, put together by acquisition.

A header is ``<data_block_header>`` with ``name=value`` lines (``acquisition``, ``columns``, ``rows``, ``images``, ``data_size_in_bytes`` and
more).  Parts belong to the record of their sender that was opened last.  ``<series_finished>`` ends a series.
"""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HEADER, FINISHED = b"<data_block_header>", b"<series_finished>"
PORT, MOST_BYTES = 54321, 32 << 10
_FIELD = re.compile(r"^\s*([A-Za-z_]\w*)\s*=\s*(.*?)\s*$", re.M)


def parse_header(data: bytes) -> dict[str, str]:
    """Fields of a header datagram."""
    return dict(_FIELD.findall(data[len(HEADER) :].decode("latin-1")))


def header_fields(payload: str = "payload") -> dict:
    """The same as Columns, for a table of header datagrams."""
    text = F.col(payload).cast("string")
    pick = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^\s*{name}\s*=\s*(.*?)\s*$", 1), F.lit(""))
    return {"acquisition": pick("acquisition").try_cast("bigint"), "columns": pick("columns").try_cast("int"), "rows": pick("rows").try_cast("int"), "images": pick("images").try_cast("int"), "size": pick("data_size_in_bytes").try_cast("bigint")}


def untile(values: np.ndarray, columns: int, rows: int, images: int) -> np.ndarray:
    """A square sheet of tiles as slices one after another."""
    across = int(np.ceil(np.sqrt(images)))
    sheet = values.reshape(across * rows, across * columns)
    return sheet.reshape(across, rows, across, columns).transpose(0, 2, 1, 3).reshape(across * across, rows * columns)[:images].reshape(-1)


OUT = "sender string, acquisition long, columns int, rows int, images int, voxels array<float>, complete boolean"
STATE = "acquisition long, columns int, rows int, images int, size long, data binary"


def reassemble(datagrams: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """Records of a stream (or table) of (sender, seq, payload), in the order of ``seq`` inside a batch.

    A record comes out when its bytes are there; one that a new header, the series' end or a timeout cuts short comes out
    with complete = false and no voxels.  State is one open record per sender.  Without a timeout (None) open records wait
    for ever; a query that processes what is there and stops needs that, as a timeout keeps it running.
    """

    def emit(sender: str, s: tuple, complete: bool) -> dict:
        acquisition, columns, rows, images, size, data = s
        voxels = None
        if complete:
            raw = np.frombuffer(data[:size], "<u2").astype(np.float32)
            across = int(np.ceil(np.sqrt(images)))
            voxels = (untile(raw, columns, rows, images) if images > 1 and len(raw) == across * across * rows * columns else raw).tolist()
        return {"sender": sender, "acquisition": acquisition, "columns": columns, "rows": rows, "images": images, "voxels": voxels, "complete": complete}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sender, out = key[0], []
        names = ["sender", "acquisition", "columns", "rows", "images", "voxels", "complete"]
        if timeout_ms is not None and state.hasTimedOut:
            out.append(emit(sender, state.get, False))
            state.remove()
            yield pd.DataFrame(out, columns=names)
            return
        open_record = (*state.get[:5], bytearray(state.get[5])) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for payload in rows["payload"]:
            payload = bytes(payload)
            if payload.startswith(HEADER) or payload.startswith(FINISHED) or not payload:
                if open_record:
                    out.append(emit(sender, open_record, False))
                open_record = None
                if payload.startswith(HEADER):
                    f = parse_header(payload)
                    number = lambda k, d: int(f[k]) if f.get(k, "").lstrip("-").isdigit() else d  # noqa: E731, B023
                    open_record = (number("acquisition", 0), number("columns", 0), number("rows", 0), number("images", 1), number("data_size_in_bytes", 0), bytearray())
                continue
            if open_record:
                open_record[5].extend(payload)  # grows in place, so many parts cost no more than their bytes
                if len(open_record[5]) >= open_record[4]:
                    out.append(emit(sender, open_record, True))
                    open_record = None
        if open_record:
            state.update((*open_record[:5], bytes(open_record[5])))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return datagrams.groupBy("sender").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


class DatagramSource(DataSource):
    """``spark.readStream.format("datagrams").option("port", ...)``: (sender, seq, payload) from a UDP port of the driver."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "sender string, seq long, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _DatagramReader(dict(self.options))


class _DatagramReader(SimpleDataSourceStreamReader):
    """Datagrams can't be asked for again, so what was received is kept until its batch is committed."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.socket, self.kept, self.next = {k.lower(): v for k, v in options.items()}, None, {}, 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def _receive(self) -> None:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind((self.options.get("host", "127.0.0.1"), int(self.options.get("port", PORT))))
            self.socket.setblocking(False)
        for _ in range(int(self.options.get("maxdatagrams", "10000"))):
            try:
                payload, address = self.socket.recvfrom(MOST_BYTES)
            except BlockingIOError:
                break
            self.kept[self.next] = (f"{address[0]}:{address[1]}", self.next, payload)
            self.next += 1

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.next = max(self.next, start["seq"])
        self._receive()
        rows = [self.kept[k] for k in range(start["seq"], self.next) if k in self.kept]
        return iter(rows), {"seq": self.next}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.kept[k] for k in range(start["seq"], end["seq"]) if k in self.kept])

    def commit(self, end: dict) -> None:
        for k in [k for k in self.kept if k < end["seq"]]:
            del self.kept[k]
