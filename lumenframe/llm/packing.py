"""Best-fit packing of token sequences into fixed-length bins.

Documents longer than the capacity are cut into full pieces and a rest.  Only lengths decide a packing, so the plan is
made from the histogram of piece lengths: at most ``capacity`` counters, whatever the corpus holds.

1. Large items (above a third of the capacity): at most two fit one bin.  From the longest down, each takes the
   longest other large item that still fits beside it (greedy matching).
2. Smaller items, from the longest down, go to the bin with the smallest gap that holds them (best fit).
   Equal bins are kept as one run with a count, so that a step places a whole run of equal pieces.

The plan is a short table of runs.  Each piece learns its place from its rank among the pieces of equal length, which
comes from bucket sums and never from one sorted group.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrowtext as A
from lumenframe.llm.tables import running_start, settle

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps between batches, at most.
CACHED_WORDS = 1 << 19
#: Bytes of text that are tokenised at once.
TOKEN_CHUNK = 1 << 20


@dataclass(frozen=True)
class Run:
    """``count`` pieces of one length, ``per_bin`` in each bin from ``first_bin`` on, the first at ``offset``."""

    length: int
    first_rank: int
    count: int
    first_bin: int
    per_bin: int
    offset: int


@dataclass
class _Bins:
    """Equal open bins: consecutive numbers, one fill level."""

    first: int
    count: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that place every piece of the histogram (length -> count)."""
    runs: list[Run] = []
    ranks = dict.fromkeys(histogram, 0)
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(k < 1 or k > capacity for k in left):
        raise ValueError("piece lengths must be between 1 and the capacity")
    open_bins: dict[int, list[_Bins]] = {}
    bins = 0

    def put(length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        runs.append(Run(length, ranks[length], count, first_bin, per_bin, offset))
        ranks[length] += count

    def keep(gap: int, first: int, count: int) -> None:
        if gap and count:
            open_bins.setdefault(gap, []).append(_Bins(first, count))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for k in large:
        while left[k]:
            mate = next((m for m in large if m <= k and m + k <= capacity and left[m] > (m == k)), None)
            if mate is None:
                n = left[k]
                put(k, n, bins, 1, 0)
                left[k] = 0
                keep(capacity - k, bins, n)
            elif mate == k:
                n = left[k] // 2
                put(k, 2 * n, bins, 2, 0)
                left[k] -= 2 * n
                keep(capacity - 2 * k, bins, n)
            else:
                n = min(left[k], left[mate])
                put(k, n, bins, 1, 0)
                put(mate, n, bins, 1, k)
                left[k] -= n
                left[mate] -= n
                keep(capacity - k - mate, bins, n)
            bins += n
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        gaps = sorted(open_bins)
        at = bisect.bisect_left(gaps, k)
        while left[k]:
            if at == len(gaps):  # no gap is left for it
                per = capacity // k
                n = left[k] // per
                if n:
                    put(k, n * per, bins, per, 0)
                    left[k] -= n * per
                    keep(capacity - per * k, bins, n)
                    bins += n
                if left[k]:
                    put(k, left[k], bins, left[k], 0)
                    keep(capacity - left[k] * k, bins, 1)
                    left[k] = 0
                    bins += 1
                break
            gap = gaps[at]
            stack = open_bins[gap]
            per = gap // k
            while stack and left[k]:
                group = stack.pop()
                n = min(group.count, left[k] // per)
                if n:
                    put(k, n * per, group.first, per, capacity - gap)
                    left[k] -= n * per
                    keep(gap - per * k, group.first, n)
                    group = _Bins(group.first + n, group.count - n)
                if group.count and left[k] and left[k] < per:
                    put(k, left[k], group.first, left[k], capacity - gap)
                    keep(gap - left[k] * k, group.first, 1)
                    left[k] = 0
                    group = _Bins(group.first + 1, group.count - 1)
                if group.count:
                    stack.append(group)
            if not stack:
                open_bins.pop(gap, None)
            at += 1
    return runs


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[]^_`{}~"]] = True
#: Longest run of trailing punctuation that is looked up apart from its word.
TAIL_BYTES = 4
#: Stands between words that are encoded in one call; words with control characters are encoded alone.
_DELIMITER = "\x01"


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans whose ids don't depend on their neighbours: words, without a short tail of punctuation, and such tails.

    A tail is cut only behind a letter or digit (ASCII, or a letter of the Latin-1 block), where every pre-tokenizer
    that separates letters from other signs has a boundary anyway.
    """
    starts, ends, first = A.word_spans(data, offsets)
    if not len(starts):
        return starts, ends, first
    cut, at = ends.copy(), np.arange(len(ends))
    for _ in range(TAIL_BYTES):
        at = at[(cut[at] > starts[at]) & _TAIL[data[cut[at] - 1]]]
        cut[at] -= 1
    some = np.flatnonzero((cut < ends) & (cut > starts))
    last, before = data[cut[some] - 1], data[np.maximum(cut[some] - 2, starts[some])]
    latin = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (cut[some] - 2 >= starts[some])
    some = some[_ALNUM[last] | latin]
    extra = np.zeros(len(starts) + 1, np.int64)
    extra[some + 1] = 1
    shift = np.cumsum(extra)
    place = np.arange(len(starts)) + shift[:-1]
    out_s, out_e = np.empty(len(starts) + len(some), np.int64), np.empty(len(starts) + len(some), np.int64)
    out_s[place], out_e[place] = starts, ends
    out_e[place[some]] = cut[some]
    out_s[place[some] + 1], out_e[place[some] + 1] = cut[some], ends[some]
    return out_s, out_e, first + shift[first]


class WordIds:
    """Token ids of whole texts, by way of each distinct word once.

    It fits tokenizers that drop white space and never join what stands on its two sides (their pre-tokenizer splits
    there), so a text's ids are those of its words in order.  ``tests`` hold it against whole-text encoding.
    Known words stand in an open-addressing table of fixed size, which a worker keeps between its tasks.
    """

    BITS = 20

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.slot_key = np.zeros(1 << self.BITS, np.uint64)
        self.slot_word = np.zeros(1 << self.BITS, np.int32)
        self.starts, self.lengths = np.zeros(CACHED_WORDS, np.int32), np.zeros(CACHED_WORDS, np.int32)
        self.words = 0
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        delimiter = self.tokenizer.encode(_DELIMITER, add_special_tokens=False).ids
        self.delimiter = delimiter[0] if len(delimiter) == 1 else None

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each known word, -1 for others."""
        at = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        key = self.slot_key[at]
        out = np.where(key == h, self.slot_word[at], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)
            key = self.slot_key[at[todo]]
            hit = key == h[todo]
            out[todo[hit]] = self.slot_word[at[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return out

    def _add(self, h: np.ndarray, numbers: np.ndarray) -> None:
        at = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.slot_key[at[todo]] == 0
            _, winner = np.unique(np.where(free, at[todo], -1 - np.arange(len(todo))), return_index=True)
            winner = winner[free[winner]]
            self.slot_key[at[todo[winner]]] = h[todo[winner]]
            self.slot_word[at[todo[winner]]] = numbers[todo[winner]]
            lost = np.ones(len(todo), bool)
            lost[winner] = False
            todo = todo[lost]
            at[todo] = (at[todo] + 1) & ((1 << self.BITS) - 1)

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and each word's number of ids."""
        alone = [i for i, w in enumerate(words) if self.delimiter is None or not w.isprintable() or "<|" in w]
        odd = [words[i] for i in alone]
        for i in alone:
            words[i] = ""
        joined = [f" {_DELIMITER} ".join([*words[k : k + 1024], ""]) for k in range(0, len(words), 1024)]
        ids = np.concatenate([np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in joined])
        if self.delimiter is None:
            ids, lengths = ids[:0], np.zeros(len(words), np.int64)
        else:
            marks = np.flatnonzero(ids == self.delimiter)
            ids, lengths = np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        if odd:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            place = np.repeat(np.cumsum(lengths)[alone], [len(x) for x in coded])
            ids = np.insert(ids, place, [i for x in coded for i in x])
            lengths[alone] = [len(x) for x in coded]
        return ids.astype(np.uint32, copy=False), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and each row's first (one more than rows)."""
        starts, ends, first = units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        h = A.span_hashes(data, starts, ends, lower=False)
        h[h == 0] = 1
        number = self._find(h)
        unknown = np.flatnonzero(number < 0)
        begin, length = self.starts, self.lengths
        pool = self.pool
        if len(unknown):
            keys, where, inverse = np.unique(h[unknown], return_index=True, return_inverse=True)
            source = unknown[where]
            ids, n = self._tokenized(A.strings(data, starts[source], ends[source]).to_pylist())
            if self.words + len(keys) <= CACHED_WORDS:
                number[unknown] = self.words + inverse
                self._remember(keys, ids, n)
                begin, length, pool = self.starts, self.lengths, self.pool
            else:
                number[unknown] = self.words + inverse
                pool = np.concatenate([self.pool[: self.used], ids])
                begin = np.concatenate([self.starts[: self.words], self.used + np.cumsum(n) - n])
                length = np.concatenate([self.lengths[: self.words], n])
        n = length[number].astype(np.int64)
        to = np.cumsum(n)
        index = np.repeat(begin[number] - (to - n), n) + np.arange(to[-1])
        return pool[index], np.concatenate([[0], to])[first]

    def _remember(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], ids, np.zeros(self.used + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        new = slice(self.words, self.words + len(keys))
        self.starts[new] = self.used + np.cumsum(n) - n
        self.lengths[new] = n
        self._add(keys, np.arange(self.words, self.words + len(keys), dtype=np.int32))
        self.words += len(keys)
        self.used += len(ids)


_coders: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's coder for a tokenizer file."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = WordIds(path)
    return _coders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, CRC-32 of its ids (and ``ids``).

    A document is the ids of its text and one ``end_id``; a null or empty text is ``end_id`` alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path)
        for b in batches:
            doc_ids = b.column(0).to_numpy(zero_copy_only=False) if not b.column(0).null_count else np.array(b.column(0).to_pylist(), dtype=object)
            data, offsets = A.utf8(b.column(1))
            for i, j, part, off in A.chunks(data, offsets, TOKEN_CHUNK):
                ids, first = coder.encode(part, off)
                ids, first = ids.astype("<u4", copy=False), first.tolist()
                docs_out, piece_out, start_out, length_out, crc_out, ids_out = [], [], [], [], [], []
                end = np.array([end_id], "<u4")
                for k in range(j - i):
                    own = np.concatenate([ids[first[k] : first[k + 1]], end])
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        x = own[start : start + capacity]
                        docs_out.append(doc_ids[i + k])
                        piece_out.append(piece)
                        start_out.append(start)
                        length_out.append(len(x))
                        crc_out.append(zlib.crc32(x.tobytes()))
                        if with_ids:
                            ids_out.append(x.astype(np.int64))
                columns = [pa.array(docs_out, pa.int64()), pa.array(piece_out, pa.int32()), *(pa.array(x, pa.int64()) for x in (start_out, length_out, crc_out))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns with ``length``, and doc_id, piece) with sequence_id and offset.

    The histogram of lengths that comes to the driver has ``capacity`` rows at most.  Pieces are read twice, so give
    a settled table.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.first_rank))
    table = {name: np.array([getattr(r, name) for r in runs], np.int64) for name in ("length", "first_rank", "first_bin", "per_bin", "offset")}
    order = table["length"] * (1 << 42) + table["first_rank"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        k = np.searchsorted(order, n * (1 << 42) + r, "right") - 1
        d = r - table["first_rank"][k]
        return pd.DataFrame({"sequence_id": table["first_bin"][k] + d // table["per_bin"][k], "offset": table["offset"][k] + d % table["per_bin"][k] * n})

    rows = sum(histogram.values())
    ranked = running_start(pieces.withColumn("__one", F.lit(1)), ["length"], ["doc_id", "piece"], "__one", rows, "__rank")
    return ranked.withColumn("__p", place("length", "__rank")).select(*pieces.columns, "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset.

    Rows with equal ids and texts are packed as often as they stand there.  An empty table gives an empty result.
    Only the id and text columns are read.
    """
    return pack(settle(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)), capacity)
