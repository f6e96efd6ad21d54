"""Chroma audio fingerprints and the alignment of recordings.

1. Frames of ``FRAME`` samples, ``HOP`` apart, give the energy of the twelve pitch classes (Hann window, Fourier bins
   assigned to their nearest semitone), smoothed over three frames and normalised.
2. An integral image over (frame, pitch class) makes every box sum four look-ups.  Sixteen filters, each the
   log ratio of two groups of boxes, slide over it; a filter's value is put into one of four ranges (two Gray-coded bits),
   and the bits of a position are packed into one integer.  Filters are dealt out by a rule, and the limits of their ranges are the
   quartiles over a generated recording of ``LIMIT_NOTES`` notes (see ``limits``), so that no bit is predictable.
3. Recordings with equal fingerprints are one class.  Query classes are looked up against all classes by keys of two neighbouring integers, those of queries also
   with the ``DOUBTS`` least sure bits of both flipped in every combination; every hit votes for the pair's offset.  (Single integers have chance hits that
   grow with the square of the recordings; two have next to none.)  Each offset with ``MIN_VOTES`` votes, or one vote for
   every four keys of the shorter fingerprint if that is less, is verified: the share of differing bits over the whole aligned
   stretch is at most ``MAX_BIT_ERROR``, and less for short stretches, four standard deviations under the errors of unrelated ones (about 3 false alarms in 100,000 offsets).  Of a pair's offsets that pass, the one with most votes aligns it (the nearest to 0 of equals).

Integers over silence say nothing and are not looked up.  A fingerprint of a single integer matches equal ones only (as members of its class).  Null or short recordings (under ``FRAME`` samples, or fewer
frames than the widest filter) have an empty fingerprint and no class, and match nothing.  Every row is returned as a member, repeated ones and those
with null or equal ids included; equal ids with different sounds are in different classes.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import settle

RATE, FRAME, HOP = 4000, 1024, 512
LOWEST, HIGHEST = 65.0, 1950.0
WIDTH = 16
#: Weights of the frame before, the frame, and the frame after.
SMOOTHING = (1.0, 2.0, 1.0)
MIN_VOTES, MAX_BIT_ERROR = 2, 0.35
#: Bit errors of unrelated stretches of n integers lie about a half with a deviation of about DEVIATION / sqrt(n): the limit stays SURE deviations below, but
#: needn't go under LEAST_ERROR, as every pair that is tried has equal keys already.
DEVIATION, SURE, LEAST_ERROR = 0.18, 4, 0.1
QUERY_STEP = 20

SHAPES = ("all", "halves_pitch", "halves_time", "cross", "thirds_pitch", "thirds_time")
#: The filters, dealt out by a rule over shapes, places and sizes: shape, first pitch class, pitch classes, frames.
FILTERS = tuple((SHAPES[k % 6], 5 * k % 12, 3 + 3 * k % 5, 4 + 4 * (k % 4)) for k in range(16))
#: Notes of the generated recording on which the limits of the filters' ranges are taken.
LIMIT_NOTES = 4096
#: Chroma is held in units of 1 / SCALE, so that box sums are exact in any order.
SCALE = 1 << 16
#: Bits of each integer of a query that are also looked up flipped, in every combination.
DOUBTS = 2
#: Frames that are worked on at once.
TILE = 1 << 15
NOTES = 24


@functools.cache
def _pitch_matrix(frame: int, rate: int) -> np.ndarray:
    """Fourier bins to pitch classes."""
    freq = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(freq), 12), np.float32)
    used = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    out[used, np.round(12 * np.log2(freq[used] / 440.0)).astype(int) % 12] = 1
    return out


def raw_chroma(samples: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Energies: frames by twelve pitch classes."""
    if len(samples) < frame:
        return np.zeros((0, 12), np.float32)
    views = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32, copy=False), frame)[::hop]
    window, matrix = np.hanning(frame).astype(np.float32), _pitch_matrix(frame, rate)
    return np.concatenate([(np.abs(np.fft.rfft(views[i : i + 512] * window, axis=1)) ** 2).astype(np.float32) @ matrix for i in range(0, len(views), 512)])


def normalised(raw: np.ndarray, frame: int = FRAME) -> np.ndarray:
    """Smoothed over three frames and scaled to length ``SCALE``, in whole numbers; silent frames are all zero."""
    half = len(SMOOTHING) // 2
    padded = np.pad(raw.astype(float), ((half, half), (0, 0)))
    smooth = sum(w * padded[k : k + len(raw)] for k, w in enumerate(SMOOTHING))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.round(SCALE * np.where(norm > 1e-6 * frame, smooth / np.maximum(norm, 1e-300), 0.0)).astype(np.int64)


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    return normalised(raw_chroma(samples, rate))


def integral(features: np.ndarray) -> np.ndarray:
    """The integral image with a zero border; pitch classes are a circle, so they stand there twice."""
    wide = np.concatenate([features, features], axis=1)
    return np.pad(wide.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))


def _box(image: np.ndarray, x0: int, x1: int, y0: int, y1: int, n: int) -> np.ndarray:
    """Sums over frames x0..x1 and classes y0..y1 at n positions."""
    return image[x1 : x1 + n, y1] - image[x0 : x0 + n, y1] - image[x1 : x1 + n, y0] + image[x0 : x0 + n, y0]


def filter_values(image: np.ndarray, shape: str, y: int, h: int, w: int, n: int) -> np.ndarray:
    """Log ratio of the filter's two groups of boxes at n positions; one group is a part of the whole box, the other its rest."""
    box = lambda x0, x1, a, b: _box(image, x0, x1, y + a, y + b, n)
    whole = box(0, w, 0, h)
    if shape == "all":
        part, rest = whole, np.full(n, SCALE * w * h / 12**0.5)
    else:
        if shape == "halves_pitch":
            part = box(0, w, h // 2, h)
        elif shape == "halves_time":
            part = box(w // 2, w, 0, h)
        elif shape == "cross":
            part = box(0, w // 2, h // 2, h) + box(w // 2, w, 0, h // 2)
        elif shape == "thirds_pitch":
            part = box(0, w, h // 3, h - h // 3)
        else:
            part = box(w // 3, w - w // 3, 0, h)
        rest = whole - part
    return np.log((SCALE + part) / (SCALE + rest))


@functools.cache
def limits() -> np.ndarray:
    """Limits of the four ranges of each filter: quartiles over a recording of random notes."""
    features = normalised(note_chroma(np.random.default_rng(LIMIT_NOTES).integers(0, NOTES, LIMIT_NOTES)))
    image, n = integral(features), len(features) - WIDTH + 1
    return np.array([np.round(np.quantile(filter_values(image, *f, n), (0.25, 0.5, 0.75)), 6) for f in FILTERS])


def fingerprint(features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed integers of a chroma image, which of them stand over silence only, and the places of each one's ``DOUBTS`` least
    sure bits (five binary digits each): the bits that flip if the filter's value crosses the limit next to it.
    """
    whole = max(0, len(features) - WIDTH + 1)
    items, silent, doubts = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for at in range(0, whole, TILE):
        n = min(TILE, whole - at)
        image = integral(features[at : at + n + WIDTH - 1])
        out = np.zeros(n, np.int64)
        far, place = np.empty((len(FILTERS), n), np.float32), np.empty((len(FILTERS), n), np.int64)
        for i, (f, limit) in enumerate(zip(FILTERS, limits())):
            values = filter_values(image, *f, n)
            k = np.searchsorted(limit, values)
            out = out << 2 | (k ^ k >> 1)  # Gray code
            gaps = np.abs(values[:, None] - limit)
            nearest = gaps.argmin(axis=1)
            far[i] = gaps[np.arange(n), nearest] / (limit[2] - limit[0])
            place[i] = 2 * (len(FILTERS) - 1 - i) + (nearest == 1)
        least = np.argsort(far, axis=0, kind="stable")[:DOUBTS]
        packed = np.zeros(n, np.int64)
        for row in np.take_along_axis(place, least, axis=0):
            packed = packed << 5 | row
        items.append(out)
        silent.append(_box(image, 0, WIDTH, 0, 12, n) == 0)
        doubts.append(packed)
    return np.concatenate(items), np.concatenate(silent), np.concatenate(doubts)


@functools.cache
def _tone_table(rate: int, note: int) -> np.ndarray:
    t = np.arange(note) / rate
    fade = np.minimum(1, np.minimum(np.arange(note), np.arange(note)[::-1]) / 32)
    return np.array([(np.sin(2 * np.pi * f * t) + 0.4 * np.sin(4 * np.pi * f * t)) * fade for f in 220 * 2 ** (np.arange(NOTES) / 12)], np.float32)


def notes_of(words: list[bytes]) -> np.ndarray:
    """A note for each word, drawn from two octaves by the word's checksum."""
    return np.array([zlib.crc32(w) % NOTES for w in words], np.int64)


def tones(words: list[bytes], rate: int = RATE, note: int = HOP) -> np.ndarray:
    """A deterministic recording of words: one tone each."""
    return _tone_table(rate, note)[notes_of(words)].ravel()


@functools.cache
def _pair_chroma() -> np.ndarray:
    """Energies of a frame over each pair of notes."""
    table = _tone_table(RATE, HOP)
    return np.array([[raw_chroma(np.concatenate([a, b]))[0] for b in table] for a in table])


def note_chroma(notes: np.ndarray) -> np.ndarray:
    """``raw_chroma`` of the notes' recording: a frame is two notes long, so its spectrum is one of a table."""
    return _pair_chroma()[notes[:-1], notes[1:]] if len(notes) > 1 else np.zeros((0, 12), np.float32)


def pcm16(data: bytes) -> np.ndarray:
    """Little-endian 16-bit mono samples."""
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768


def fingerprints(recordings: DataFrame, id_cols: list[str], audio_col: str, energies: Callable[[object], np.ndarray] = lambda data: raw_chroma(pcm16(data))) -> DataFrame:
    """The id columns (as long), items, silent and doubts per row; ``energies`` makes raw chroma of a value of ``audio_col``."""
    ids = [x for x in id_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 12), np.float32)
        for b in batches:
            items, silent, doubts = [], [], []
            group: list[np.ndarray] = []

            def finish() -> None:
                """All rows of the group at once: silence of the smoothing's width stands between them."""
                if not group:
                    return
                gap = np.zeros((2, 12), np.float32)
                parts = [x for raw in group for x in (raw, gap)]
                found, quiet, unsure = fingerprint(normalised(np.concatenate(parts)))
                at = 0
                for raw in group:
                    n = max(0, len(raw) - WIDTH + 1)
                    items.append(found[at : at + n])
                    silent.append(quiet[at : at + n])
                    doubts.append(unsure[at : at + n])
                    at += len(raw) + len(gap)
                group.clear()

            frames = 0
            for value in b.column(len(ids)):
                v = value.as_py()
                raw = energies(v) if v is not None else none
                if frames + len(raw) > TILE:
                    finish()
                    frames = 0
                group.append(raw)
                frames += len(raw)
            finish()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(ids)], pa.array(items, pa.list_(pa.int64())), pa.array(silent, pa.list_(pa.bool_())), pa.array(doubts, pa.list_(pa.int64()))], names=[*ids, "items", "silent", "doubts"])

    schema = ", ".join([*(f"{c} long" for c in ids), "items array<long>", "silent array<boolean>", "doubts array<long>"])
    return recordings.select(*[F.col(c).cast("long").alias(c) for c in ids], F.col(audio_col).alias("audio")).mapInArrow(run, schema)


def error_limit(overlap: int, most: float = MAX_BIT_ERROR) -> float:
    """The largest share of differing bits of an alignment over ``overlap`` integers."""
    return min(most, max(LEAST_ERROR, 0.5 - SURE * DEVIATION / overlap**0.5))


def align(prints: DataFrame, is_query: Column, min_votes: int = MIN_VOTES, max_bit_error: float = MAX_BIT_ERROR) -> DataFrame:
    """Members and matches over settled ``prints`` (id columns, items, silent, doubts).

    A row (id columns, class_id, n_items) per recording, its other columns null; and a row per match of a query class with another
    class, its id columns null: class_id of the query class, match_id, offset (place in the match minus place in the
    query), votes, overlap, bit_error.  A class_id is the first 128 bits of a SHA-256 of the fingerprint.
    """
    ids = [c for c in prints.columns if c not in ("items", "silent", "doubts")]
    text = F.concat_ws(",", F.transform(F.arrays_zip("items", "silent"), lambda x: F.concat(x["items"].cast("string"), F.when(x["silent"], "-").otherwise(""))))
    named = prints.withColumn("class_id", F.when(F.size("items") > 0, F.substring(F.sha2(text, 256), 1, 32)))
    members = named.select(*ids, "class_id", F.size("items").cast("long").alias("n_items"))
    # a class has one fingerprint, so any of its rows will do
    own = named.filter("class_id is not null").groupBy("class_id").agg(F.max(F.coalesce(is_query, F.lit(False))).alias("asks"), F.first(F.struct("items", "silent", "doubts")).alias("f")).select("class_id", "asks", "f.*")
    own = settle(own)
    pairs = F.expr("transform(sequence(0, size(items) - 2), i -> struct(i as at, items[i] as x, items[i + 1] as y, doubts[i] as u, doubts[i + 1] as v, silent[i] or silent[i + 1] as quiet))")
    each = own.filter(F.size("items") > 1).select("class_id", "asks", F.size("items").alias("n"), F.explode(pairs).alias("p")).filter("not p.quiet")
    each = each.select("class_id", "asks", "n", F.col("p.at").alias("at"), F.expr("shiftleft(p.x, 32) | p.y").alias("key"), "p.u", "p.v")
    flips = [F.lit(0).cast("long")]
    for doubts, above in (("u", 32), ("v", 0)):
        for k in range(DOUBTS):
            bit = F.expr(f"shiftleft(1L, cast((shiftright({doubts}, {5 * k}) & 31) + {above} as int))")
            flips += [f.bitwiseXOR(bit) for f in flips]
    ask = each.filter("asks").select(F.col("class_id").alias("q"), F.col("n").alias("q_n"), F.col("at").alias("q_at"), "key", F.explode(F.array(*flips)).alias("flip")).withColumn("key", F.col("key").bitwiseXOR(F.col("flip"))).drop("flip")
    hit = ask.join(each.select(F.col("class_id").alias("r"), F.col("n").alias("r_n"), F.col("at").alias("r_at"), "key"), "key").filter("q <> r")
    least = F.least(F.lit(min_votes), F.ceil((F.least(F.first("q_n"), F.first("r_n")) - 1) / 4))
    votes = hit.groupBy("q", "r", (F.col("r_at") - F.col("q_at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes"), least.alias("least")).filter(F.col("votes") >= F.col("least")).drop("least")
    left, right = own.select(F.col("class_id").alias("q"), F.col("items").alias("q_items")), own.select(F.col("class_id").alias("r"), F.col("items").alias("r_items"))
    start = F.greatest(-F.col("offset"), F.lit(0))
    overlap = F.least(F.size("q_items"), F.size("r_items") - F.col("offset")) - start
    placed = votes.join(left, "q").join(right, "r").withColumns({"start": start, "overlap": overlap})
    bits = F.aggregate(
        F.zip_with(F.slice("q_items", F.col("start") + 1, F.col("overlap")), F.slice("r_items", F.col("start") + F.col("offset") + 1, F.col("overlap")), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    checked = placed.select("q", "r", "offset", "votes", "overlap", F.size("q_items").cast("long").alias("n_items"), (bits / (2.0 * len(FILTERS) * F.col("overlap"))).alias("bit_error")).filter(F.col("bit_error") <= F.least(F.lit(max_bit_error), F.greatest(F.lit(LEAST_ERROR), 0.5 - SURE * DEVIATION / F.sqrt("overlap"))))
    best = checked.groupBy("q", "r").agg(F.max(F.struct("votes", (-F.abs("offset")).alias("near"), "offset", "overlap", "n_items", "bit_error")).alias("b")).select("q", "r", "b.*")
    none = {"match_id": "string", "offset": "long", "votes": "long", "overlap": "long", "bit_error": "double"}
    return members.withColumns({k: F.lit(None).cast(t) for k, t in none.items()}).unionByName(
        best.select(*[F.lit(None).cast("long").alias(c) for c in ids], F.col("q").alias("class_id"), "n_items", F.col("r").alias("match_id"), F.col("offset").cast("long").alias("offset"), "votes", F.col("overlap").cast("long").alias("overlap"), "bit_error")
    )


def spoken_turns(conversations: DataFrame) -> DataFrame:
    """Fingerprints of conversation turns (conv_id, turn) as tones, one for each word of their text."""
    return fingerprints(conversations, ["conv_id", "turn"], "text", lambda text: note_chroma(notes_of(text.encode("utf-8", "surrogatepass").split())))
