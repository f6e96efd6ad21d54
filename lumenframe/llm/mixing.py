"""Mix sources to target weights, by fixed-length blocks.

1. Targets: weights share the total; a target stops at ``max_repeats`` times its source's size and the excess goes to
   the others by weight, until none is above.
2. Blocks: the words of a source, document after document, are cut into blocks of ``block_words``.
3. Draws: every output shard draws multinomial source counts, on condition that all shards together give each source its slots (so
   targets are met to within half a block per source).  Under that condition any range of shards holds a multivariate hypergeometric
   draw of the range twice as large; a shard's counts follow from one seeded draw per halving, so each task finds its own without the others'.
4. Slots: a source's slots are numbered through all shards.  Slot k is block perm(k mod n) of pass k div n, where perm is
   a keyed pseudorandom permutation of that pass (a Feistel network on the next power of four, walked until it falls
   below n).
5. Slots and blocks are joined by (source, block).

The driver holds one row per source, whatever the number of shards.  Every draw is seeded, so reruns agree.  Null text has no words; null source is a source of its own, last in order.
Rows with equal ids count as separate documents.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import running_start, settle

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: Shards that one task fills.
TASK_SHARDS = 256
#: Rows of sources that are broadcast at most.
BROADCAST_SOURCES = 100_000
#: The random generator's limit of slots in one draw; draws from more are made here.
MOST_DRAWN = 10**9 - 1
MAX_REPEATS = 3
SEED = 20240501


@dataclass(frozen=True)
class Source:
    number: int  # rank in code point order, null last
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def word_count(text: Column) -> Column:
    """Words outside ``[\\x20\\x09-\\x0D]``; null has none."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"[\x20\x09-\x0D]+"), F.lit(" "))
    trimmed = F.trim(flat)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: list[int], weights: list[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``max_repeats`` times its size."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = {i for i, n in enumerate(sizes) if n > 0}, total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > max_repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = float(max_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each (n, key), at k."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n = k.astype(np.uint64), n.astype(np.uint64)
    key = key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, y = half[todo], mask[todo], x[todo]
        left, right = y >> h, y & m
        for r in range(6):
            f = (right + key[todo] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f >> np.uint64(29)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _ln_factorial_ratio(n: float, k: float) -> float:
    """ln((n + k)! / n!), by differences of Stirling's series for large n, so that the terms that cancel are never formed."""
    if min(n, n + k) < 1000:
        return math.lgamma(n + k + 1) - math.lgamma(n + 1)
    step = math.log1p(k / n)
    return k * math.log(n) - k + (n + k + 0.5) * step + (1 / (n + k) - 1 / n) / 12


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` from good + bad are good, of any size.

    Within the generator's limit by the generator, else by ratio of uniforms under a hat around the mode: a point is taken with exactly the odds of
    its probability to the mode's, so the draw has the same distribution on both sides of the limit.
    """
    if max(good, bad, drawn) <= MOST_DRAWN and good + bad <= MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, drawn)) if good + bad else 0
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    middle = drawn * (good / total) + 0.5
    spread = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / (total - 1)) + 0.5)
    # half width and shift of the hat that covers every distribution with log-concave odds
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u = 1 - rng.random()
        x = math.floor(middle + width * (rng.random() - 0.5) / u)
        if low <= x <= high:
            k = x - mode
            odds = -sum(_ln_factorial_ratio(n, j) for n, j in ((mode, k), (good - mode, -k), (drawn - mode, -k), (bad - drawn + mode, k)))
            if 2 * math.log(u) <= odds:
                return x


def _half(left: np.ndarray, want: int, rng: np.random.Generator) -> np.ndarray:
    """Of ``left`` slots by source, ``want`` drawn without putting back, source by source from what the ones before left over."""
    rest = int(left.sum())
    if rest <= MOST_DRAWN:
        return rng.multivariate_hypergeometric(left, want, method="marginals")
    out = np.zeros(len(left), np.int64)
    for i, n in enumerate(left.tolist()):
        rest -= n
        out[i] = hypergeometric(n, rest, want, rng)
        want -= int(out[i])
    return out


def shard_total(slots: list[int], shard_slots: int = SHARD_SLOTS) -> int:
    return -(-sum(slots) // shard_slots)


def shard_draw(slots: list[int], shard: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """A shard's number of slots by source, and how many of each source's slots lie in earlier shards."""
    whole, left, before = sum(slots), np.array(slots, np.int64), np.zeros(len(slots), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = _half(left, whole * mid // shards - whole * lo // shards, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            left, hi = first, mid
        else:
            left, before, lo = left - first, before + first, mid
    return left, before


def draws(slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> list[list[int]]:
    """For every shard the number of slots by source."""
    shards = shard_total(slots, shard_slots)
    return [shard_draw(slots, k, shards, seed)[0].tolist() for k in range(shards)]


def source_table(sized: DataFrame, block_words: int, weights: dict[str | None, float] | None, max_repeats: float) -> list[Source]:
    """One row per source; ``sized`` has __source and __size."""
    rows = [(r["__source"], r["n"]) for r in sized.groupBy("__source").agg(F.sum("__size").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    given = [1.0 + i % 3 if weights is None else weights.get(name, 0.0) for i, (name, _) in enumerate(rows)]
    goals = targets([n for _, n in rows], given, max_repeats)
    out = []
    for i, (name, n) in enumerate(rows):
        blocks = -(-n // block_words)
        slots = min(round(goals[i] / n * blocks) if n else 0, int(max_repeats) * blocks)
        out.append(Source(i, name, n, goals[i], blocks, slots))
    return out


@dataclass(frozen=True)
class Mix:
    """sources; documents with their place; pieces of blocks; slots of the output, each with its block."""

    sources: list[Source]
    documents: DataFrame  # the given columns, source_number, size, first_word, row_key
    pieces: DataFrame  # source_number, block, row_key, start, length
    slots: DataFrame  # shard, slot, source_number, pass, block


def mix(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    id_col: str = "doc_id",
    block_words: int = BLOCK_WORDS,
    weights: dict[str | None, float] | None = None,
    max_repeats: float = MAX_REPEATS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> Mix:
    """The plan of a mix; ``weights`` by source (1, 2, 3 in turn by default)."""
    spark = docs.sparkSession
    sized = settle(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("__source"), word_count(F.col(text_col)).alias("__size")))
    sources = source_table(sized, block_words, weights, max_repeats)
    rows = sized.count()
    names = spark.createDataFrame([(s.number, s.name) for s in sources], "source_number int, __name string")
    numbered = sized.join(F.broadcast(names) if len(sources) <= BROADCAST_SOURCES else names, F.col("__source").eqNullSafe(F.col("__name"))).select("doc_id", "source_number", F.col("__size").alias("size"))
    placed = running_start(numbered, ["source_number"], ["doc_id"], "size", rows, "first_word")
    b = F.lit(block_words).cast("long")
    first, last = F.expr(f"first_word div {block_words}L"), F.expr(f"(first_word + size - 1) div {block_words}L")
    block = F.col("block")
    begin = F.greatest(block * b, F.col("first_word"))
    pieces = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(first, last)))
        .select("source_number", "block", "doc_id", "first_word", "size", (begin - F.col("first_word")).alias("start"), (F.least((block + 1) * b, F.col("first_word") + F.col("size")) - begin).alias("length"))
    )
    wanted, blocks = [x.slots for x in sources], np.array([x.blocks for x in sources], np.int64)
    shards = shard_total(wanted, shard_slots)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for shard in x.column(0).to_pylist():
                counts, before = shard_draw(wanted, shard, shards, seed)
                source = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                k = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + before[source]
                n = blocks[source]
                turn = k // np.maximum(n, 1)
                key = (source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(seed)
                columns = [pa.array(np.full(len(source), shard, np.int32)), pa.array(np.arange(len(source), dtype=np.int64)), pa.array(source), pa.array(turn), pa.array(permute(k - turn * n, n, key))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "slot", "source_number", "pass", "block"])

    tasks = max(-(-shards // TASK_SHARDS), min(shards, spark.sparkContext.defaultParallelism), 1)
    slots = spark.range(0, shards, 1, tasks).mapInArrow(filled, "shard int, slot long, source_number int, pass long, block long")
    return Mix(sources, placed, pieces, slots)


def mixed_pieces(m: Mix) -> DataFrame:
    """The output: shard, slot, source_number, pass, block, doc_id, start, length (words of a document)."""
    return m.slots.hint("merge").join(m.pieces, ["source_number", "block"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (of its source), taken (words the mix takes)."""
    spark = docs.sparkSession
    m = mix(docs, **options)
    info = spark.createDataFrame([(s.number, s.size, s.target) for s in m.sources], "source_number int, source_size long, target double")
    uses = m.slots.groupBy("source_number", "block").agg(F.count(F.lit(1)).alias("uses"))
    taken = (
        # slots come from a few rows of shards, which the planner would take for a small table
        m.pieces.join(uses.hint("merge"), ["source_number", "block"])
        # a document with words is known by its first word's place
        .groupBy("source_number", "first_word")
        .agg(F.sum(F.col("uses") * F.col("length")).alias("taken"))
    )
    used = m.documents.filter("size > 0").join(taken, ["source_number", "first_word"], "left").unionByName(m.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return used.join(F.broadcast(info) if len(m.sources) <= BROADCAST_SOURCES else info, "source_number").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, whole.

    taken / size is rounded up or down by a hash of the id, up as often as its fraction says, so that a source's words
    come near its target; it is never above ``max_repeats``.  Rows without words have nothing to weigh and stay once.
    """
    taken = taken_words(docs, id_col=id_col, text_col=text_col, **options)
    # rows of one id and size are alike to the mix: their shares are pooled and split evenly
    share = taken.groupBy("doc_id", "size").agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("__share"))
    chance = F.pmod(F.xxhash64(F.col("__id"), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("__n") == 0, 1).otherwise(F.floor("__share") + F.when(chance < F.col("__share") - F.floor("__share"), 1).otherwise(0)).cast("int")
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__n": word_count(F.col(text_col))})
    joined = keyed.join(share.select(F.col("doc_id").alias("__sid"), F.col("size").alias("__sn"), "__share"), F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__n") == F.col("__sn")))
    repeated = joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return repeated.select(*docs.columns)
