"""Near-duplicate groups by circulant MinHash, banding, and exact Jaccard on full shingle sets.

Circulant MinHash needs two permutations only.  The first scatters the shingles over a universe of 2**20 places; the
second gives every place a rank.  Coordinate k is the least rank over the set after the second permutation has been
shifted circularly by k places, so one table serves all coordinates.

1. Texts with the same words are one class; its smallest id stands for it.  Everything below is on classes.
2. Bands of the signature are keys.  A document's weight is the size of all its buckets together; the original of a
   group of copies is nearest to all of them and has the largest.  The heaviest document leads a bucket.  Each document
   is verified with the leader it shares most bands with, components are formed, and those not yet joined to their
   other leaders are verified with these too.
3. Pairs of a bucket in different components are left.  Their members are compared by how they differ from the bucket's
   leader: two texts can only be linked if these differences share a known number of shingles, so a join on the first
   shingles of each difference finds every pair that may be linked (a prefix filter, exact).  Thousands of copies that
   each lie just outside the threshold of all others share next to nothing there, and no pairs come of them.
4. Those pairs are verified, and components are formed again.

Verification compares full sets (64-bit hashes of five-word shingles), never signatures.  There are as many bands as the
threshold needs: a pair at it is missed with probability ``MISSED`` at most ((1 - 0.85**7)**24 = 9e-5 at 85 %, and
(1 - 0.8**7)**40 = 8e-5 at 80 %), more similar ones less often; groups have other paths.

Null or empty texts (and texts without words) have an empty set, link with nothing and are kept.  Rows with equal ids
are one node: linked with all that any of them links with, and each row is returned.  A null id links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrowtext as A
from lumenframe.llm.tables import SharedTable, packed, settle

SHINGLE_WORDS = 5
#: Of the operator and the pipeline's stage; the registered query's contract has its own.
THRESHOLD_PERCENT, QUERY_PERCENT = 80, 85
BAND_ROWS = 7
#: Probability, at most, that a pair at the threshold shares no band.
MISSED = 1e-4
UNIVERSE_BITS = 20
#: Copies of a hub's text, one for about so many of its pairs.
PAIRS_PER_COPY = 64
#: Ids of 8 bytes that are broadcast at most; more are joined by key.
BROADCAST_IDS = 500_000
#: Tasks that the copies of one text are dealt to.
CLASS_SALTS = 16

_ranks: list[np.ndarray] = []


def _rank_table(coordinates: int) -> np.ndarray:
    """The second permutation, continued past its end so that a shift is a plain offset."""
    if not _ranks or len(_ranks[0]) < (1 << UNIVERSE_BITS) + coordinates:
        table = np.random.default_rng(97).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        _ranks[:] = [np.concatenate([table, table[:coordinates]])]
    return _ranks[0]


def bands_for(percent: int, rows: int = BAND_ROWS) -> int:
    """The least number of bands that miss a pair at the threshold with probability ``MISSED`` at most."""
    shared = min(1 - 1e-9, (percent / 100) ** rows)
    return max(1, math.ceil(math.log(MISSED) / math.log1p(-shared)))


def shingles(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes of a word sequence, sorted; a shorter sequence is one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(A.window_hashes(words, min(width, len(words))))


def signatures(sets: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each set (sets follow each other in ``sets``; none is empty)."""
    table = _rank_table(coordinates)
    place = (sets >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)  # first permutation: the hash's own order
    out = np.empty((coordinates, len(starts)), np.uint32)
    for k in range(coordinates):
        out[k] = np.minimum.reduceat(table[place + k], starts)
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    h = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        h = (h + parts[:, :, r]) * np.uint64(0xA24BAED4963EE407) + np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return A.mix64(h + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = A.word_spans(data, offsets)
    h = A.span_hashes(data, starts, ends)
    return [shingles(h[first[i] : first[i + 1]]) for i in range(len(offsets) - 1)]


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int = BAND_ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit digest of its words and its band keys (both null without words).

    This is the one pass over all texts; what follows works on its short rows and on the texts of candidates.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            data, offsets = A.utf8(b.column(1))
            counts, digests, keys = [], [], []
            for _, _, part, off in A.chunks(data, offsets):
                starts, ends, first = A.word_spans(part, off)
                h = A.span_hashes(part, starts, ends)
                own = [h[first[i] : first[i + 1]] for i in range(len(off) - 1)]
                sets = [shingles(w) for w in own]
                some = [s for s in sets if len(s)]
                lengths = np.array([len(s) for s in some], np.int64)
                if some:
                    k = band_keys(signatures(np.concatenate(some), np.cumsum(lengths) - lengths, bands * rows), bands, rows).view(np.int64)
                    keys += list(k)
                counts += [len(s) for s in sets]
                digests += [xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None for w in own]
            given = iter(keys)
            lists = pa.array([None if d is None else next(given) for d in digests], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _with_text(pairs: DataFrame, side: str, out: str, docs: DataFrame) -> DataFrame:
    """Join the text of ``side`` to pairs; a document with many pairs is copied, one copy for some of them."""
    salted = pairs.groupBy(F.col(side).alias("__id")).agg(F.expr(f"cast((count(1) + {PAIRS_PER_COPY - 1}) div {PAIRS_PER_COPY} as int)").alias("__n"))
    copies = docs.join(salted, docs["doc_id"] == F.col("__id")).select("__id", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__copy"), F.col("text").alias(out), F.col("__n"))
    counts = salted.select(F.col("__id").alias("__cid"), F.col("__n").alias("__cn"))
    keyed = pairs.join(counts, F.col(side) == F.col("__cid")).withColumn("__salt", F.pmod(F.xxhash64("a", "b"), F.col("__cn")).cast("int")).drop("__cid", "__cn")
    return keyed.join(copies.drop("__n"), (F.col(side) == F.col("__id")) & (F.col("__salt") == F.col("__copy"))).drop("__id", "__copy", "__salt")


def _pair_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row and the two shingle sets of (a, b, text of a, text of b), some rows at a time."""
    sides, at, rows = [A.utf8(batch.column(k)) for k in (2, 3)], 0, batch.num_rows
    size = np.cumsum(np.diff(sides[0][1]) + np.diff(sides[1][1]))
    while at < rows:
        done = size[at - 1] if at else 0
        to = min(rows, max(at + 1, int(np.searchsorted(size, done + A.CHUNK_BYTES))))
        left, right = (_sets_of(d[o[at] : o[to]], o[at : to + 1] - o[at]) for d, o in sides)
        for k in range(to - at):
            yield at + k, left[k], right[k]
        at = to


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x are in y; both sorted, y not empty."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def verified(pairs: DataFrame, docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, x, y in _pair_sets(batch):
                small, large = sorted((len(x), len(y)))
                if small and 100 * small >= percent * large:
                    both = int(_common(x, y).sum())
                    keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    both = _with_text(_with_text(pairs.select("a", "b"), "a", "ta", docs), "b", "tb", docs)
    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def differences(family: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """How each document a differs from its leader b: (a, b, size, n, probe, answer, tokens).

    n is the size of the symmetric difference of their sets, tokens its first elements (shingles that the leader lacks
    come first, as few others share them).  Two documents are linked if their own symmetric difference is at most
    c * (sum of their sizes), c = (100 - percent) / (100 + percent).  That difference is n + n' - 2 * (shared elements of
    their differences from a common leader), so a pair of which one isn't linked to the leader must share

        o = (n - c * size + n' - c * size') / 2 > 0

    elements.  ``probe`` is how many first elements of a document not linked to its leader must be looked up so that
    no partner is missed (0 if it is linked), and ``answer`` how many must be found by others.
    """
    c = (100 - percent) / (100 + percent)

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, probes, answers, tokens = [], [], [], [], []
            for _, x, y in _pair_sets(batch):
                extra = x[~_common(x, y)] if len(y) else x
                lacking = y[~_common(y, x)] if len(x) else y
                n = len(extra) + len(lacking)
                over = n - c * (len(x) + len(y))
                probe = n - max(1, int(np.ceil(over / (1 + c) - 1e-9))) + 1 if over > 0 else 0
                answer = n - max(1, int(np.ceil((n - c * (len(x) - len(y))) / 2 - 1e-9))) + 1
                sizes.append(len(x))
                counts.append(n)
                probes.append(max(0, probe))
                answers.append(max(0, answer))
                tokens.append(np.concatenate([extra, lacking])[: max(probe, answer, 0)].view(np.int64))
            longs = [pa.array(v, pa.int64()) for v in (sizes, counts, probes, answers)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, pa.array(tokens, pa.list_(pa.int64()))], names=["a", "b", "size", "n", "probe", "answer", "tokens"])

    both = _with_text(_with_text(family.select("a", "b"), "a", "ta", docs), "b", "tb", docs)
    return both.select("a", "b", "ta", "tb").mapInArrow(differ, "a long, b long, size long, n long, probe long, answer long, tokens array<long>")


def across(family: DataFrame, roots: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components under a common leader that may be linked (and all that are)."""
    c = (100 - percent) / (100 + percent)
    rows = settle(_rooted(differences(family, docs, percent), roots, "a", "root").select("*", F.posexplode("tokens").alias("at", "token")).drop("tokens"))
    asks = rows.filter("at < probe").select("b", "token", *[F.col(k).alias(f"u_{k}") for k in ("a", "root", "size", "n", "at")])
    answers = rows.filter("at < answer").select("b", "token", "a", "root", "size", "n", "at")
    # o elements at least are shared; with this one the first of them, no more can be than either has from here on
    needed = (F.col("u_n") + F.col("n") - c * (F.col("u_size") + F.col("size"))) / 2 - 1e-6
    possible = F.least(F.col("u_n") - F.col("u_at"), F.col("n") - F.col("at")) >= needed
    return asks.join(answers, ["b", "token"]).filter((F.col("u_root") != F.col("root")) & possible).select(_pair("a", "u_a")).select("p.a", "p.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest id it reaches.

    Large-star and small-star steps in turn, until nothing changes.  Each step is a grouped minimum and a join, and
    every result is settled in the checkpoint folder.
    """
    current = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = current.count()
    small = lambda d: packed(d, n)  # noqa: E731  steps never hold more rows than twice the edges
    current, mark = small(current), None
    while True:
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("mu")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = settle(small(small(large).distinct()))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m")
        moved = large.join(low, F.col("u") == F.col("mu"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(moved.select("u", F.col("m").alias("v"))).filter("u <> v")
        current = settle(small(small(moved).distinct()))
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT, bands: int | None = None, rows: int = BAND_ROWS
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id it reaches), kept (doc_id = component_id)."""
    known = settle(signed(docs, id_col, text_col, bands or bands_for(percent, rows), rows))
    named = known.filter("digest is not null and doc_id is not null")
    copied = named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # texts with copies stand there once for each salt, so that thousands of copies of one text go to several tasks
    salted = copied.select(F.col("digest").alias("__d"), "class_id", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))).alias("__s"))
    own_salt = F.pmod(F.xxhash64("doc_id"), F.lit(CLASS_SALTS)).cast("int")
    members = named.select("doc_id", "digest", own_salt.alias("salt")).join(salted, (F.col("digest") == F.col("__d")) & (F.col("salt") == F.col("__s")))
    members = settled(members.filter("doc_id <> class_id").select("doc_id", "class_id", "digest").distinct())
    edges = members.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    standing_for = members.select(F.col("doc_id").alias("__m"), F.col("digest").alias("__d"))
    keys = named.join(standing_for, (F.col("doc_id") == F.col("__m")) & (F.col("digest") == F.col("__d")), "left_anti").select("doc_id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("__k"), "n")
    # the planner can't know that few keys are shared, and the aggregate may hold as many rows as there are documents
    buckets = packed(settle(keys.join(shared.hint("merge"), F.col("key") == F.col("__k")).select("doc_id", "key", "n")))
    central = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight")).withColumnRenamed("doc_id", "__w")
    leaders = buckets.join(central, F.col("doc_id") == F.col("__w")).groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("l"))
    votes = buckets.join(leaders.select(F.col("key").alias("__k"), (-F.col("l.id")).alias("leader"), F.col("l.weight").alias("weight")), F.col("key") == F.col("__k"))
    votes = packed(settle(votes.filter("doc_id <> leader").groupBy("doc_id", "leader", "weight").agg(F.count(F.lit(1)).alias("n"))))
    buckets = buckets.drop("n")
    candidates = packed(settle(buckets.select(F.col("doc_id").alias("__c")).distinct()))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small = candidates.count() <= BROADCAST_IDS
    with SharedTable(texts.join(F.broadcast(candidates) if small else candidates, F.col("doc_id") == F.col("__c"), "left_semi")) as own:
        best = votes.groupBy("doc_id").agg(F.max(F.struct("n", "weight", F.col("leader").alias("id"))).alias("best"))
        edges = edges.unionAll(settled(verified(best.select(F.col("doc_id").alias("a"), F.col("best.id").alias("b")), own, percent)))
        roots = components(edges)
        apart = _rooted(_rooted(votes, roots, "doc_id", "ra"), roots, "leader", "rb").filter("ra <> rb").select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
        edges = edges.unionAll(settled(verified(settled(apart), own, percent)))
        roots = components(edges)
        rooted = packed(settle(_rooted(buckets, roots, "doc_id", "root")))
        open_keys = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select(F.col("key").alias("__k"))
        led = leaders.join(open_keys, F.col("key") == F.col("__k")).select("__k", (-F.col("l.id")).alias("b"))
        family = packed(settle(buckets.join(led, F.col("key") == F.col("__k")).select(F.col("doc_id").alias("a"), "b").filter("a <> b").distinct()))
        edges = edges.unionAll(settled(verified(settled(across(family, roots, own, percent)), own, percent)))
    whole = components(edges)
    return known.select("doc_id", "n_shingles").join(whole, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def settled(df: DataFrame) -> DataFrame:
    return packed(settle(df))


def _rooted(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the root of ``column`` (itself, if it has no links)."""
    r = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return df.join(r, F.col(column) == F.col("__n"), "left").withColumn(out, F.coalesce("__r", column)).drop("__n", "__r")


def _pair(a: str, b: str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("p")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group: the rows whose id is the smallest of their group, all columns.

    Rows without an id are kept, as they belong to no group.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def oracle(percent: int = QUERY_PERCENT, width: int = SHINGLE_WORDS) -> str:
    """DuckDB SQL with the rows of ``near_duplicates`` over ``documents``: all pairs that share a shingle, then their closure."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+{width - 1}], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {percent} * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.doc_id = w.doc_id"""
