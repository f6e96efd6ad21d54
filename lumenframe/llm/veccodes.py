"""Vector code compression: product codes learnt by weighted Lloyd rounds over distinct integer parts.

Components become whole numbers, vectors are cut into ``PARTS`` equal parts.  Equal parts of a position are put together into one weighted row
(a partial aggregation before the exchange, so that a part that fills a third of the table costs no task more than others).  Every round assigns
the distinct rows in Arrow batches and adds up weighted sums by (position, entry); the codebooks, ``PARTS * ENTRIES`` short
vectors whatever the input, are all that reaches the driver.  Codes and errors are then joined back to the vectors by
(position, part): parts with more than a ``HOT``-th of all rows, of which there are fewer than ``PARTS * HOT``, by broadcast, the others by an exchange.

Cases: vectors that are null, or hold a component that is null, not finite, or beyond 2**51 in size (its whole number would need more than 64
bits) drop out; all others get a row, repeated ones too.  Vectors shorter than the longest one, or than a multiple of ``PARTS``, count as followed by
zeros.  Null ids come last among the smallest ids, equal ids go by their components.  With fewer than ``ENTRIES`` rows codebooks are as much shorter.  Sums beyond 64
bits come out as the largest long.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A key with more than this part of all rows is joined by broadcast.
HOT = 1000
#: Squared distances of parts below this size can't pass 64 bits; larger ones are taken with Python's whole numbers.
SAFE = 1 << 26
LONGEST = (1 << 63) - 1

Codebooks = list[np.ndarray]  # for each position its entries, whole numbers


def whole_numbers(vector: str) -> Column:
    """floor(SCALE * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(1 << 51))))


def _exact(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if no squared distance can pass them, else as Python numbers."""
    if max(int(np.abs(x).max(initial=0)) for x in (parts, book)) * np.sqrt(parts.shape[1]) < SAFE * 8:
        return parts, book
    return parts.astype(object), book.astype(object)


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the nearest entry (the first of equally near ones) and its squared distance."""
    parts, book = _exact(parts, book)
    best, least = np.zeros(len(parts), np.int64), None
    for k, entry in enumerate(book):
        d = ((parts - entry) ** 2).sum(axis=1)
        if least is None:
            least = d
        else:
            nearer = d < least
            best[nearer], least = k, np.where(nearer, d, least)
    return best, least


def _parts(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _by_position(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    positions, parts = batch.column("pos").to_numpy(), _parts(batch.column("part"), length)
    for p in np.unique(positions):
        rows = np.flatnonzero(positions == p)
        yield int(p), rows, parts[rows]


def _sums(books: Codebooks, length: int) -> Callable:
    """Weighted sums and counts of the parts by position and nearest entry, one row for each of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            weights = b.column("weight").to_numpy()
            for p, rows, parts in _by_position(b, length):
                best, _ = nearest_entries(parts, books[p])
                small = float(np.abs(parts).max(initial=0)) * float(weights[rows].sum()) < LONGEST
                parts, w = (parts, weights[rows]) if small else (parts.astype(object), weights[rows].astype(object))
                for k in np.unique(best):
                    own = best == k
                    add = [int(w[own].sum()), *(int(v) for v in (parts[own] * w[own][:, None]).sum(axis=0))]
                    total[p, int(k)] = [x + y for x, y in zip(total.get((p, int(k)), [0] * len(add)), add, strict=True)]
        rows = [(p, k, i, v) for (p, k), values in total.items() for i, v in enumerate(values)]
        if rows:
            pos, entry, at, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"pos": pa.array(pos, pa.int32()), "entry": pa.array(entry, pa.int32()), "at": pa.array(at, pa.int32()), "value": pa.array(value, pa.decimal128(38, 0))})

    return run


def lloyd_round(distinct: DataFrame, books: Codebooks, length: int) -> Codebooks:
    """Assign every distinct part and move each used entry to floor(weighted sum / weight)."""
    sums = distinct.mapInArrow(_sums(books, length), "pos int, entry int, at int, value decimal(38,0)").groupBy("pos", "entry", "at").agg(F.sum("value").alias("value"))
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.collect():  # PARTS * ENTRIES * (length + 1) rows at most
        found.setdefault((r["pos"], r["entry"]), {})[r["at"]] = int(r["value"])
    moved = [b.copy() for b in books]
    for (p, k), values in found.items():
        moved[p][k] = [values[i + 1] // values[0] for i in range(length)]
    return moved


def _assigned(books: Codebooks, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for p, rows, parts in _by_position(b, length):
                code[rows], least = nearest_entries(parts, books[p])
                error[rows] = np.minimum(least, LONGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), pa.array(code, pa.int32()), pa.array(error)], names=["pos", "part", "code", "error"])

    return run


def _long(total: Column) -> Column:
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def joined_back(rows: DataFrame, table: DataFrame, hot: DataFrame, keys: list[str], values: list[str], deal: str) -> DataFrame:
    """``rows`` with the ``values`` of their ``keys`` (not null): from ``hot``, a small table, by broadcast, else from ``table`` by an exchange.

    Rows that the broadcast served go to the exchange under a key that matches nothing, spread by the number ``deal``.
    """
    small = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], *[F.col(v).alias(f"__h_{v}") for v in values])
    on = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    known = rows.join(F.broadcast(small), _all(on), "left")
    served = F.col(f"__h_{keys[0]}").isNotNull()
    known = known.withColumn("__served", served).withColumn("__deal", F.when(served, F.pmod(F.col(deal), F.lit(4096)).cast("int")).otherwise(F.lit(-1)))
    rest = table.select(*[F.col(k).alias(f"__t_{k}") for k in keys], F.lit(-1).alias("__t_deal"), *[F.col(v).alias(f"__t_{v}") for v in values])
    on = [F.col("__deal") == F.col("__t_deal"), *[F.col(k) == F.col(f"__t_{k}") for k in keys]]
    both = known.join(rest, _all(on), "left")
    return both.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"__h_{v}"), F.col(f"__t_{v}")).alias(v) for v in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    if parts > 8 or entries > 128:
        raise ValueError("the codes of a vector are packed into one long: at most 8 parts and 128 entries")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = named.where(_usable("vector")).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole_numbers("vector").alias("numbers"))
    rows = settle(usable)  # settled, so that row numbers stay
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("numbers")), F.lit(0)).alias("dim")).first()
    length = max(1, -(-size["dim"] // parts))
    padded = F.concat("numbers", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * length) - F.size("numbers")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(padded, p * length + 1, length))
    exploded = rows.select("row", F.posexplode(cut).alias("pos", "part"))
    distinct = settle(exploded.groupBy("pos", "part").agg(F.count("*").alias("weight")))

    first = rows.select("vec_id", padded.alias("numbers")).orderBy(F.asc_nulls_last("vec_id"), "numbers").limit(entries).collect()
    start = np.array([r["numbers"] for r in first], dtype=np.int64).reshape(len(first), parts, length)
    books = [start[:, p].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        books = lloyd_round(distinct, books, length)

    run, schema = _assigned(books, length), "pos int, part array<long>, code int, error long"
    is_hot = F.col("weight") * HOT > size["n"]
    coded, hot = (distinct.where(c).select("pos", "part").mapInArrow(run, schema) for c in (~is_hot, is_hot))
    by_part = joined_back(exploded, coded, hot, ["pos", "part"], ["code", "error"], "row")
    place = F.array(*[F.lit(256 ** (parts - 1 - p)).cast("long") for p in range(parts)])[F.col("pos")]
    per_row = by_part.groupBy("row").agg(F.sum(F.col("code") * place).alias("packed"), _long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("error"))
    code = F.lower(F.lpad(F.hex("packed"), 2 * parts, "0"))
    known = settle(rows.select("row", "vec_id", "label").join(per_row, "row").select("row", "vec_id", F.coalesce("label", F.lit(0)).alias("__label"), F.col("label").isNull().alias("__none"), code.alias("code"), "error"))

    by_label = settle(known.groupBy("__label", "__none").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"), F.count("*").alias("weight")))
    done = joined_back(known, by_label.where(~is_hot), by_label.where(is_hot), ["__label", "__none"], ["label_error"], "row")
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL for the rows of the registered query over ``embeddings`` (vectors of one length, a multiple of PARTS)."""
    dist = "list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    rounds, book = [], "book0"
    for r in range(1, ROUNDS + 2):
        rounds.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, pos, any_value(part) AS part, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT p.row, p.pos, p.part, b.k, {dist} AS d FROM parts p JOIN {book} b ON p.pos = b.pos) GROUP BY row, pos
)""")
        if r <= ROUNDS:
            rounds.append(f"""
moved{r} AS MATERIALIZED (
  SELECT pos, k, list(floor_sum ORDER BY i) AS part FROM (
    SELECT pos, k, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS floor_sum FROM (
      SELECT pos, best.k AS k, i, sum(part[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{r}, (SELECT unnest(range(1, length + 1)) AS i FROM size) GROUP BY pos, best.k, i)
  ) GROUP BY pos, k
), book{r} AS MATERIALIZED (
  SELECT b.pos, b.k, coalesce(m.part, b.part) AS part FROM {book} b LEFT JOIN moved{r} m ON b.pos = m.pos AND b.k = m.k
)""")
            book = f"book{r}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS numbers
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), size AS MATERIALIZED (
  SELECT max(len(numbers)) // {PARTS} AS length FROM kept
), parts AS MATERIALIZED (
  SELECT row, vec_id, pos, numbers[pos * length + 1 : (pos + 1) * length] AS part FROM kept, size, (SELECT unnest(range({PARTS})) AS pos)
), first AS MATERIALIZED (
  SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, numbers) - 1 AS k FROM kept ORDER BY k LIMIT {ENTRIES}
), book0 AS MATERIALIZED (
  SELECT pos, k, part FROM parts JOIN first USING (row)
), {",".join(rounds)}, coded AS MATERIALIZED (
  SELECT row, string_agg(lpad(lower(to_hex(best.k)), 2, '0'), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS + 1} GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, k)) FROM {book}) AS codebooks_sha256
FROM kept JOIN coded USING (row)
"""
