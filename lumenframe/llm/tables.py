"""Shared plan pieces: cut lineage, stable numbering without one large sort, hot-key fetches."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch between the JVM and Python, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows: whole texts stand in them, on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors don't cost its lineage again.

    The folder is the one the cluster names in spark.checkpoint.dir; a local one is set only where that is unset.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition that small settled tables are put together to.
SMALL_PARTITION, LEAST_PARTITIONS = 100_000, 4


def packed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A settled table in fewer partitions if it is small, so that what is built on it has no swarm of tiny tasks and files."""
    n = df.count() if rows is None else rows
    return df.coalesce(max(LEAST_PARTITIONS, -(-n // SMALL_PARTITION)))


def _checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenframe-checkpoints-"))
    return sc.getCheckpointDir()


class SharedTable:
    """A table written as Parquet to the shared checkpoint folder, for the length of a ``with`` block."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def __enter__(self) -> DataFrame:
        spark = self.df.sparkSession
        self.path = f"{_checkpoint_dir(spark)}/lumenframe-{uuid.uuid4().hex}"
        self.df.write.parquet(self.path)
        return spark.read.schema(self.df.schema).parquet(self.path)

    def __exit__(self, *_) -> None:
        spark = self.df.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bucket_count(rows: int) -> int:
    """As many numbering buckets as rows in each: the longest task sees about the root of ``rows``."""
    return max(1, math.isqrt(rows))


def running_start(df: DataFrame, group: list[str], order: list[str | Column], amount: str, rows: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same group that come before.

    The order inside a group is (bucket, order), where the bucket is a hash of the order columns.  Sums by bucket are
    taken first and only those are scanned by group, so a group that holds most rows is still spread over all tasks:
    no task sorts more than one bucket of a group, or one group's bucket sums.
    Equal rows get different places; which of them gets which doesn't matter to the whole.
    """
    n = bucket_count(rows)
    d = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(n)))
    sums = d.groupBy(*group, "__b").agg(F.sum(amount).alias("__s"))
    w = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__gb"), F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__base"))
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__b") == F.col("__gb")]
    inner = Window.partitionBy(*group, "__b").orderBy(*order, amount).rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("__in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    drop = ["__b", "__in", "__gb", "__base", *[f"__g{i}" for i in range(len(group))]]
    return placed.join(base, cond).withColumn(out, F.col("__in") + F.col("__base")).drop(*drop)


#: Tasks that the rows of one key are dealt to for a join with what is known of it.
KEY_COPIES = 64


def mapped_by_key(rows: DataFrame, columns: list[str], key: Column, table: DataFrame, key_col: str, values: list[str], size_col: str, most: int, make: Callable, read: Callable, schema: str) -> DataFrame:
    """``read(batch, lookup)`` over batches of ``columns``; ``lookup(key, i)`` is ``make(*values)`` of the key of row i, None if the table lacks it.

    The table (settled, one row per key) is broadcast if ``size_col`` adds up to ``most`` at most.  A larger one is joined
    by key, with a copy for each of the ``KEY_COPIES`` tasks that a key's rows are dealt to.  Null keys match nothing.
    """
    if table.agg(F.coalesce(F.sum(size_col), F.lit(0)).alias("n")).first()["n"] <= most:
        plain = lambda v: [x.asDict() for x in v] if isinstance(v, list) else v
        known = {r[key_col]: [plain(r[v]) for v in values] for r in table.select(key_col, *values).toLocalIterator()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict = {}

            def lookup(k, _: int):
                if k not in ready:
                    ready[k] = make(*known[k]) if k in known else None
                return ready[k]

            for b in batches:
                yield read(b, lookup)

        return rows.select(*columns).mapInArrow(run, schema)
    copies = table.select(F.col(key_col).alias("__tk"), *[F.col(v).alias(f"__t{i}") for i, v in enumerate(values)], F.explode(F.sequence(F.lit(0), F.lit(KEY_COPIES - 1))).alias("__copy"))
    salted = rows.select(*columns, key.alias("__rk"), F.pmod(F.xxhash64(*columns), F.lit(KEY_COPIES)).cast("int").alias("__salt"))
    joined = salted.join(copies, (F.col("__rk") == F.col("__tk")) & (F.col("__salt") == F.col("__copy")), "left").select(*columns, *[f"__t{i}" for i in range(len(values))], F.col("__tk").isNotNull().alias("__known"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ready: dict = {}
            own = b.columns[len(columns) :]

            def lookup(k, i: int):
                if k not in ready:
                    ready[k] = make(*(c[i].as_py() for c in own[:-1])) if own[-1][i].as_py() else None
                return ready[k]

            yield read(pa.RecordBatch.from_arrays(b.columns[: len(columns)], names=columns), lookup)

    return joined.mapInArrow(run_joined, schema)
