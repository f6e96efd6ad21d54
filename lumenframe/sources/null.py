"""Synthetic images made on the cluster, and the check that a table still holds them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIMESTEPS = 20


def edge_length(megabytes: int = 10) -> int:
    """Slices (and voxels along each side) of an image of about so many megabytes."""
    return int((megabytes * 1024 * 1024 / TIMESTEPS) ** (1 / 3))


def acquisition_number(sequence: Column, step: Column, slice_: Column, n: int) -> Column:
    """The first sequence counts its slices up, the second even slices first."""
    evens = math.ceil(n / 2)
    interleaved = F.when(slice_ < evens, slice_ * 2).otherwise((slice_ - evens) * 2 + 1)
    return F.when(sequence == 0, slice_).otherwise(interleaved) + step * n


def null_chunks(spark: SparkSession, n: int | None = None, dialect: int = 10, timesteps: int = TIMESTEPS) -> DataFrame:
    """Two sequences of ``timesteps`` steps of n slices of n x n voxels, with a square that darkens from slice to slice."""
    n = n or edge_length(dialect)
    i = F.col("id")
    sequence, step, slice_ = F.floor(i / (n * timesteps)), F.floor(i / n) % timesteps, i % n
    d = spark.range(2 * timesteps * n).select(i.alias("arrival"), sequence.cast("int").alias("sequenceNumber"), step.cast("int").alias("__t"), slice_.cast("int").alias("__s"))
    place = lambda k: (F.floor(k / n).between(10, 39)) & ((k % n).between(10, 39))
    shade = F.pmod(255 - F.col("__s") * 20, F.lit(256))
    voxels = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.when(k == 0, F.pmod(F.col("__t") * 40, F.lit(256))).when(place(k), shade).otherwise(0).cast("double"))
    struct3 = lambda x, y, z: F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(k) for k, v in zip("xyz", (x, y, z))])
    turn = math.pi / 8
    names = F.when(F.col("sequenceNumber") == 0, "normal sequential image").otherwise("interleaved image")
    return d.select(
        "arrival", F.struct(*[F.lit(v).alias(k) for k, v in zip("crst", (n, n, 1, 1))]).alias("dims"), F.lit("u8bit").alias("type_id"), "sequenceNumber",
        acquisition_number(F.col("sequenceNumber"), F.col("__t"), F.col("__s"), n).cast("long").alias("acquisitionNumber"),
        struct3(0, -75, F.col("__s") * (110.0 / n) - 50).alias("indexOrigin"), struct3(math.cos(turn), -math.sin(turn), 0).alias("rowVec"), struct3(math.sin(turn), math.cos(turn), 0).alias("columnVec"),
        struct3(150 / n, 150 / n, 100 / n).alias("voxelSize"), F.lit(1234.0).alias("repetitionTime"), names.alias("sequenceDescription"), voxels.alias("voxels"),
    )


def differences(chunks: DataFrame, n: int | None = None, dialect: int = 10, timesteps: int = TIMESTEPS) -> DataFrame:
    """(sequenceNumber, acquisitionNumber, what) where ``chunks`` aren't the synthetic images; empty if they are."""
    keys = ["sequenceNumber", "acquisitionNumber"]
    want = null_chunks(chunks.sparkSession, n, dialect, timesteps).select(*keys, F.col("voxels").alias("__v"), F.col("dims").alias("__d"))
    both = chunks.select(*keys, "voxels", "dims").join(want, keys, "full")
    what = F.when(F.col("__v").isNull(), "unexpected").when(F.col("voxels").isNull(), "missing").when(F.col("dims") != F.col("__d"), "shape").when(F.col("voxels").cast("array<double>") != F.col("__v"), "voxels")
    return both.withColumn("what", what).filter("what is not null").select(*keys, "what")
