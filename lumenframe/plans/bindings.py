"""Driver tables read as chunks, headers and property trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.operators import props

EVENT_KINDS = ("click", "error", "purchase", "signup", "view")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dims(c: int | Column, r: int | Column, s: int | Column, t: int | Column) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in zip("crst", (c, r, s, t))])


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as double chunks of 8 x 8 voxels: image_id (label), lookup (vec_id), dims, voxels."""
    voxels = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("lookup"), dims(8, 8, 1, 1).alias("dims"), F.lit("double").alias("type_id"), voxels.alias("voxels"))


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as chunk headers: a user is a sequence, the event type a place along z, high values a second time step."""
    place = F.array_position(F.array(*[F.lit(k) for k in EVENT_KINDS]), F.col("event_type")).cast("double")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("arrival"), dims(1, 1, 1, 1).alias("dims"), F.col("user_id").alias("sequenceNumber"),
        F.when(F.col("event_type").isNotNull(), G.struct(G.vector(0, 0, place))).alias("indexOrigin"),
        G.struct(G.vector(1, 0, 0)).alias("rowVec"), G.struct(G.vector(0, 1, 0)).alias("columnVec"), G.struct(G.vector(1, 1, 1)).alias("voxelSize"),
        (F.col("value") > 25).cast("long").alias("acquisitionNumber"), "ts", "value", "event_type",
    )


def event_tree(spark: SparkSession, sf_dir: str, odd: bool) -> DataFrame:
    """Property trees of neighbouring events: owner n holds event 2n (or 2n + 1)."""
    e = read(spark, sf_dir, "events").filter(F.col("event_id") % 2 == int(odd)).withColumn("owner", F.floor(F.col("event_id") / 2).cast("long"))
    own = props.from_json(e, "owner", "props", "Sub/")
    plain = props.from_columns(e, "owner", {"event_type": "string", "user_id": "s64bit"})
    return own.unionByName(plain)
