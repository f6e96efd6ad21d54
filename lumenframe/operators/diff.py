"""Difference of two data sets of images: matching, metadata, voxels, left-overs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import image, props

SELECT_WITH = ("sequenceNumber", "sequenceStart")


@dataclass(frozen=True)
class DataSetDiff:
    matches: DataFrame  # left_id, right_id
    metadata: DataFrame  # owner (left_id), path, idx, left, right
    voxels: DataFrame  # image_id (left_id), different, total, percent
    unmatched: DataFrame  # side, image_id


def match(left: DataFrame, right: DataFrame, select: list[str], order: str = "image_id") -> DataFrame:
    """(left_id, right_id): each right image goes to the first left image (in input order) with null-safe equal properties."""
    l = left.select(F.col("image_id").alias("left_id"), F.col(order).alias("__lo"), *[F.col(c).alias(f"__l{i}") for i, c in enumerate(select)])  # noqa: E741
    # the first left image of equal properties takes all that fits, so others of them never match
    l = l.withColumn("__n", F.row_number().over(Window.partitionBy(*[f"__l{i}" for i in range(len(select))]).orderBy("__lo"))).filter("__n = 1")  # noqa: E741
    r = right.select(F.col("image_id").alias("right_id"), *[F.col(c).alias(f"__r{i}") for i, c in enumerate(select)])
    on = F.lit(True)
    for i in range(len(select)):
        on = on & F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}"))
    return l.join(r, on).select("left_id", "right_id")


def drop_with(images: DataFrame, name: str, value: str, type_column: str | None = None) -> DataFrame:
    """Images without those whose text property has a value."""
    hit = F.coalesce(F.col(name) == value, F.lit(False))
    return images.filter(~(hit & (F.col(type_column) == "string") if type_column else hit))


def nth(images: DataFrame, n: int, order: str = "image_id") -> DataFrame:
    """The n-th image, from 0."""
    return images.orderBy(order).offset(n).limit(1)


def unmatched(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    l = left.select("image_id").join(matches.select(F.col("left_id").alias("image_id")), "image_id", "left_anti").select(F.lit("left").alias("side"), "image_id")  # noqa: E741
    r = right.select("image_id").join(matches.select(F.col("right_id").alias("image_id")), "image_id", "left_anti").select(F.lit("right").alias("side"), "image_id")
    return l.unionAll(r)


def diff(left: DataFrame, right: DataFrame, left_props: DataFrame, right_props: DataFrame, left_chunks: DataFrame, right_chunks: DataFrame, select: list[str], ignore: tuple[str, ...] = ("source",)) -> DataSetDiff:
    """Everything that differs; ``ignore`` names properties that may."""
    m = match(left, right, select)
    moved = right_props.join(m, right_props["owner"] == m["right_id"]).drop("owner", "right_id").withColumnRenamed("left_id", "owner").select(*props.COLUMNS)
    own = left_props.join(m.select(F.col("left_id").alias("owner")).distinct(), "owner", "left_semi").select(*props.COLUMNS)
    skipped = [i.lower() for i in ignore]
    metadata = props.difference(own, moved).filter(~F.lower("path").isin(skipped))
    chunks = right_chunks.join(m, right_chunks["image_id"] == m["right_id"]).drop("image_id", "right_id").withColumnRenamed("left_id", "image_id")
    mine = left_chunks.join(m.select(F.col("left_id").alias("image_id")).distinct(), "image_id", "left_semi")
    voxels = image.compare(mine, chunks).filter("different > 0").withColumn("percent", 100.0 * F.col("different") / F.col("total"))
    return DataSetDiff(m, metadata, voxels, unmatched(left, right, m))
