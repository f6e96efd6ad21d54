"""File names from property templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.types import BY_NAME

#: Digits that integers of a type are padded to.
DIGITS = {name: math.ceil(math.log10(BY_NAME[name].high)) for name in ("u8bit", "s8bit", "u16bit", "s16bit", "u32bit", "s32bit")}


def file_name(pattern: str, columns: dict[str, Column], types: dict[str, str] | None = None) -> Column:
    """``{prop}`` and ``{%d_prop}`` replaced by property columns (keys in any case).

    ``%d_`` pads integers with zeros to their type's width.  White space and slashes become ``_``; a property that is
    missing or null leaves nothing.
    """
    known = {k.lower(): v for k, v in columns.items()}
    kinds = {k.lower(): v for k, v in (types or {}).items()}
    parts = []
    for piece in re.split(r"(\{[^{}]+\})", pattern):
        if not (piece.startswith("{") and piece.endswith("}") and len(piece) > 2):
            parts.append(F.lit(piece))
            continue
        key, padded = piece[1:-1].lower(), False
        if key.startswith("%d_"):
            key, padded = key[3:], True
        if key not in known:
            continue
        text = F.regexp_replace(known[key].cast("string"), r"[\s/\\]", "_")
        digits = DIGITS.get(kinds.get(key, ""), 0) if padded else 0
        parts.append(F.coalesce(F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text), F.lit("")))
    return F.concat(*parts)


def split_suffix(name: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """Stem and suffix (with its dot); of the known suffixes the longest that fits, else the last dot's."""
    known = sorted((s.lstrip(".") for s in suffixes), key=len, reverse=True)
    pattern = "|".join(re.escape(s) for s in known)
    generic = r"\.[^./]*"
    full = rf"^(.*?)(\.(?:{pattern}))$" if known else rf"^(.*)({generic})$"
    stem, suffix = F.regexp_extract(name, full, 1), F.regexp_extract(name, full, 2)
    other = rf"^(.*)({generic})$"
    fits = suffix != ""
    fallback = F.regexp_extract(name, other, 2)
    return F.when(fits, stem).when(fallback != "", F.regexp_extract(name, other, 1)).otherwise(name), F.when(fits, suffix).otherwise(fallback)


def unique_names(df: DataFrame, name: str, order: list[str], suffixes: list[str] | None = None, out: str = "unique_name") -> DataFrame:
    """Names that occur more than once get ``_n`` before their suffix, padded to the width of their count."""
    w = Window.partitionBy(name)
    count, rank = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    stem, suffix = split_suffix(F.col(name), suffixes or [])
    number = F.lpad(rank.cast("string"), F.length(count.cast("string")), "0")
    return df.withColumns({"__n": count, "__number": number}).withColumn(out, F.when(F.col("__n") > 1, F.concat(stem, F.lit("_"), F.col("__number"), suffix)).otherwise(F.col(name))).drop("__n", "__number")


def numbered(df: DataFrame, runs: list[Column], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place of each row, from 1, in the order of ``order``.

    ``runs`` are values that never fall in that order; rows are ranked inside their run and only the runs' sizes are added up in one place.
    """
    names = [f"__r{i}" for i in range(len(runs))]
    d = df.withColumns(dict(zip(names, runs, strict=True)))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(*[F.col(n).alias(f"{n}_") for n in names], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_"))
    placed = d.withColumn("__place", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).join(starts, on)
    return placed.withColumn(out, (F.col("__start") + F.col("__place")).cast("long")).select(*df.columns, out)
