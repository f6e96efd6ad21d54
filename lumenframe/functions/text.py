"""String and date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days in the units of an age.
DAYS_OF_UNIT = {"D": 1.0, "W": 7.0, "M": 30.436875, "Y": 365.2425}


def list_to_string(values: Column, delimiter: str = " ", prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.array_join(F.transform(values, lambda x: x.cast("string")), delimiter), F.lit(suffix))


def string_to_list(s: Column, separator: str, prefix: str = "", suffix: str = "") -> Column:
    """Parts between matches of ``separator``; one match at either end is cut first."""
    inner = F.regexp_replace(F.regexp_replace(s, f"^(?:{prefix}|{separator})" if prefix else f"^(?:{separator})", ""), f"(?:{suffix or separator})$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, separator))


def split_on(s: Column, char: str) -> Column:
    """Parts between single characters; empty ones are dropped."""
    return F.filter(F.split(s, "\\Q" + char + "\\E"), lambda x: x != "")


def age_to_days(s: Column) -> Column:
    """``nnnD``, ``W``, ``M`` or ``Y`` in days, rounded half to even; without a letter days are assumed; null without digits."""
    number = F.nullif(F.regexp_extract(s, r"^\s*([0-9]+)", 1), F.lit("")).try_cast("double")
    unit = F.upper(F.substring(s, -1, 1))
    factor = F.lit(1.0)
    for letter, days in DAYS_OF_UNIT.items():
        factor = F.when(unit == letter, days).otherwise(factor)
    return F.rint(number * factor).cast("int")


def compact_date(s: Column) -> Column:
    """``yyyymmdd``."""
    return F.when(s.rlike(r"^\d{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))


def compact_time_micros(s: Column) -> Column:
    """``hh``, ``hhmm`` or ``hhmmss`` with an optional fraction, in microseconds of the day."""
    part = lambda k: F.coalesce(F.nullif(F.substring(F.regexp_extract(s, r"^(\d{2,6})", 1), 2 * k + 1, 2), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    fraction = F.rpad(F.substring(F.regexp_extract(s, r"^\d{6}\.(\d{1,6})", 1), 1, 6), 6, "0").try_cast("long")
    whole = (part(0) * 3600 + part(1) * 60 + part(2)) * 1_000_000
    return F.when(s.rlike(r"^\d{2}(\d{2}(\d{2}(\.\d+)?)?)?$"), whole + F.coalesce(fraction, F.lit(0).cast("long")))


def merge_date_time(date: Column, time: Column) -> Column:
    """The day of one timestamp with the time of day of another."""
    micros = F.unix_micros(time.cast("timestamp")) % 86_400_000_000
    day = F.unix_micros(F.date_trunc("day", date.cast("timestamp")))
    return F.timestamp_micros(day + F.pmod(micros, F.lit(86_400_000_000)))


def milliseconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1000.0


def number_in_name(name: Column) -> Column:
    """The last run of digits."""
    return F.nullif(F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1), F.lit("")).try_cast("bigint")


def hex_dump(data: Column, most: int = 64) -> Column:
    return F.lower(F.hex(F.substring(data, 1, most)))


def days_to_years(days: Column) -> Column:
    return F.rint(days / DAYS_OF_UNIT["Y"]).cast("int")


def years_to_days(years: Column) -> Column:
    return F.rint(years * DAYS_OF_UNIT["Y"]).cast("int")


def same_key(a: Column, b: Column) -> Column:
    """Equal but for case."""
    return F.lower(a) == F.lower(b)


def fold_prefix(a: str, b: str) -> str:
    """Longest common folder of two paths."""
    common = []
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        common.append(x)
    return "/".join(common)


def common_folder(paths: Column) -> Column:
    """Longest common folder of an array of paths, part by part."""
    parts = F.transform(F.array_sort(F.array_distinct(paths)), lambda p: F.split(p, "/"))
    low, high = F.element_at(parts, 1), F.element_at(parts, -1)  # if the extremes agree, so do all between
    n = F.least(F.size(low), F.size(high))
    first_unequal = F.array_position(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(low, i).eqNullSafe(F.get(high, i))), False).cast("int")
    return F.array_join(F.slice(low, F.lit(1), F.when(first_unequal > 0, first_unequal - 1).otherwise(n)), "/")
