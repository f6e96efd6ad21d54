"""Scalar conversion as Column builders: every value gets the target's value and a flag.

Flags are ``in_range``, ``pos_overflow`` and ``neg_overflow``.  Numbers round half to even.  Nothing here raises under ANSI
mode: ranges are tested on doubles before any narrowing cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.types import LogicalType, of

IN_RANGE, POSITIVE, NEGATIVE = "in_range", "pos_overflow", "neg_overflow"
#: Number tokens that are picked out of free text; whatever stands between them is ignored.
NUMBER_TOKEN = r"[0-9-][0-9eE.-]*"
LIST_SEPARATOR = r"[\s,;]+"
# Words that are read as booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "y", "yes"), ("false", "n", "no")


def _flag(x: Column, t: LogicalType) -> Column:
    """Where a double lies against a type's limits (NaN is in range of real types and above integers)."""
    low, high = F.lit(float(t.low)), F.lit(float(t.high))
    # 2**63 and 2**64 are the first doubles outside of 64 bits
    above = x >= high if t.is_integer and t.bytes == 8 else x > high
    return F.when(F.isnan(x), F.lit(IN_RANGE if t.kind == "real" else POSITIVE)).when(above, POSITIVE).when(x < low, NEGATIVE).otherwise(IN_RANGE)


def round_even(x: Column) -> Column:
    return F.rint(x.cast("double"))


def number_flag(x: Column, target: str | LogicalType) -> Column:
    """Whether a number fits a type after rounding."""
    t = of(target)
    x = x.cast("double")
    if t.kind == "bool":
        return F.lit(IN_RANGE)
    return _flag(round_even(x) if t.is_integer else x, t)


def to_number(x: Column, target: str | LogicalType) -> Column:
    """A number in another numeric type: rounded half to even, held at the limits when out of range."""
    t = of(target)
    d = x.cast("double")
    if t.kind == "bool":
        return d != 0
    if t.kind == "real":
        return F.when(F.isnan(d), d).otherwise(F.greatest(F.least(d, F.lit(float(t.high))), F.lit(float(t.low)))).cast(t.carrier)
    flag = number_flag(x, t)
    limit = lambda v: F.lit(v).cast(t.carrier)
    return F.when(flag == POSITIVE, limit(t.high)).when(flag == NEGATIVE, limit(t.low)).otherwise(round_even(d).try_cast(t.carrier))


def convert_number(x: Column, target: str | LogicalType) -> Column:
    """struct<value, flag>; null stays null."""
    return F.when(x.isNotNull(), F.struct(to_number(x, target).alias("value"), number_flag(x, target).alias("flag")))


def fits_into(x: Column, target: str | LogicalType) -> Column:
    """Whether the conversion stays in range."""
    return number_flag(x, target) == IN_RANGE


def as_type(x: Column, target: str | LogicalType) -> Column:
    """The converted value, or the type's zero for null."""
    t = of(target)
    zero = F.lit(False) if t.kind == "bool" else F.lit(0).cast(t.carrier)
    return F.coalesce(to_number(x, t), zero)


def parse_double(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def string_to_number(s: Column, target: str | LogicalType, strict: bool = False) -> Column:
    """Text is read as a double and converted; what is no number gives 0 (null if ``strict``)."""
    d = parse_double(s)
    return F.when(s.isNotNull(), to_number(d if strict else F.coalesce(d, F.lit(0.0)), target))


def string_to_bool(s: Column) -> Column:
    """true/y/yes and false/n/no in any case; null otherwise."""
    word = F.lower(s)
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def string_to_timestamp(s: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss[.f]`` or ``YYYYMMDDThhmmss``; null otherwise."""
    forms = ((r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}(\.\d{1,6})?$", None), (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"))
    out = F.lit(None).cast("timestamp_ntz")
    for pattern, form in reversed(forms):
        value = s.try_cast("timestamp_ntz") if form is None else F.try_to_timestamp(s, F.lit(form)).cast("timestamp_ntz")
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def string_to_date(s: Column) -> Column:
    """Compact, dashed, day-first and month-first dates, tried in this order."""
    forms = ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}[./]\d{2}[./]\d{4}$", None))
    slashed = F.regexp_replace(s, r"\.", "/")
    out = F.lit(None).cast("date")
    for pattern, form in reversed(forms):
        if form is None:
            value = F.coalesce(F.try_to_timestamp(slashed, F.lit("dd/MM/yyyy")).cast("date"), F.try_to_timestamp(slashed, F.lit("MM/dd/yyyy")).cast("date"))
        else:
            value = F.try_to_timestamp(s, F.lit(form)).cast("date")
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def string_to_selection(s: Column, entries: list[str]) -> Column:
    """struct<value, code>, code counted from 1 among ``entries`` in any case; null if it is none of them."""
    names = F.array(*[F.lit(e) for e in entries])
    place = F.array_position(F.transform(names, F.lower), F.lower(s)).cast("int")
    return F.when(place > 0, F.struct(F.get(names, place - 1).alias("value"), place.alias("code")))


def pick_numbers(s: Column, target: str | LogicalType = "double") -> Column:
    """All number tokens of a text, converted one by one; tokens that don't parse are 0."""
    return F.transform(F.regexp_extract_all(s, F.lit(f"({NUMBER_TOKEN})"), F.lit(1)), lambda x: F.coalesce(to_number(parse_double(x), target), F.lit(0).cast(of(target).carrier)))


def string_to_vector(s: Column, target: str | LogicalType) -> Column:
    """First numbers of a text as a vector or colour; missing ones are 0."""
    t = of(target)
    names = [f.split(":")[0] for f in t.carrier[7:-1].split(",")]
    element = {"float": "float", "double": "double", "int": "s32bit", "smallint": "u8bit"}[t.carrier[7:-1].split(":")[1].split(",")[0]]
    if t.name == "color48":
        element = "u16bit"
    picked = pick_numbers(s, element)
    return F.when(s.isNotNull(), F.struct(*[F.coalesce(F.get(picked, F.lit(i)), F.lit(0).cast(of(element).carrier)).alias(n) for i, n in enumerate(names)]))


def split_strings(s: Column) -> Column:
    """Parts between runs of white space, commas and semicolons; empty parts are dropped."""
    return F.filter(F.split(s, LIST_SEPARATOR), lambda x: x != "")


def string_to_complex(s: Column) -> Column:
    """``(re,im)`` or a plain number."""
    pair = F.regexp_extract_all(s, F.lit(r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"), F.lit(1))
    part = lambda i: F.coalesce(F.get(pair, F.lit(i)).try_cast("double"), F.lit(0.0))
    return F.when(s.isNotNull(), F.struct(part(0).alias("re"), part(1).alias("im")))


def number_to_complex(x: Column, element: str = "double") -> Column:
    return F.when(x.isNotNull(), F.struct(x.cast(element).alias("re"), F.lit(0).cast(element).alias("im")))


def convert_fields(x: Column, fields: list[str], target: str | LogicalType) -> Column:
    """Each field of a struct (vector, colour, complex) in another element type."""
    return F.struct(*[to_number(x[f], target).alias(f) for f in fields])


def fields_flag(x: Column, fields: list[str], kept: int, target: str | LogicalType) -> Column:
    """Flag of a vector conversion: the first field out of range decides; a dropped field that isn't 0 overflows."""
    out = F.lit(IN_RANGE)
    for f in reversed(fields[kept:]):
        out = F.when(x[f] != 0, POSITIVE).otherwise(out)
    for f in reversed(fields[:kept]):
        flag = number_flag(x[f], target)
        out = F.when(flag != IN_RANGE, flag).otherwise(out)
    return out


def list_to_vector(values: Column, names: list[str], target: str | LogicalType) -> Column:
    """First elements of a list as a vector; missing ones are 0."""
    zero = F.lit(0).cast(of(target).carrier)
    return F.struct(*[F.coalesce(to_number(F.get(values, F.lit(i)), target), zero).alias(n) for i, n in enumerate(names)])


def text_of_vector(x: Column, fields: list[str]) -> Column:
    return F.concat(F.lit("<"), F.concat_ws("|", *[x[f].cast("string") for f in fields]), F.lit(">"))


def text_of_list(values: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(values, lambda x: x.cast("string")), ","), F.lit("}"))


def compare(first: Column, first_type: str | LogicalType, second: Column, how: str) -> Column:
    """``lt``, ``gt`` or ``eq`` of two numbers, the second converted to the first's type; false for null.

    A second value above the first's range makes the first less, one below makes it greater; neither is equal.
    """
    t = of(first_type)
    if not t.is_number:
        return F.lit(False)
    flag, value = number_flag(second, t), to_number(second, t)
    a, b = first.cast(t.carrier), value
    in_range = flag == IN_RANGE
    result = {"lt": (flag == POSITIVE) | (in_range & (a < b)), "gt": (flag == NEGATIVE) | (in_range & (a > b)), "eq": in_range & (a == b)}[how]
    return F.coalesce(result, F.lit(False))


def same_value(type_a: Column, a: Column, type_b: Column, b: Column) -> Column:
    """Equal only if both are there, of one type and equal."""
    return F.coalesce((type_a == type_b) & (a == b), F.lit(False))


def differs(type_a: Column, a: Column, type_b: Column, b: Column) -> Column:
    """Null-safe inequality: two empty values don't differ."""
    return ~((a.isNull() & b.isNull()) | same_value(type_a, a, type_b, b))


def fuzzy_equal(a: Column, b: Column, scale: int = 1, single: bool = True) -> Column:
    """Magnitudes apart by no more than ``scale`` rounding steps; signs are ignored."""
    eps, tiny = (2.0**-23, 2.0**-126) if single else (2.0**-52, 2.0**-1022)
    big, small = F.greatest(F.abs(a), F.abs(b)), F.least(F.abs(a), F.abs(b))
    return F.when(small == 0, big < tiny * scale).otherwise(big / small <= 1 + eps * scale)


def strict(x: Column, target: str | LogicalType) -> Column:
    """A literal reading of text or numbers: what isn't exactly of the type raises under ANSI mode."""
    return x.cast(of(target).carrier)


def clamped_copy(x: Column, target: str | LogicalType) -> Column:
    """The converted value whatever its flag says."""
    return to_number(x, target)
