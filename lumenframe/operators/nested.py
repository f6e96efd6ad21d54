"""Nested JSON documents as property trees, a document's leaves dealt out from its own row.

Objects are branches, their keys the parts of a path; a key may be cut into several parts at a separator.  A list of whole numbers, of
numbers, or of texts is one property of a list type; under the branches named in ``list_branches`` (values by volume or by slice), and where a list is mixed or holds
lists, it is a property with several values, told apart by ``idx``.  Objects in a list are branches ``name[0]``, ``name[1]``, ...  A null is an empty
property; empty objects and lists have no leaf.

Spark decides which texts are JSON objects, and writes lists and numbers that aren't whole.  The walk down a document of any depth, which has no built-in function,
is a small kernel on Arrow batches; rows don't move, and documents of any number are independent of each other.
"""

from __future__ import annotations

import json as J
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import props

#: Branches whose lists are values by volume or slice.
LIST_BRANCHES = ("samples", "slices")
#: Leaves in an Arrow batch that goes back, and those of one document more.
BATCH = 1 << 15
#: A leaf's type while its text is JSON of no list type; it becomes a string.
_JSON = "json"


class _Raw(str):
    """Text as it stands in a document outside of its strings: a number that isn't whole, or a mark."""


_DECODER = J.JSONDecoder(parse_float=_Raw, strict=False)
_CONSTANTS = {None: "null", True: "true", False: "false"}
_NESTED, _INT, _STR, _NUMBER = (frozenset(t) for t in ((list, dict), (int,), (str,), (int, _Raw)))


def _parsed(data: bytes) -> dict:
    """The object that Spark found at the start of a text."""
    text = data.decode("utf-8", "replace")
    return _DECODER.raw_decode(text, text.index("{"))[0]


def _scalar_json(v: object) -> str:
    t = type(v)
    return str(v) if t is int else J.encoder.encode_basestring(v) if t is str else v if t is _Raw else _CONSTANTS[v]


def _json(v: list) -> str:
    """A list as JSON, its numbers as they were; without recursion, as lists may be deep."""
    if _NESTED.isdisjoint(map(type, v)):
        return "[" + ",".join(map(_scalar_json, v)) + "]"
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if type(x) is list:
            out.append("[")
            todo.append(_Raw("]"))
            for i in range(len(x) - 1, -1, -1):
                todo += (x[i], _Raw(",")) if i else (x[i],)
        elif type(x) is dict:
            out.append("{")
            todo.append(_Raw("}"))
            for i, (key, e) in enumerate(x.items()):
                todo += (_Raw(","),) * (i > 0) + (e, _Raw(J.encoder.encode_basestring(key) + ":"))
        else:
            out.append(_scalar_json(x))
    return "".join(out)


def _list_type(v: list) -> str | None:
    """The list type that holds all elements; nulls fit all of them."""
    kinds = set(map(type, v))
    kinds.discard(type(None))
    if kinds <= _INT:
        return "list_int" if all(x is None or -(1 << 63) <= x < 1 << 63 for x in v) else "list_double"
    return "list_string" if kinds == _STR else "list_double" if kinds <= _NUMBER else None


def _typed(v: object) -> tuple[str, str | None]:
    """Type and text of a value."""
    t = type(v)
    if t is int:
        return ("s32bit" if -(1 << 31) <= v < 1 << 31 else "s64bit" if -(1 << 63) <= v < 1 << 63 else "double"), str(v)
    if t is str:
        return "string", v
    if t is _Raw:  # a decimal has no negative zero
        return "double", "0.0" if not v.strip("-0.") and len(v.partition(".")[2]) <= 38 else v
    if t is list:
        return _list_type(v) or _JSON, _json(v)
    return ("string", None) if v is None else ("boolean", _CONSTANTS[v])


def document_leaves(document: dict, separator: str | None, list_branches: frozenset[str]) -> list[tuple[str, int, str, str | None]]:
    """(path, idx, type, text) of a document's leaves."""
    out, todo = [], [("", document)]
    while todo:
        above, opened = todo.pop()
        named = type(opened) is dict
        start, cut = above and named and above + "/" or above, named and separator
        for name, v in opened.items() if named else [(f"[{i}]", x) for i, x in enumerate(opened)]:
            path = start + (name.replace(separator, "/") if cut else name)
            t = type(v)
            if t is dict or t is list and dict in map(type, v):
                todo.append((path, v))
            elif t is not list:
                out.append((path, 0, *_typed(v)))
            elif v and (kind := _list_type(v)) and list_branches.isdisjoint(path.lower().split("/")[:-1]):
                out.append((path, 0, kind, _json(v)))
            else:
                out += [(path, i, *_typed(x)) for i, x in enumerate(v)]
    return out


def _first_of_name(leaves: list[tuple]) -> list[tuple]:
    """Of leaves whose paths differ by case only, those of the first path.  Mostly there are none, then nothing is sorted."""
    paths = {x[0] for x in leaves}
    if len({p.lower() for p in paths}) == len(paths):
        return leaves
    first = {p.lower(): p for p in sorted(paths, reverse=True)}
    return [x for x in leaves if first[x[0].lower()] == x[0]]


def _texts(values: Iterable[str | None]) -> pa.Array:
    """Halves of a surrogate pair, which an escape may name alone, have no encoding; as in Spark they become question marks."""
    values = list(values)
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _walked(docs: DataFrame, separator: str | None, list_branches: frozenset[str]) -> DataFrame:
    """(owner, path, idx, type, text) of the leaves of all documents (owner, json as bytes); a null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, rows, leaves = b.column("owner"), [], []

            def out() -> pa.RecordBatch:
                path, idx, kind, text = zip(*leaves)
                return pa.RecordBatch.from_arrays([owners.take(pa.array(rows)), _texts(path), pa.array(idx, pa.int32()), pa.array(kind, pa.string()), _texts(text)], names=["owner", "path", "idx", "type", "text"])

            for i, data in enumerate(b.column("json").to_pylist()):
                if data is None:
                    continue
                found = _first_of_name(document_leaves(_parsed(data), separator, list_branches))
                rows += [i] * len(found)
                leaves += found
                if len(leaves) >= BATCH:
                    yield out()
                    rows, leaves = [], []
            if leaves:
                yield out()

    fields = [docs.schema["owner"], *[T.StructField(n, t) for n, t in (("path", T.StringType()), ("idx", T.IntegerType()), ("type", T.StringType()), ("text", T.StringType()))]]
    return docs.mapInArrow(run, T.StructType(fields))


def from_nested_json(rows: DataFrame, owner: str, json: str, separator: str | None = None, list_branches: tuple[str, ...] = LIST_BRANCHES) -> tuple[DataFrame, DataFrame]:
    """The property tree of a JSON document per row, and the owners whose text is no JSON object.

    Paths of a document that differ by case only, or do so by the separator, are one property: that of the first path in the order of code points.  This is
    settled in the document's row, so leaves never move.
    """
    docs = rows.select(F.col(owner).alias("owner"), F.col(json).alias("json")).withColumn("v", F.try_parse_json("json"))
    sound = F.try_variant_get("v", "$", "struct<>").isNotNull()  # an object of any keys
    refused = docs.filter(F.col("json").isNotNull() & ~sound).select("owner")
    d = _walked(docs.select("owner", F.when(sound, F.col("json").cast("binary")).alias("json")), separator, frozenset(b.lower() for b in list_branches))
    kind, text = F.col("type"), F.col("text")
    value = F.when(kind == "double", text.cast("double").cast("string")).when(kind.isin("list_double", "list_string", _JSON), F.to_json(F.parse_json(text))).otherwise(text)
    tree = d.select("owner", "path", F.lower("path").alias("path_lc"), "idx", F.when(kind == _JSON, "string").otherwise(kind).alias("type"), value.alias("value"))
    return tree.select(*props.COLUMNS), refused
