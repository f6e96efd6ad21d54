"""Property trees in long form: a row per leaf with ``owner``, ``path`` (as written), ``idx`` (place in a list), ``type``, ``value`` (text).

Paths are compared without case; ``/`` separates branches.  A row with a null value is an empty property.  Everything is a
join or grouping on (owner, path), so trees of any number of owners spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import convert as C

KEY = ("owner", "path_lc", "idx")
COLUMNS = ("owner", "path", "path_lc", "idx", "type", "value")


def with_key(props: DataFrame) -> DataFrame:
    """Add the lower-case path (and idx 0 where there is none)."""
    out = props.withColumn("path_lc", F.lower("path"))
    return out if "idx" in props.columns else out.withColumn("idx", F.lit(0))


def from_json(rows: DataFrame, owner: str, json: str, prefix: str = "") -> DataFrame:
    """Leaves of a flat JSON object per row: whole numbers, decimals, and strings."""
    entries = F.explode(F.map_entries(F.from_json(F.col(json), "map<string,string>")))
    d = rows.select(F.col(owner).alias("owner"), entries.alias("e")).select("owner", F.concat(F.lit(prefix), F.col("e.key")).alias("path"), F.col("e.value").alias("value"))
    kind = F.when(F.col("value").rlike(r"^-?[0-9]+$"), "s32bit").when(F.col("value").rlike(r"^-?[0-9]+\.[0-9]*([eE][-+]?[0-9]+)?$"), "double").otherwise("string")
    return with_key(d.withColumn("type", kind)).select(*COLUMNS)


def from_columns(rows: DataFrame, owner: str, types: dict[str, str], prefix: str = "") -> DataFrame:
    """A leaf per listed column."""
    leaves = [F.struct(F.lit(prefix + c).alias("path"), F.lit(t).alias("type"), F.col(c).cast("string").alias("value")) for c, t in types.items()]
    return with_key(rows.select(F.col(owner).alias("owner"), F.explode(F.array(*leaves)).alias("p")).select("owner", "p.*")).select(*COLUMNS)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in COLUMNS])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in COLUMNS])
    on = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in KEY]
    return left.join(right, on[0] & on[1] & on[2], "full")


def _either(name: str, first: str = "a", second: str = "b") -> Column:
    return F.coalesce(F.col(f"{first}_{name}"), F.col(f"{second}_{name}")).alias(name)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(owner, path, idx, left_type, left, right_type, right) where the trees differ; two empty values don't."""
    unequal = C.differs(F.col("a_type"), F.col("a_value"), F.col("b_type"), F.col("b_value"))
    return _both(a, b).filter(unequal).select(
        _either("owner"), _either("path"), _either("idx"),
        F.col("a_type").alias("left_type"), F.col("a_value").alias("left"), F.col("b_type").alias("right_type"), F.col("b_value").alias("right"),
    )


def join(a: DataFrame, b: DataFrame, overwrite: bool = False) -> DataFrame:
    """Both trees in one; where both have a value, the first's stays (or the second's, if ``overwrite``); empty ones are filled."""
    first, second = ("b", "a") if overwrite else ("a", "b")
    picked = F.col(f"{first}_value").isNotNull()
    return _both(a, b).select(
        _either("owner"), _either("path"), _either("path_lc"), _either("idx"),
        F.when(picked, F.col(f"{first}_type")).otherwise(F.coalesce(f"{second}_type", f"{first}_type")).alias("type"),
        F.when(picked, F.col(f"{first}_value")).otherwise(F.col(f"{second}_value")).alias("value"),
    )


def rejected(a: DataFrame, b: DataFrame) -> DataFrame:
    """(owner, path, idx) that a join without overwriting refuses: both have values and they differ."""
    both = F.col("a_value").isNotNull() & F.col("b_value").isNotNull()
    return _both(a, b).filter(both & C.differs(F.col("a_type"), F.col("a_value"), F.col("b_type"), F.col("b_value"))).select(_either("owner"), _either("path"), _either("idx"))


def common(props: DataFrame, group: str, members: str = "owner") -> DataFrame:
    """(group, path_lc, type, value) of leaves that every member of a group has with one type and value (lists stay out).

    ``props`` has a group column beside the tree's.
    """
    sizes = props.groupBy(group).agg(F.count_distinct(members).alias("n"))
    scalar = props.filter(F.col("value").isNotNull()).groupBy(group, "path_lc").agg(
        F.count_distinct(members).alias("have"), F.max("idx").alias("list"), F.count_distinct("type", "value").alias("kinds"), F.min("path").alias("path"), F.min("type").alias("type"), F.min("value").alias("value")
    )
    return scalar.join(sizes, group).filter("have = n and kinds = 1 and list = 0").select(group, "path", "path_lc", "type", "value")


def unique(props: DataFrame, group: str, members: str = "owner") -> DataFrame:
    """The leaves that are not common to their group."""
    return props.join(common(props, group, members).select(group, "path_lc"), [group, "path_lc"], "left_anti")


def remove_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first tree without what the second has too (two empty values count as equal)."""
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in (*KEY, "type", "value")])
    on = [F.col(k) == F.col(f"b_{k}") for k in KEY]
    same = (F.col("value").isNull() & F.col("b_value").isNull()) | ((F.col("type") == F.col("b_type")) & (F.col("value") == F.col("b_value")))
    return a.join(right, on[0] & on[1] & on[2] & F.coalesce(same, F.lit(False)), "left_anti")


def remove_keys(a: DataFrame, keys: DataFrame, needed: tuple[str, ...] = ()) -> DataFrame:
    """The tree without the paths (and whole branches) in ``keys`` (path); needed ones stay."""
    gone = keys.select(F.lower("path").alias("__gone")).distinct()
    parts = F.split("path_lc", "/")
    branches = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # of each path its branches are looked up, so keys of any number are joined by value
    hit = a.select("path_lc").distinct().select(F.col("path_lc").alias("__hit"), F.explode(branches).alias("__gone")).join(gone, "__gone", "left_semi")
    if needed:
        hit = hit.filter(~F.col("__hit").isin([n.lower() for n in needed]))
    return a.join(hit.select("__hit").distinct(), F.col("path_lc") == F.col("__hit"), "left_anti")


def require(props: DataFrame, owners: DataFrame, names: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Move leaves to other paths (``names``: old to new): the new tree, and (owner, path) of each old leaf that an owner lacks or has empty."""
    gaps = missing(props, owners, tuple(names))
    out = props
    for old, new in names.items():
        out = rename(out, old, new)
    return out, gaps


def find(props: DataFrame, name: str) -> DataFrame:
    """(owner, path, value) of the shallowest leaf whose last part is ``name``; of equals the first path."""
    depth = F.size(F.split("path_lc", "/"))
    hits = props.filter(F.element_at(F.split("path_lc", "/"), -1) == name.lower())
    best = hits.groupBy("owner").agg(F.min_by(F.struct("path", "type", "value"), F.struct(depth.alias("d"), F.col("path_lc"), F.col("idx"))).alias("p"))
    return best.select("owner", "p.path", "p.type", "p.value")


def rename(props: DataFrame, old: str, new: str) -> DataFrame:
    """A leaf or branch under another path; a leaf of the new name gives way."""
    o, n = old.lower(), new.lower()
    is_leaf, in_branch = F.col("path_lc") == o, F.startswith(F.col("path_lc"), F.lit(o + "/"))
    owners = props.filter(is_leaf | in_branch).select("owner").distinct().withColumn("__moved", F.lit(True))
    kept = props.join(owners, "owner", "left").filter(~((F.col("path_lc") == n) & F.coalesce("__moved", F.lit(False)) & F.lit(o != n))).drop("__moved")
    moved = F.when(F.col("path_lc") == o, F.lit(new)).when(F.startswith(F.col("path_lc"), F.lit(o + "/")), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))).otherwise(F.col("path"))
    return with_key(kept.withColumn("path", moved)).select(*props.columns)


def transform(props: DataFrame, path: str, target: str, new: str | None = None) -> DataFrame:
    """One leaf in another numeric type (rounded half to even, null out of range), maybe under another path."""
    hit = F.col("path_lc") == path.lower()
    number = C.parse_double(F.col("value"))
    value = F.when(C.number_flag(number, target) == C.IN_RANGE, C.to_number(number, target).cast("string"))
    out = props.withColumns({"value": F.when(hit, value).otherwise(F.col("value")), "type": F.when(hit, F.lit(target)).otherwise(F.col("type"))})
    return rename(out, path, new) if new else out


def keys(props: DataFrame) -> DataFrame:
    return props.select("owner", "path", "path_lc").distinct()


def lists(props: DataFrame) -> DataFrame:
    """Paths that hold more than one value."""
    return props.groupBy("owner", "path_lc").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(props: DataFrame, owners: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """(owner, path) of needed properties that are absent or empty."""
    wanted = owners.select("owner").distinct().withColumn("path", F.explode(F.array(*[F.lit(n) for n in needed]))).withColumn("path_lc", F.lower("path"))
    return wanted.join(props.filter(F.col("value").isNotNull()).select("owner", "path_lc"), ["owner", "path_lc"], "left_anti").select("owner", "path")


def branch(props: DataFrame, path: str) -> DataFrame:
    """A branch as a tree of its own."""
    start = path.lower() + "/"
    return with_key(props.filter(F.startswith(F.col("path_lc"), F.lit(start))).withColumn("path", F.substring("path", len(start) + 1, 1 << 20))).select(*props.columns)


def insert_branch(props: DataFrame, tree: DataFrame, path: str) -> DataFrame:
    """``tree`` under a path of ``props``."""
    return props.unionByName(with_key(tree.withColumn("path", F.concat(F.lit(path + "/"), "path"))).select(*props.columns))


def get(props: DataFrame, path: str, target: str | None = None) -> DataFrame:
    """(owner, value) at a path; converted with a zero default if ``target`` is a numeric type."""
    found = props.filter((F.col("path_lc") == path.lower()) & (F.col("idx") == 0))
    value = F.col("value") if target is None else C.string_to_number(F.col("value"), target)
    return found.select("owner", value.alias("value"))


def set_value(props: DataFrame, path: str, kind: str, value: DataFrame) -> DataFrame:
    """(owner, value) put at a path; a property that is there keeps its type if the new value fits it, else its value."""
    new = value.select(F.col("owner").alias("__o"), F.col("value").cast("string").alias("__v"))
    hit = props.filter((F.col("path_lc") == path.lower()) & (F.col("idx") == 0)).join(new, F.col("owner") == F.col("__o"), "full")
    number = C.parse_double(F.col("__v"))
    keeps = F.col("value").isNotNull() & (F.col("type") != kind)
    fits = F.lit(False)
    converted = F.lit(None).cast("string")
    for t in ("s8bit", "u8bit", "s16bit", "u16bit", "s32bit", "u32bit", "float", "double"):
        ok = (F.col("type") == t) & number.isNotNull() & C.fits_into(number, t)
        fits, converted = fits | ok, F.when(ok, C.to_number(number, t).cast("string")).otherwise(converted)
    fits = F.when(F.col("type") == "string", True).otherwise(F.coalesce(fits, F.lit(False)))
    converted = F.when(F.col("type") == "string", F.col("__v")).otherwise(converted)
    result = F.when(F.col("__v").isNull(), F.col("value")).when(keeps, F.when(fits, converted).otherwise(F.col("value"))).otherwise(F.col("__v"))
    changed = hit.select(F.coalesce("owner", "__o").alias("owner"), F.coalesce("path", F.lit(path)).alias("path"), F.lit(path.lower()).alias("path_lc"), F.lit(0).alias("idx"), F.when(keeps, F.col("type")).otherwise(F.lit(kind)).alias("type"), result.alias("value"))
    rest = props.filter(~((F.col("path_lc") == path.lower()) & (F.col("idx") == 0)))
    return rest.select(*COLUMNS).unionByName(changed.select(*COLUMNS))


def listing(props: DataFrame) -> DataFrame:
    """(owner, text): a line per leaf, names padded to the longest, in path order."""
    width = props.groupBy("owner").agg(F.max(F.length("path")).alias("__w"))
    line = F.struct("path_lc", "idx", F.concat(F.rpad("path", F.col("__w"), " "), F.lit(" : "), F.coalesce("value", F.lit(""))).alias("line"))
    return props.join(width, "owner").groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("text"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(owner, equal) for all owners of either tree."""
    owners = a.select("owner").union(b.select("owner")).distinct()
    return owners.join(difference(a, b).select("owner").distinct().withColumn("__d", F.lit(True)), "owner", "left").select("owner", F.col("__d").isNull().alias("equal"))
