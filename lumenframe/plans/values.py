"""Queries of scalar conversion, scaling and array functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import convert as C
from lumenframe.functions import expr as E
from lumenframe.functions import geometry as G
from lumenframe.functions import scaling as S
from lumenframe.functions import text as T
from lumenframe.functions.types import BY_NAME
from lumenframe.operators import filters, image
from lumenframe.plans.bindings import dims, read, vector_chunks
from lumenframe.plans.registry import register

V = "list_transform(embedding, lambda x: x::DOUBLE)"
FIN = f"list_filter({V}, lambda x: isfinite(x))"
LINE = "l_orderkey, l_partkey, l_linenumber"


@register("array_minmax", f"SELECT vec_id, list_min({FIN}) AS low, list_max({FIN}) AS high FROM embeddings")
def array_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.array_range(F.col("voxels"))
    return vector_chunks(spark, sf_dir).select(F.col("lookup").alias("vec_id"), r["low"].alias("low"), r["high"].alias("high"))


RANGES = f"SELECT label::BIGINT AS image_id, min(list_min({FIN})) AS low, max(list_max({FIN})) AS high FROM embeddings GROUP BY label"


@register("image_minmax", f"SELECT image_id, low, high, 'double' AS major_type FROM ({RANGES})")
def image_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.with_major_type(image.image_range(vector_chunks(spark, sf_dir))).select("image_id", "low", "high", "major_type")


def scale_sql(ranges: str, low: float, high: float, up: bool) -> str:
    """Scale and offset of a range into an integer type, spelled out."""
    big = "1.7976931348623157e308::DOUBLE"
    ratio = lambda limit, v: f"coalesce(nullif(CASE WHEN {v} <> 0 THEN {limit}::DOUBLE / nullif({v}, 0) ELSE {big} END, 0), {big})"
    moved = f"SELECT *, CASE WHEN low > 0 OR {low} = 0 THEN -low WHEN high < 0 OR {high} = 0 THEN -high ELSE 0.0::DOUBLE END AS o FROM ({ranges})"
    least = f"SELECT *, least({ratio(high, '(high + o)')}, {ratio(low, '(low + o)')}) AS s0 FROM ({moved})"
    held = f"SELECT *, {'s0' if up else 'least(s0, 1.0::DOUBLE)'} AS scale FROM ({least})"
    return f"SELECT *, CASE WHEN scale = 1 THEN CASE WHEN low > {low} AND high < {high} THEN 0.0::DOUBLE ELSE o END ELSE o * scale END AS \"offset\" FROM ({held})"


def _autoscale(target: str) -> None:
    t = BY_NAME[target]

    @register(f"autoscale_{target}", f"SELECT image_id, scale, \"offset\" FROM ({scale_sql(RANGES, t.low, t.high, True)})")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = image.image_range(vector_chunks(spark, sf_dir))
        return r.withColumn("s", S.scaling(F.col("low"), F.col("high"), "double", target)).select("image_id", "s.scale", "s.offset")


for _t in ("u8bit", "s16bit", "u16bit", "s32bit"):
    _autoscale(_t)

QUANTITIES = "SELECT l_linenumber, min(l_quantity * 10) AS low, max(l_quantity * 10) AS high FROM lineitem GROUP BY l_linenumber"


@register(
    "scale_modes",
    " UNION ALL ".join(
        f"SELECT l_linenumber, '{mode}' AS mode, {'1.0::DOUBLE AS scale, 0.0::DOUBLE AS \"offset\"' if mode == 'noscale' else 'scale, \"offset\"'} FROM ({scale_sql(QUANTITIES, 0, 255, mode == 'upscale')})" for mode in S.MODES
    ),
)
def scale_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.min(F.col("l_quantity") * 10).alias("low"), F.max(F.col("l_quantity") * 10).alias("high"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), S.scaling(F.col("low"), F.col("high"), "s32bit", "u8bit", m).alias("s")) for m in S.MODES]))
    return r.select("l_linenumber", modes.alias("m")).select("l_linenumber", "m.mode", "m.s.scale", "m.s.offset")


@register(
    "convert_u8_half_away",
    f"""SELECT e.vec_id, '64#' || array_to_string(list_transform(list_transform({V}, lambda x: x * s.scale + s."offset"),
      lambda y: CASE WHEN y < 0 THEN ceil(y - 0.5) ELSE floor(y + 0.5) END::INTEGER), '|') AS voxels
    FROM embeddings e JOIN ({scale_sql(RANGES, 0, 255, True)}) s ON e.label = s.image_id""",
)
def convert_u8_half_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = image.converted(vector_chunks(spark, sf_dir), "u8bit")
    return d.select(F.col("lookup").alias("vec_id"), A.text_of(F.col("voxels")).alias("voxels"))


def _flag_sql(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} > {high} THEN 'pos_overflow' WHEN {x} < {low} THEN 'neg_overflow' ELSE 'in_range' END"


@register(
    "scalar_round_even",
    f"""SELECT {LINE}, CASE WHEN r > 127 THEN 127 WHEN r < -128 THEN -128 ELSE r END::TINYINT AS value, {_flag_sql('r', -128, 127)} AS flag
    FROM (SELECT {LINE}, round_even(l_quantity * l_linenumber / 2 - 20, 0) AS r FROM lineitem)""",
)
def scalar_round_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.convert_number(F.col("l_quantity") * F.col("l_linenumber") / 2 - 20, "s8bit")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", c["value"].alias("value"), c["flag"].alias("flag"))


WHOLE = ("s8bit", "u8bit", "s16bit", "u16bit", "s32bit", "u32bit")


@register("fits_into", f"SELECT {LINE}, {', '.join(f'round_even(l_extendedprice - 30000, 0) BETWEEN {BY_NAME[t].low} AND {BY_NAME[t].high} AS {t}' for t in WHOLE)} FROM lineitem")
def fits_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *[C.fits_into(F.col("l_extendedprice") - 30000, t).alias(t) for t in WHOLE])


@register(
    "compare_overflow",
    f"""SELECT {LINE}, (r > 127 OR (r BETWEEN -128 AND 127 AND l_linenumber * 10 < r)) AS is_lt, (r < -128 OR (r BETWEEN -128 AND 127 AND l_linenumber * 10 > r)) AS is_gt,
      (r BETWEEN -128 AND 127 AND l_linenumber * 10 = r) AS is_eq
    FROM (SELECT *, round_even(l_quantity * 8 - 200 + l_tax, 0) AS r FROM lineitem)""",
)
def compare_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_linenumber") * 10, F.col("l_quantity") * 8 - 200 + F.col("l_tax")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *[C.compare(a, "s8bit", b, h).alias(f"is_{h}") for h in ("lt", "gt", "eq")])


@register("string_pick_numbers", r"""SELECT event_id, array_to_string(list_transform(regexp_extract_all(props || ' at ' || value, '[0-9-][0-9eE.-]*'), lambda x: round_even(coalesce(try_cast(x AS DOUBLE), 0), 0)::INTEGER), ',') AS numbers FROM events""")
def string_pick_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("props", F.lit(" at "), F.col("value").cast("string"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(C.pick_numbers(text, "s32bit"), lambda x: x.cast("string")), ",").alias("numbers"))


@register("string_split_list", r"SELECT p_partkey, len(l) AS parts, array_to_string(l, '+') AS joined FROM (SELECT p_partkey, list_filter(string_split_regex(p_name || ', ' || p_brand || ' ;' || p_type, '[\s,;]+'), lambda x: x <> '') AS l FROM part)")
def string_split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = C.split_strings(F.concat("p_name", F.lit(", "), "p_brand", F.lit(" ;"), "p_type"))
    return read(spark, sf_dir, "part").select("p_partkey", F.size(parts).cast("long").alias("parts"), F.array_join(parts, "+").alias("joined"))


@register("bool_parse", f"SELECT {LINE}, CASE WHEN lower(l_returnflag) IN ('true', 'y', 'yes') THEN true WHEN lower(l_returnflag) IN ('false', 'n', 'no') THEN false END AS flag FROM lineitem")
def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", C.string_to_bool(F.col("l_returnflag")).alias("flag"))


@register("string_to_number", "SELECT c_custkey, CASE WHEN r > 255 THEN 255 WHEN r < 0 THEN 0 ELSE r END::SMALLINT AS digits, 0::SMALLINT AS word FROM (SELECT c_custkey, round_even(try_cast(substr(c_name, 10) AS DOUBLE) / 1, 0) AS r FROM customer)")
def string_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", C.string_to_number(F.substring("c_name", 10, 20), "u8bit").alias("digits"), C.string_to_number(F.col("c_mktsegment"), "u8bit").alias("word"))


@register("selection_parse", "SELECT c_custkey, list_position(['automobile', 'building', 'machinery'], lower(c_mktsegment))::INTEGER AS code FROM customer WHERE list_position(['automobile', 'building', 'machinery'], lower(c_mktsegment)) > 0")
def selection_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.string_to_selection(F.col("c_mktsegment"), ["Automobile", "Building", "Machinery"])
    return read(spark, sf_dir, "customer").select("c_custkey", s["code"].alias("code")).filter("code is not null")


@register("timestamp_parse", "SELECT event_id, epoch_us(ts) AS dashed, epoch_us(date_trunc('second', ts)) AS compact FROM events")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    micros = lambda s: F.unix_micros(C.string_to_timestamp(s).cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", micros(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("dashed"), micros(F.date_format(ts, "yyyyMMdd'T'HHmmss")).alias("compact"))


@register("date_parse", "SELECT o_orderkey, o_orderdate::DATE AS compact, o_orderdate::DATE AS dashed, o_orderdate::DATE AS day_first FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[C.string_to_date(F.date_format(d, f)).alias(n) for f, n in (("yyyyMMdd", "compact"), ("yyyy-MM-dd", "dashed"), ("dd.MM.yyyy", "day_first"))])


@register("ms_between", "SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-01-01 00:00:00.25')) / 1000.0::DOUBLE AS ms FROM orders")
def ms_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", T.milliseconds_between(F.lit("1995-01-01 00:00:00.25").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz")).alias("ms"))


@register("age_to_days", "SELECT p_partkey, round_even(p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 7.0 WHEN 2 THEN 30.436875 ELSE 365.2425 END::DOUBLE, 0)::INTEGER AS days FROM part")
def age_to_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in "DwMY"]), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.age_to_days(F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), unit)).alias("days"))


@register("compact_time", "SELECT event_id, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS micros, epoch_us(ts) AS merged FROM events")
def compact_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", T.compact_time_micros(F.date_format("ts", "HHmmss.SSSSSS")).alias("micros"), F.unix_micros(T.merge_date_time(F.date_trunc("day", F.col("ts")), F.col("ts")).cast("timestamp")).alias("merged")
    )


@register("number_in_name", "SELECT s_suppkey, s_suppkey AS number FROM supplier")
def number_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.number_in_name(F.concat("s_name", F.lit(".png"))).alias("number"))


@register("fuzzy_equal", f"SELECT {LINE}, greatest(a, b) / least(a, b) <= 1 + 0.00000011920928955078125::DOUBLE * 2 AS near FROM (SELECT *, l_quantity AS a, l_quantity * (1 + l_tax * 0.000001) AS b FROM lineitem)")
def fuzzy_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", C.fuzzy_equal(F.col("l_quantity"), F.col("l_quantity") * (1 + F.col("l_tax") * 0.000001), 2).alias("near"))


@register(
    "linear_index",
    f"""SELECT {LINE}, i AS "index", i % 8 AS x, (i // 8) % 50 AS y, (i // 400) % 7 AS z, i // 2800 AS t
    FROM (SELECT *, l_linenumber + 8 * (l_suppkey % 50 + 50 * (l_partkey % 7 + 7 * (l_orderkey % 3)))::BIGINT AS i FROM lineitem)""",
)
def linear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dims(8, 50, 7, 3)
    i = A.linear_index(d, F.col("l_linenumber"), F.col("l_suppkey") % 50, F.col("l_partkey") % 7, F.col("l_orderkey") % 3)
    return read(spark, sf_dir, "lineitem").withColumn("index", i).withColumn("c", A.coordinates(d, F.col("index"))).select("l_orderkey", "l_partkey", "l_linenumber", "index", "c.x", "c.y", "c.z", "c.t")


SHAPE = "l_linenumber AS c, (1 + l_partkey % 2)::INTEGER AS r, (1 + l_suppkey % 2)::INTEGER AS s, (1 + l_orderkey % 2)::INTEGER AS t"


@register(
    "shape_facts",
    f"""SELECT {LINE}, CASE WHEN t > 1 THEN 4 WHEN s > 1 THEN 3 WHEN r > 1 THEN 2 WHEN c > 1 THEN 1 ELSE 0 END AS relevant, (c * r * s * t)::BIGINT AS volume,
      2.0::DOUBLE * c + 0.5 * (c - 1) AS fov_x, 1.5::DOUBLE * r AS fov_y, 3.0::DOUBLE * s + 1.0 * (s - 1) AS fov_z, c || 'x' || r || 'x' || s || 'x' || t AS size
    FROM (SELECT *, {SHAPE} FROM lineitem)""",
)
def shape_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dims(F.col("l_linenumber"), 1 + F.col("l_partkey") % 2, 1 + F.col("l_suppkey") % 2, 1 + F.col("l_orderkey") % 2)
    rows = read(spark, sf_dir, "lineitem").withColumn("d", d)
    fov = A.field_of_view(F.col("d"), G.vector(2.0, 1.5, 3.0), G.vector(0.5, 0.0, 1.0))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", A.relevant_dims(F.col("d")).alias("relevant"), A.volume(F.col("d")).alias("volume"), *[fov[k].alias(f"fov_{k}") for k in "xyz"], image.size_text(F.col("d")).alias("size"))


FIXED = f"list_transform({V}, lambda x: round_even(x * 1000, 0)::INTEGER)"


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as whole numbers, which print alike everywhere."""
    return vector_chunks(spark, sf_dir).withColumn("voxels", F.transform("voxels", lambda x: F.rint(x * 1000).cast("int")))


@register("splice_blocks", f"SELECT vec_id, b AS block, len(p) AS n, array_to_string(p, '|') AS voxels FROM (SELECT vec_id, b, {FIXED}[b * 10 + 1:least(b * 10 + 10, 64)] AS p FROM embeddings, range(7) AS g(b))")
def splice_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fixed(spark, sf_dir).select(F.col("lookup").alias("vec_id"), F.posexplode(A.splice(F.col("voxels"), 10)).alias("block", "p"))
    return d.select("vec_id", F.col("block").cast("long").alias("block"), F.size("p").cast("long").alias("n"), F.array_join(F.transform("p", lambda x: x.cast("string")), "|").alias("voxels"))


def _flip(name: str, shape: tuple[int, int, int, int], axis: str) -> None:
    k = "crst".index(axis)
    below, n = 1, shape[k]
    for m in shape[:k]:
        below *= m
    source = f"i + {below} * ({n - 1} - 2 * ((i // {below}) % {n}))"

    @register(name, f"SELECT vec_id, '64#' || array_to_string(list_transform(range(64), lambda i: v[({source}) + 1]), '|') AS voxels FROM (SELECT vec_id, {FIXED} AS v FROM embeddings)")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _fixed(spark, sf_dir).withColumn("dims", dims(*shape))
        return image.flipped(d, axis).select(F.col("lookup").alias("vec_id"), A.text_of(F.col("voxels")).alias("voxels"))


_flip("flip_row", (8, 8, 1, 1), "c")
_flip("flip_column", (8, 8, 1, 1), "r")
_flip("flip_slice", (4, 4, 4, 1), "s")
_flip("flip_time", (4, 2, 2, 4), "t")


@register("voxel_compare", f"SELECT label::BIGINT AS image_id, sum(len(list_filter(range(64), lambda i: v[i + 1] <> v[i // 8 * 8 + 8 - i % 8])))::BIGINT AS different, (64 * count(*))::BIGINT AS total FROM (SELECT label, {FIXED} AS v FROM embeddings) GROUP BY label")
def voxel_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fixed(spark, sf_dir)
    return image.compare(d, image.flipped(d, "c"))


@register("voxel_expr", f"SELECT vec_id, x, y, CASE WHEN x > 3 THEN v * 2 + y * y * y ELSE -v END AS value FROM (SELECT vec_id, i % 8 AS x, i // 8 AS y, ({FIXED})[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS g(i))")
def voxel_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = image.voxels(_fixed(spark, sf_dir))
    value = E.voxel_expression("pos_x > 3 ? vox*2 + pos_y^3 : -vox", F.col("value"), F.col("x"), F.col("y"), F.col("z"), F.col("t"))
    return cells.select(F.col("lookup").alias("vec_id"), "x", "y", value.alias("value"))


@register("voxel_foreach", f"SELECT vec_id, '64#' || array_to_string(list_transform(range(64), lambda i: v[i + 1] + 10 * (i % 8) + 100 * (i // 8)), '|') AS voxels FROM (SELECT vec_id, {FIXED} AS v FROM embeddings)")
def voxel_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fixed(spark, sf_dir)
    return d.select(F.col("lookup").alias("vec_id"), A.text_of(A.map_voxels(F.col("voxels"), F.col("dims"), lambda v, x, y, z, t: v + 10 * x + 100 * y)).alias("voxels"))


@register("get_set_voxel", f"SELECT vec_id, v[19] AS before, -1 AS after, v[20] AS beside, NULL::INTEGER AS outside FROM (SELECT vec_id, {FIXED} AS v FROM embeddings)")
def get_set_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fixed(spark, sf_dir).withColumn("new", A.set_voxel(F.col("voxels"), F.lit(18), F.lit(-1)))
    at = lambda v, x, y: A.get_voxel(F.col(v), F.col("dims"), F.lit(x), F.lit(y), F.lit(0), F.lit(0))
    return d.select(F.col("lookup").alias("vec_id"), at("voxels", 2, 2).alias("before"), at("new", 2, 2).alias("after"), at("new", 3, 2).alias("beside"), at("new", 8, 0).alias("outside"))


@register("copy_range", f"SELECT vec_id, array_to_string(v[1:3] || v[11:20] || v[14:64], '|') AS copied, array_to_string(v[17:32], '|') AS slice FROM (SELECT vec_id, {FIXED} AS v FROM embeddings)")
def copy_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _fixed(spark, sf_dir).withColumn("dims", dims(4, 4, 4, 1))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return d.select(F.col("lookup").alias("vec_id"), text(A.copy_range(F.col("voxels"), F.col("voxels"), F.lit(10), F.lit(19), F.lit(3))).alias("copied"), text(A.copy_slice(F.col("voxels"), F.col("dims"), F.lit(1), F.lit(0))).alias("slice"))


@register("color_minmax", f"SELECT vec_id, {', '.join(f'list_min(list_transform(range(21), lambda i: v[3 * i + {k + 1}])) AS low_{c}, list_max(list_transform(range(21), lambda i: v[3 * i + {k + 1}])) AS high_{c}' for k, c in enumerate('rgb'))} FROM (SELECT vec_id, {V} AS v FROM embeddings)")
def color_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("voxels")
    d = vector_chunks(spark, sf_dir).withColumn("colors", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[F.get(v, 3 * i + k).alias(c) for k, c in enumerate("rgb")])))
    box = d.withColumn("b", S.channel_range(F.col("colors"), ["r", "g", "b"]))
    return box.select(F.col("lookup").alias("vec_id"), *[F.col(f"b.{c}.{e}").alias(f"{e}_{c}") for c in "rgb" for e in ("low", "high")])


@register("complex_minmax", f"SELECT vec_id, {', '.join(f'list_min(list_transform(range(32), lambda i: v[2 * i + {k + 1}])) AS low_{c}, list_max(list_transform(range(32), lambda i: v[2 * i + {k + 1}])) AS high_{c}' for k, c in enumerate(('re', 'im')))} FROM (SELECT vec_id, {V} AS v FROM embeddings)")
def complex_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("voxels")
    d = vector_chunks(spark, sf_dir).withColumn("z", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get(v, 2 * i).alias("re"), F.get(v, 2 * i + 1).alias("im"))))
    box = d.withColumn("b", S.channel_range(F.col("z"), ["re", "im"]))
    return box.select(F.col("lookup").alias("vec_id"), *[F.col(f"b.{c}.{e}").alias(f"{e}_{c}") for c in ("re", "im") for e in ("low", "high")])


@register("byteswap", f"SELECT {LINE}, (CASE WHEN w >= 32768 THEN w - 65536 ELSE w END)::BIGINT AS swapped16 FROM (SELECT *, (l_partkey % 256) * 256 + (l_partkey // 256) % 256 AS w FROM lineitem)")
def byteswap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", A.swap_bytes(F.col("l_partkey"), 2).alias("swapped16"))


@register("bit_unpack", "SELECT p_partkey, array_to_string(list_transform(range(8), lambda k: ((p_size >> (7 - k)) & 1)), '') AS bits, p_size AS packed FROM part")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = A.unpack_bits(F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(bits, lambda x: x.cast("string")), "").alias("bits"), F.get(A.pack_bits(bits), F.lit(0)).alias("packed"))


_KERNEL = filters.gauss_kernel(1.0)
_HALF = len(_KERNEL) // 2


@register("gauss_kernel", " UNION ALL ".join(f"SELECT {k}::INTEGER AS place, round({w!r}::DOUBLE, 9) AS weight" for k, w in enumerate(_KERNEL)))
def gauss_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(w) for w in filters.gauss_kernel(1.0)])).alias("place", "weight")).select("place", F.round("weight", 9).alias("weight"))


@register(
    "convolve_row",
    f"""SELECT vec_id, i::INTEGER AS at, round({' + '.join(f'CASE WHEN i % 8 + {k - _HALF} BETWEEN 0 AND 7 THEN v[i + {k - _HALF} + 1] * {w!r}::DOUBLE ELSE 0 END' for k, w in enumerate(_KERNEL))}, 6) AS value
    FROM (SELECT vec_id, i, {V} AS v FROM embeddings, range(64) AS g(i))""",
)
def convolve_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector_chunks(spark, sf_dir).withColumn("voxels", filters.convolve(F.col("voxels"), F.col("dims"), _KERNEL, "c"))
    return d.select(F.col("lookup").alias("vec_id"), F.posexplode("voxels").alias("at", "value")).select("vec_id", "at", F.round("value", 6).alias("value"))


def _kernel_sql(axis: str, source: str, kernel: list[float]) -> str:
    """One pass of a centred kernel along x or y of 8 x 8 voxels; neighbours outside count 0."""
    half, n = len(kernel) // 2, "p % 8" if axis == "c" else "p // 8"
    step = 1 if axis == "c" else 8
    terms = " + ".join(f"CASE WHEN {n} + {k - half} BETWEEN 0 AND 7 THEN v[p + 1 + {(k - half) * step}] * {w!r} ELSE 0 END" for k, w in enumerate(kernel))
    return f"SELECT vec_id, list_transform(range(64), lambda p: {terms}) AS v FROM ({source})"


_GAUSS = filters.gauss_kernel(filters.fwhm_to_sigma(2.0))
_GAUSSED = _kernel_sql("r", _kernel_sql("c", f"SELECT vec_id, {V} AS v FROM embeddings", _GAUSS), _GAUSS)


@register("gauss_filter", f"SELECT vec_id, i::INT AS \"at\", round(v[i + 1], 6) AS value FROM ({_GAUSSED}), range(64) AS g(i)")
def gauss_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = filters.gauss(vector_chunks(spark, sf_dir), fwhm=2.0, axes="cr")
    return d.select(F.col("lookup").alias("vec_id"), F.posexplode("voxels").alias("at", "value")).select("vec_id", "at", F.round("value", 6).alias("value"))


def _frequency_sql(step: float, low: float, high: float, steepness: float = 1000.0) -> str:
    """The filter as a Fourier sum, written out: mirrored tails, gain of every frequency, and the middle third back."""
    edge = lambda x: f"1 / (1 + exp(greatest(-700.0, least(700.0, {x}))))"
    series = "SELECT label::BIGINT AS image_id, list(embedding[1]::DOUBLE ORDER BY vec_id) AS v, list(vec_id ORDER BY vec_id) AS times, count(*)::INTEGER AS n FROM embeddings GROUP BY label"
    padded = f"SELECT image_id, times, n, 3 * n AS m, mean, list_concat(list_concat(list_reverse(x), x), list_reverse(x)) AS p FROM (SELECT *, list_transform(v, lambda y: y - mean) AS x FROM (SELECT *, list_avg(v) AS mean FROM ({series})))"
    angle = "2 * pi() * ((k * i) % m) / m"
    waves = f"SELECT image_id, k, list_sum(list_transform(range(m), lambda i: p[i + 1] * cos({angle}))) AS re, -list_sum(list_transform(range(m), lambda i: p[i + 1] * sin({angle}))) AS im, k / (m * {step}::DOUBLE) AS f, CASE WHEN k = 0 OR 2 * k = m THEN 1 ELSE 2 END AS w FROM (SELECT *, unnest(range(m // 2 + 1)) AS k FROM ({padded}))"
    gains = f"SELECT image_id, list(k ORDER BY k) AS ks, list(w * re * {edge(f'-(f - {low}) * {steepness}')} * {edge(f'(f - {high}) * {steepness}')} ORDER BY k) AS a, list(w * im * {edge(f'-(f - {low}) * {steepness}')} * {edge(f'(f - {high}) * {steepness}')} ORDER BY k) AS b FROM ({waves}) GROUP BY image_id"
    angle = "2 * pi() * ((k * (n + j)) % m) / m"
    return f"""SELECT image_id, times[j + 1] AS time, round(mean + list_sum(list_transform(ks, lambda k: a[k + 1] * cos({angle}) - b[k + 1] * sin({angle}))) / m, 6) + 0 AS filtered
    FROM (SELECT s.*, g.ks, g.a, g.b, unnest(range(s.n)) AS j FROM ({padded}) s JOIN ({gains}) g USING (image_id))"""


@register("frequency_filter", _frequency_sql(2.0, 0.01, 0.1))
def frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vector_chunks(spark, sf_dir).select("image_id", F.col("lookup").alias("time"), F.get("voxels", F.lit(0)).alias("value"))
    return filters.frequency_filter(d, ["image_id"], "time", "value", 2.0, low=0.01, high=0.1).withColumn("filtered", F.round("filtered", 6) + 0)


_WEIGHTED = f"SELECT vec_id, i::INT AS \"at\", round(v[i + 1] * w, 6) + 0 AS value FROM ({_GAUSSED}), range(64) AS g(i), (SELECT vec_id AS id, 1.0 / (1 + label) AS w FROM embeddings) x WHERE x.id = vec_id"


@register("filter_steps", _WEIGHTED)
def filter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gauss step, then a step with a further input by label: a weight for each image."""
    chunks = vector_chunks(spark, sf_dir)
    weights = chunks.select("image_id").distinct().withColumn("weight", 1.0 / (1 + F.col("image_id")))
    d = chunks.transform(filters.GAUSS.transform(fwhm=2.0, axes="cr")).transform(filters.WEIGHTED.transform({"weights": weights}, by="image_id"))
    return d.select(F.col("lookup").alias("vec_id"), F.posexplode("voxels").alias("at", "value")).select("vec_id", "at", (F.round("value", 6) + 0).alias("value"))


ANGLE = "l_linenumber * 0.4"


@register(
    "index_to_physical",
    f"""SELECT {LINE}, round(2 * x * cos(a) - 1.5 * y * sin(a) + 5, 6) AS px, round(2 * x * sin(a) + 1.5 * y * cos(a) - 7, 6) AS py, round(3.0::DOUBLE * z + 1, 6) AS pz, x::INTEGER AS ix, y::INTEGER AS iy, z::INTEGER AS iz
    FROM (SELECT *, l_partkey % 20 AS x, l_suppkey % 15 AS y, l_orderkey % 9 AS z, {ANGLE}::DOUBLE AS a FROM lineitem)""",
)
def index_to_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("l_linenumber") * 0.4).cast("double")
    m = G.orientation(G.vector(F.cos(a), F.sin(a), 0), G.vector(-F.sin(a), F.cos(a), 0), G.vector(0, 0, 1), G.vector(2.0, 1.5, 3.0))
    origin = G.vector(5, -7, 1)
    place = G.index_to_physical(m, origin, G.vector((F.col("l_partkey") % 20).cast("double"), (F.col("l_suppkey") % 15).cast("double"), (F.col("l_orderkey") % 9).cast("double")))
    rows = read(spark, sf_dir, "lineitem").withColumn("p", G.struct(place))
    back = G.physical_to_index(G.inverse(m), origin, F.col("p"))
    return rows.withColumn("i", back).select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(f"p.{k}", 6).alias(f"p{k}") for k in "xyz"], *[F.col(f"i.{k}").alias(f"i{k}") for k in "xyz"])


@register("transform_coords", f"SELECT {LINE}, round(-(l_partkey % 20)::DOUBLE - 2.0 * 9, 6) AS ox, (l_suppkey % 15)::DOUBLE AS oy, (l_orderkey % 9)::DOUBLE AS oz, -1.0::DOUBLE AS row_x FROM lineitem".replace("-(l_partkey % 20)::DOUBLE - 2.0 * 9", "(l_partkey % 20)::DOUBLE + 2.0 * 9"))
def transform_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flip of the row axis about the image's center: the origin moves to the other end."""
    r = G.from_columns(G.vector(1, 0, 0), G.vector(0, 1, 0), G.vector(0, 0, 1))
    origin = G.vector((F.col("l_partkey") % 20).cast("double"), (F.col("l_suppkey") % 15).cast("double"), (F.col("l_orderkey") % 9).cast("double"))
    flip = G.matrix([[-1, 0, 0], [0, 1, 0], [0, 0, 1]])
    new, turned = G.transform_about_center(flip, origin, r, (F.lit(10), F.lit(8), F.lit(6)), G.vector(2.0, 1.0, 1.0))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(new[k], 6).alias(f"o{k}") for k in "xyz"], turned[0]["x"].alias("row_x"))


@register("main_orientation", f"SELECT {LINE}, CASE k WHEN 0 THEN 'axial' WHEN 1 THEN 'reversed_axial' WHEN 2 THEN 'sagittal' WHEN 3 THEN 'coronal' WHEN 4 THEN 'reversed_sagittal' ELSE 'reversed_coronal' END AS orientation, CASE WHEN k IN (0, 1, 3, 5) THEN 0 ELSE 2 END AS x_runs_along FROM (SELECT *, l_partkey % 6 AS k FROM lineitem)")
def main_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # directions of rows and columns for six ways to lie in space
    ways = [((1, 0.1, 0), (-0.1, 1, 0)), ((1, 0, 0), (0, -1, 0)), ((0, 1, 0), (0, 0.1, 1)), ((1, 0, 0), (0, 0, -1)), ((0, 1, 0), (0, 0, -1)), ((1, 0, 0), (0, 0, 1))]
    pick = lambda i: F.get(F.array(*[G.struct(G.vector(*w[i])) for w in ways]), (F.col("l_partkey") % 6).cast("int"))
    rows = read(spark, sf_dir, "lineitem").withColumns({"r": pick(0), "c": pick(1)})
    r, c = F.col("r"), F.col("c")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", G.main_orientation(r, c).alias("orientation"), G.image_dimension_of_axis(r, c, G.cross(r, c), "x").alias("x_runs_along"))


@register("vector_math", f"SELECT {LINE}, (a * b + b * c + c * a)::DOUBLE AS dot, (a * a + b * b + c * c)::DOUBLE AS square, (a * c - b * b)::DOUBLE AS cross_z, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 0 WHEN abs(b) >= abs(c) THEN 1 ELSE 2 END AS largest, (a * (b * c - a * a) + b * (a * c - b * b) + c * (a * b - c * c))::DOUBLE AS det FROM (SELECT *, l_linenumber - 3 AS a, l_partkey % 7 AS b, l_suppkey % 5 - 2 AS c FROM lineitem)")
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = ((F.col("l_linenumber") - 3).cast("double"), (F.col("l_partkey") % 7).cast("double"), (F.col("l_suppkey") % 5 - 2).cast("double"))
    u, v, w = G.vector(a, b, c), G.vector(b, c, a), G.vector(c, a, b)
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *[(x + 0.0).alias(n) for n, x in (("dot", G.dot(u, v)), ("square", G.square_length(u)), ("cross_z", G.cross(u, v)["z"]), ("det", G.determinant((u, v, w))))], G.largest_component(u).alias("largest")
    )


@register("count_failures", f"SELECT label::BIGINT AS image_id, sum(len(list_filter(range(64), lambda i: NOT (v[i + 1] < i % 8 * 20))))::BIGINT AS failures FROM (SELECT label, {FIXED} AS v FROM embeddings) GROUP BY label")
def count_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.count_failures(_fixed(spark, sf_dir), lambda v, x, y, z, t: v < x * 20)


@register("repetition_time", f"SELECT vec_id, list_max(list_transform(range(63), lambda i: abs(v[i + 2] - v[i + 1]))) AS step FROM (SELECT vec_id, {FIXED} AS v FROM embeddings)")
def repetition_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed(spark, sf_dir).select(F.col("lookup").alias("vec_id"), image.repetition_time(F.col("voxels")).alias("step"))
