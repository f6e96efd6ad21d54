"""Queries of scalar, vector, text and image functions on the driver tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import convert as C
from lumenframe.functions import geometry as G
from lumenframe.functions import names
from lumenframe.functions import scaling as S
from lumenframe.functions import text as T
from lumenframe.operators import diff, image, props
from lumenframe.plans.bindings import dims, event_tree, read, vector_chunks
from lumenframe.plans.registry import register

LINE = ("l_orderkey", "l_partkey", "l_linenumber")
KEYS = ", ".join(LINE)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def _held(x: str, low: int, high: int) -> str:
    """A number rounded half to even and held at the limits, in SQL."""
    return f"CASE WHEN round_even({x}, 0) > {high} THEN {high} WHEN round_even({x}, 0) < {low} THEN {low} ELSE round_even({x}, 0) END::BIGINT"


def _flag(x: str, low: int, high: int) -> str:
    return f"CASE WHEN round_even({x}, 0) > {high} THEN 'pos_overflow' WHEN round_even({x}, 0) < {low} THEN 'neg_overflow' ELSE 'in_range' END"


MOVED = "l_extendedprice - 30000.5"


@register("convert_number", f"SELECT {KEYS}, {_held(MOVED, -32768, 32767)} AS value, {_flag(MOVED, -32768, 32767)} AS flag, {_held(MOVED, 0, 255)} AS clamped FROM lineitem")
def convert_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice") - 30000.5
    v = C.convert_number(x, "s16bit")
    return _lines(spark, sf_dir).select(*LINE, v["value"].cast("long").alias("value"), v["flag"].alias("flag"), C.clamped_copy(x, "u8bit").cast("long").alias("clamped"))


@register("as_type_or_zero", f"SELECT {KEYS}, CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT ELSE 0 END AS value, l_quantity > 25 AND l_quantity <> 0 AS flag FROM lineitem")
def as_type_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("l_quantity") > 25, F.col("l_quantity"))
    return _lines(spark, sf_dir).select(*LINE, C.as_type(x, "s32bit").cast("long").alias("value"), C.as_type(x, "boolean").alias("flag"))


@register("complex_numbers", f"SELECT {KEYS}, l_quantity AS re, -l_discount AS im, l_tax AS plain_re, 0.0::DOUBLE AS plain_im FROM lineitem")
def complex_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = C.string_to_complex(F.concat(F.lit("("), F.col("l_quantity").cast("string"), F.lit(","), (-F.col("l_discount")).cast("string"), F.lit(")")))
    plain = C.number_to_complex(F.col("l_tax"))
    return _lines(spark, sf_dir).select(*LINE, pair["re"].alias("re"), pair["im"].alias("im"), plain["re"].alias("plain_re"), plain["im"].alias("plain_im"))


FIELDS = {"x": "l_quantity * 10", "y": "l_discount * 100 - 5", "z": "l_tax * 10000"}
FIRST_FLAG = "CASE " + " ".join(f"WHEN {_flag(v, 0, 255)} <> 'in_range' THEN {_flag(v, 0, 255)}" for v in FIELDS.values()) + " ELSE 'in_range' END"


@register("convert_vector", f"SELECT {KEYS}, {', '.join(f'{_held(v, 0, 255)} AS {k}' for k, v in FIELDS.items())}, {FIRST_FLAG} AS flag FROM lineitem")
def convert_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.struct(*[F.expr(e).alias(k) for k, e in FIELDS.items()])
    d = _lines(spark, sf_dir).select(*LINE, v.alias("v"))
    out = C.convert_fields(F.col("v"), list(FIELDS), "u8bit")
    return d.select(*LINE, *[out[k].cast("long").alias(k) for k in FIELDS], C.fields_flag(F.col("v"), list(FIELDS), 3, "u8bit").alias("flag"))


@register("list_to_vector", f"SELECT vec_id, {', '.join(_held(f'(embedding[{i}]::DOUBLE * 1000)', -128, 127) + f' AS {n}' for i, n in ((1, 'x'), (2, 'y')))}, 0::BIGINT AS w FROM embeddings")
def list_to_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double") * 1000)
    v = C.list_to_vector(values, ["x", "y", "w"], "s8bit")
    return read(spark, sf_dir, "embeddings").select("vec_id", *[v[k].cast("long").alias(k) for k in ("x", "y", "w")])


@register("text_of_values", f"SELECT {KEYS}, '<' || l_partkey || '|' || l_linenumber || '|' || l_orderkey || '>' AS vector, '{{' || l_partkey || ',' || l_linenumber || '}}' AS list, '[' || l_linenumber || '; ' || l_partkey || ']' AS joined FROM lineitem")
def text_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, values = F.struct(F.col("l_partkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), F.col("l_orderkey").alias("z")), F.array("l_partkey", F.col("l_linenumber").cast("long"))
    return _lines(spark, sf_dir).select(*LINE, C.text_of_vector(v, ["x", "y", "z"]).alias("vector"), C.text_of_list(values).alias("list"), T.list_to_string(F.reverse(values), "; ", "[", "]").alias("joined"))


@register("strict_conversion", "SELECT o_orderkey, o_custkey::BIGINT AS number, o_totalprice AS price FROM orders")
def strict_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", C.strict(F.col("o_custkey").cast("string"), "s32bit").cast("long").alias("number"), C.strict(F.col("o_totalprice").cast("string"), "double").alias("price"))


@register("split_and_match_keys", "SELECT c_custkey, list_filter(string_split(c_name, '#'), lambda x: x <> '') AS parts, lower(c_mktsegment) = lower('Building') AS building FROM customer")
def split_and_match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", T.split_on(F.col("c_name"), "#").alias("parts"), T.same_key(F.col("c_mktsegment"), F.lit("Building")).alias("building"))


@register("merge_date_time", "SELECT event_id, (date_trunc('day', o.o_orderdate) + (e.ts - date_trunc('day', e.ts)))::TIMESTAMP AS merged FROM events e JOIN orders o ON o.o_orderkey = e.event_id")
def merge_date_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("day"))
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    at = T.merge_date_time(F.col("day"), F.col("ts"))
    return e.join(o, F.col("event_id") == F.col("o_orderkey")).select("event_id", at.cast("timestamp_ntz").alias("merged"))


@register("hex_dump", "SELECT p_partkey, lower(hex(encode(substr(p_name || p_type, 1, 12)))) AS dump FROM part")
def hex_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.hex_dump(F.encode(F.concat("p_name", "p_type"), "utf-8"), 12).alias("dump"))


@register("years_and_days", f"SELECT {KEYS}, round_even(l_orderkey / 365.2425::DOUBLE, 0)::INT AS years, round_even(l_linenumber * 365.2425::DOUBLE, 0)::INT AS days FROM lineitem")
def years_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*LINE, T.days_to_years(F.col("l_orderkey")).alias("years"), T.years_to_days(F.col("l_linenumber")).alias("days"))


@register(
    "vector_order",
    f"SELECT {KEYS}, least(l_quantity, l_tax) AS low_x, least(l_discount, 0.05::DOUBLE) AS low_y, greatest(l_quantity, l_tax) AS high_x, greatest(l_discount, 0.05::DOUBLE) AS high_y, "
    "row_number() OVER (ORDER BY l_linenumber, l_partkey, l_orderkey, l_quantity, l_extendedprice) AS place, "
    "CASE WHEN l_quantity >= l_discount * 500 AND l_quantity >= l_tax * 500 THEN 0 WHEN l_discount * 500 >= l_tax * 500 THEN 1 ELSE 2 END AS largest FROM lineitem",
)
def vector_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.vector(F.col("l_quantity"), F.col("l_discount"), F.lit(0.0)), G.vector(F.col("l_tax"), F.lit(0.05), F.lit(0.0))
    low, high = G.least(a, b), G.greatest(a, b)
    key = G.lexical_key({"x": F.col("l_orderkey"), "y": F.col("l_partkey"), "z": F.col("l_linenumber")})
    big = G.largest_component(G.vector(F.col("l_quantity"), F.col("l_discount") * 500, -F.col("l_tax") * 500))
    # runs of the order's first parts, so that no task sorts them all
    lines = names.numbered(_lines(spark, sf_dir), [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 1000)], [*key, F.col("l_quantity"), F.col("l_extendedprice")], "place")
    place = F.col("place")
    return lines.select(*LINE, low["x"].alias("low_x"), low["y"].alias("low_y"), high["x"].alias("high_x"), high["y"].alias("high_y"), place.cast("long").alias("place"), big.alias("largest"))


@register("fuzzy_vectors", f"SELECT {KEYS}, l_linenumber <= 4 AS near, l_linenumber <= 4 AS single FROM lineitem WHERE l_quantity > 0 AND l_tax > 0")
def fuzzy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).filter("l_quantity > 0 and l_tax > 0")
    # half a rounding step off for each line number, the last component only
    off = 1 + (F.col("l_linenumber") - 0.5) * 2.0**-23
    a = G.vector(F.col("l_quantity"), -F.col("l_quantity"), F.col("l_tax"))
    b = G.vector(F.col("l_quantity"), -F.col("l_quantity"), F.col("l_tax") * off)
    return d.select(*LINE, G.fuzzy_equal(a, b, 4).alias("near"), C.fuzzy_equal(F.col("l_tax"), F.col("l_tax") * off, 4).alias("single"))


@register("determinant", f"SELECT {KEYS}, round(l_quantity * (l_linenumber * 3 - 1) - 2 * (l_tax * 3 - l_discount) + (l_tax - l_linenumber * l_discount), 6) AS det FROM lineitem")
def determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = (G.vector(F.col("l_quantity"), F.lit(2.0), F.lit(1.0)), G.vector(F.col("l_tax"), F.col("l_linenumber"), F.lit(1.0)), G.vector(F.col("l_discount"), F.lit(1.0), F.lit(3.0)))
    return _lines(spark, sf_dir).select(*LINE, F.round(G.determinant(m), 6).alias("det"))


TURN = "(l_linenumber * 0.3)"


@register(
    "quaternions",
    f"SELECT {KEYS}, round(cos({TURN}), 9) AS xx, round(-sin({TURN}), 9) AS xy, round(sin({TURN}), 9) AS yx, CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS zz, "
    f"0.0::DOUBLE AS b, round(sin({TURN} / 2), 9) AS d, CASE WHEN l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END::DOUBLE AS qfac FROM lineitem",
)
def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("l_linenumber") * 0.15
    m = G.quaternion_to_matrix(F.lit(0.0), F.lit(0.0), F.sin(half), F.when(F.col("l_linenumber") % 2 == 0, -1.0).otherwise(1.0))
    q = G.matrix_to_quaternion(m)
    r = lambda x: F.round(x, 9)
    return _lines(spark, sf_dir).select(*LINE, r(m[0]["x"]).alias("xx"), r(m[0]["y"]).alias("xy"), r(m[1]["x"]).alias("yx"), r(m[2]["z"]).alias("zz"), r(F.abs(q["b"])).alias("b"), r(q["d"]).alias("d"), q["qfac"].alias("qfac"))


@register("flipped_geometry", f"SELECT {KEYS}, l_quantity + l_tax * 2 * (l_linenumber - 1) AS ox, l_discount + 0.5 * 2 * (l_linenumber - 1) AS oy, -l_tax AS dx, CASE WHEN l_tax >= 0.04 THEN 0 ELSE 1 END AS dimension FROM lineitem")
def flipped_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, way = G.vector(F.col("l_quantity"), F.col("l_discount"), F.lit(0.0)), G.vector(F.col("l_tax"), F.lit(0.5), F.lit(0.0))
    o, d = G.flipped_geometry(origin, way, F.lit(2.0), F.col("l_linenumber"))
    axis = G.image_dimension_of_axis(way, G.vector(F.lit(0.04), F.lit(1.0), F.lit(0.0)), G.vector(F.lit(0.0), F.lit(0.0), F.lit(1.0)), "x")
    return _lines(spark, sf_dir).select(*LINE, o["x"].alias("ox"), o["y"].alias("oy"), d["x"].alias("dx"), axis.alias("dimension"))


@register("image_labels", "SELECT o_orderkey, o_orderkey % 7 || 'x' || o_custkey % 5 || 'x3x1' AS size, 'S' || o_orderkey || '_' || o_orderpriority || '_' || o_orderstatus || ' from /data/' || o_custkey AS label FROM orders")
def image_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = image.identity(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus"), F.concat(F.lit("/data/"), F.col("o_custkey").cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", image.size_text(dims(F.col("o_orderkey") % 7, F.col("o_custkey") % 5, 3, 1)).alias("size"), label.alias("label"))


@register("nth_image", "SELECT o_orderkey AS image_id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 41")
def nth_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.nth(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_totalprice"), 41)


@register("zero_chunks", "SELECT vec_id, 0::BIGINT AS low, 0::BIGINT AS high, (3 + vec_id % 4)::INT AS n FROM embeddings")
def zero_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = A.zeros((3 + F.col("vec_id") % 4).cast("int"), "smallint")
    return read(spark, sf_dir, "embeddings").select("vec_id", z.alias("z")).select("vec_id", F.array_min("z").cast("long").alias("low"), F.array_max("z").cast("long").alias("high"), F.size("z").alias("n"))


@register(
    "voxel_rows",
    "SELECT label::BIGINT AS image_id, vec_id AS lookup, (i % 8)::INT AS x, (i // 8)::INT AS y, 0 AS z, 0 AS t, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) AS g(i) WHERE i < len(embedding)",
)
def voxel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.voxels(vector_chunks(spark, sf_dir))


@register("chunks_with_image", "SELECT vec_id AS lookup, label::BIGINT AS image_id, CASE WHEN vec_id % 3 = 0 THEN 'own' ELSE 'common ' || label END AS description, label * 2::BIGINT AS series FROM embeddings")
def chunks_with_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = vector_chunks(spark, sf_dir).select("image_id", "lookup", F.when(F.col("lookup") % 3 == 0, "own").alias("description"))
    common = chunks.select("image_id").distinct().select("image_id", F.concat(F.lit("common "), F.col("image_id").cast("string")).alias("description"), (F.col("image_id") * 2).alias("series"))
    return image.chunk_with_image(chunks, common, ["description", "series"])


@register("each_chunk", "SELECT vec_id AS lookup, list_reverse(list_transform(embedding, lambda x: x::DOUBLE * 2)) AS voxels FROM embeddings")
def each_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(frame):
        frame["voxels"] = [v[::-1] * 2 for v in frame["voxels"]]
        return frame

    return image.for_each_chunk(vector_chunks(spark, sf_dir).select("lookup", "voxels"), work)


@register("color_channels", f"SELECT {KEYS}, CASE WHEN l_quantity * 2 > 255 THEN 255 ELSE round_even(l_quantity * 2, 0) END::BIGINT AS r, floor(l_discount * 200 + 0.5)::BIGINT AS g FROM lineitem")
def color_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    colors = F.array(F.struct(F.col("l_quantity").alias("r"), (F.col("l_discount") * 100).alias("g")))
    c = F.get(S.convert_fields_array(colors, ["r", "g"], "u8bit", F.lit(2.0), F.lit(0.0)), F.lit(0))
    return _lines(spark, sf_dir).select(*LINE, c["r"].cast("long").alias("r"), c["g"].cast("long").alias("g"))


@register(
    "props_common_users",
    "SELECT user_id % 50 AS grp, 'user_id' AS path, min(user_id)::VARCHAR AS value FROM events GROUP BY user_id % 50 HAVING min(user_id) = max(user_id) "
    "UNION ALL SELECT user_id % 50, 'fixed', 'yes' FROM events GROUP BY user_id % 50",
)
def props_common_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("owner"), "user_id", "event_type", F.lit("yes").alias("fixed"))
    tree = props.from_columns(e, "owner", {"event_type": "string", "user_id": "s64bit", "fixed": "string"}).join(e.select("owner", (F.col("user_id") % 50).alias("grp")), "owner")
    found = props.common(tree, "grp").select("grp", "path", "value")
    return found.filter(F.col("path") != "event_type")


@register("insert_and_take_branch", "SELECT event_id AS owner, 'event_type' AS path, event_type AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'user_id', user_id::VARCHAR FROM events WHERE event_id % 2 = 0")
def insert_and_take_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("event_id % 2 = 0").withColumn("owner", F.col("event_id"))
    tree = props.from_columns(e, "owner", {"event_type": "string", "user_id": "s64bit"})
    other = props.from_columns(e.withColumn("value", F.col("value").cast("string")), "owner", {"value": "string"})
    return props.branch(props.insert_branch(other, tree, "Event"), "Event").select("owner", "path", "value")
