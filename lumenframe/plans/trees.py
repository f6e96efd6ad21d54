"""Queries of assembly, property trees, names and data set differences on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import geometry as G
from lumenframe.functions import names as N
from lumenframe.functions import text as T
from lumenframe.operators import assemble as AS
from lumenframe.operators import diff as D
from lumenframe.operators import image, props
from lumenframe.plans.bindings import EVENT_KINDS, dims, event_chunks, event_tree, read
from lumenframe.plans.registry import register

PLACE = f"list_position([{', '.join(repr(k) for k in EVENT_KINDS)}], event_type)"
CHUNKS = f"SELECT event_id AS arrival, user_id AS seq, {PLACE}::DOUBLE AS z, (value > 25)::BIGINT AS acq, value FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND {PLACE} > 0"
DUP = f"SELECT *, row_number() OVER (PARTITION BY seq, z, acq ORDER BY arrival) AS dup FROM ({CHUNKS})"
PLACED = f"SELECT *, min(arrival) OVER (PARTITION BY seq, dup) AS image_id, count(*) OVER (PARTITION BY seq, dup, z) AS depth FROM ({DUP})"
RECT = f"SELECT *, min(depth) OVER (PARTITION BY image_id) = max(depth) OVER (PARTITION BY image_id) AS rectangular FROM ({PLACED})"
RANKED = f"SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY z) - 1 AS h, row_number() OVER (PARTITION BY image_id, z ORDER BY acq) - 1 AS v FROM ({RECT}) WHERE rectangular"
LOOKUP = f"SELECT *, (h + v * (max(h) OVER (PARTITION BY image_id) + 1))::BIGINT AS lookup FROM ({RANKED})"


def _stride(b: str) -> str:
    near = f"list_filter(range({b}, n - {b}, {b}), lambda i: (o[i + {b} + 1] - o[1]) ** 2 <= (o[i + {b} + 1] - o[i + 1]) ** 2)[1] + {b}"
    return f"CASE WHEN n >= 4 * {b} THEN CASE WHEN o[{b} + 1] = o[1] THEN {b} ELSE coalesce({near}, n // ts) END WHEN n % {b} <> 0 THEN n - n % {b} ELSE n // ts END"


def shape_sql(below: int = 0) -> str:
    """Shape of the images whose chunks of one voxel are laid along the dimensions from ``below`` on."""
    d = f"SELECT image_id, count(*) AS n, max(depth) AS ts, list(z ORDER BY lookup) AS o, 4 - (max(depth) > 1)::INTEGER AS sd FROM ({LOOKUP}) GROUP BY image_id"
    size = "1"
    for i, a in enumerate("crst"):
        d = f"SELECT *, CASE WHEN {i} >= {below} AND {i} < sd THEN ({_stride(size)}) // ({size}) ELSE 1 END::BIGINT AS n_{a} FROM ({d})"
        size = f"({size} * n_{a})" if i else "n_c"
    return f"SELECT image_id, n_c::INTEGER AS c, n_r::INTEGER AS r, n_s::INTEGER AS s, CASE WHEN ts > 1 THEN ts ELSE n_t END::INTEGER AS t, n AS chunk_count, ts AS timesteps, n_c * n_r * n_s * CASE WHEN ts > 1 THEN ts ELSE n_t END = n AS clean FROM ({d})"


@register("assemble_images", shape_sql())
def assemble_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = AS.assemble(event_chunks(spark, sf_dir)).images
    return i.select("image_id", "dims.*", "chunk_count", "timesteps", "clean")


@register("assemble_dup_rank", f"SELECT arrival, image_id, depth, rectangular FROM ({RECT})")
def assemble_dup_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.placed(event_chunks(spark, sf_dir)).select("arrival", "image_id", "depth", "rectangular")


@register("assemble_lookup", f"SELECT arrival, image_id, h::BIGINT AS horizontal, v::BIGINT AS vertical, lookup FROM ({LOOKUP})")
def assemble_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.assemble(event_chunks(spark, sf_dir)).chunks.select("arrival", "image_id", F.col("horizontal").cast("long").alias("horizontal"), F.col("vertical").cast("long").alias("vertical"), "lookup")


@register("assemble_rejected", f"SELECT arrival, 'not rectangular' AS reason FROM ({RECT}) WHERE NOT rectangular")
def assemble_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.assemble(event_chunks(spark, sf_dir)).rejected


LINE_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@register("group_key_nullsafe", f"SELECT l_orderkey, l_linenumber, flag, count(*) AS n, max(dup) AS images FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, flag ORDER BY {LINE_KEY}) AS dup FROM (SELECT *, nullif(l_returnflag, 'N') AS flag FROM lineitem)) GROUP BY ALL")
def group_key_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of orders: null flags are one key; equal places go to further images."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    c = l.select(
        F.struct(*LINE_KEY.split(", ")).alias("arrival"), dims(1, 1, 1, 1).alias("dims"), F.col("l_orderkey").alias("sequenceNumber"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("coilString"),
        G.struct(G.vector(0, 0, F.col("l_linenumber").cast("double"))).alias("indexOrigin"), G.struct(G.vector(1, 0, 0)).alias("rowVec"), G.struct(G.vector(0, 1, 0)).alias("columnVec"), G.struct(G.vector(1, 1, 1)).alias("voxelSize"), F.lit(0).cast("long").alias("acquisitionNumber"),
    )
    p = AS.placed(c)
    return p.groupBy(F.col("sequenceNumber").alias("l_orderkey"), F.col("indexOrigin.z").cast("int").alias("l_linenumber"), F.col("coilString").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.max("__dup").cast("long").alias("images"))


@register("reject_invalid", "SELECT event_id AS arrival FROM events WHERE NOT (user_id % 7 > 0 AND event_type <> 'view')")
def reject_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_chunks(spark, sf_dir)
    c = c.withColumns({"dims": dims((F.col("sequenceNumber") % 7 > 0).cast("int"), 1, 1, 1), "indexOrigin": F.when(F.col("event_type") != "view", F.col("indexOrigin"))})
    return AS.assemble(c).rejected.filter("reason = 'invalid'").select("arrival")


@register("chunk_props_unique", "SELECT user_id AS image_id, count(*) AS n, min(event_type) AS first_name FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IS NOT NULL) WHERE before IS NULL OR before <> event_type GROUP BY user_id")
def chunk_props_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("lookup"), "event_type")
    return image.chunk_properties(e, "event_type", unique=True).select("image_id", F.size("values").cast("long").alias("n"), F.array_min("values").alias("first_name"))


TYPED = "SELECT user_id AS image_id, value, CASE event_type WHEN 'view' THEN 'double' WHEN 'click' THEN 'u8bit' ELSE 's16bit' END AS type_id FROM events"


@register("max_bytes", f"SELECT image_id, max(CASE type_id WHEN 'double' THEN 8 WHEN 'u8bit' THEN 1 ELSE 2 END)::INTEGER AS bytes FROM ({TYPED}) GROUP BY image_id")
def max_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "double").when(F.col("event_type") == "click", "u8bit").otherwise("s16bit")
    return image.max_bytes(read(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), kind.alias("type_id")))


def tree_sql(odd: int) -> str:
    own = f"SELECT * FROM events WHERE event_id % 2 = {odd}"
    parts = ("'Sub/k' AS path, 's32bit' AS type, props::JSON->>'$.k' AS value", "'event_type' AS path, 'string' AS type, event_type AS value", "'user_id' AS path, 's64bit' AS type, user_id::VARCHAR AS value")
    return " UNION ALL ".join(f"SELECT event_id // 2 AS owner, {p} FROM ({own})" for p in parts)


BOTH = f"SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.path, b.path) AS path, a.type AS ta, a.value AS va, b.type AS tb, b.value AS vb FROM ({tree_sql(0)}) a FULL JOIN ({tree_sql(1)}) b ON a.owner = b.owner AND a.path = b.path"
DIFFERS = "NOT ((va IS NULL AND vb IS NULL) OR coalesce(ta = tb AND va = vb, false))"


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return event_tree(spark, sf_dir, False), event_tree(spark, sf_dir, True)


@register("props_diff", f'SELECT owner, path, va AS "left", vb AS "right" FROM ({BOTH}) WHERE {DIFFERS}')
def props_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.difference(*_trees(spark, sf_dir)).select("owner", "path", "left", "right")


@register("props_join", f"SELECT owner, path, coalesce(va, vb) AS value FROM ({BOTH})")
def props_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.join(*_trees(spark, sf_dir)).select("owner", "path", "value")


@register("props_join_overwrite", f"SELECT owner, path, coalesce(vb, va) AS value FROM ({BOTH})")
def props_join_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.join(*_trees(spark, sf_dir), overwrite=True).select("owner", "path", "value")


@register("props_rejects", f"SELECT owner, path FROM ({BOTH}) WHERE va IS NOT NULL AND vb IS NOT NULL AND {DIFFERS}")
def props_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.rejected(*_trees(spark, sf_dir)).select("owner", "path")


@register("remove_equal", f"SELECT owner, path, va AS value FROM ({BOTH}) WHERE ta IS NOT NULL AND NOT coalesce((va IS NULL AND vb IS NULL AND tb IS NOT NULL) OR (ta = tb AND va = vb), false)")
def remove_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.remove_equal(*_trees(spark, sf_dir)).select("owner", "path", "value")


@register("props_equal", f"SELECT owner, NOT bool_or({DIFFERS}) AS equal FROM ({BOTH}) GROUP BY owner")
def props_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.equal(*_trees(spark, sf_dir))


@register("anti_keys", f"SELECT owner, path, value FROM ({tree_sql(0)}) WHERE lower(path) NOT LIKE 'sub/%'")
def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("SUB",), ("user_ID",)], "path string")
    return props.remove_keys(event_tree(spark, sf_dir, False), keys, needed=("user_id",)).select("owner", "path", "value")


GROUPED = f"SELECT owner % 200 AS grp, owner, path, type, value FROM ({tree_sql(0)})"
SIZES = f"SELECT grp, count(DISTINCT owner) AS n FROM ({GROUPED}) GROUP BY grp"
COMMON = f"SELECT c.grp, c.path, c.value FROM (SELECT grp, path, min(value) AS value, count(DISTINCT owner) AS have, count(DISTINCT value) AS kinds FROM ({GROUPED}) WHERE value IS NOT NULL GROUP BY grp, path) c JOIN ({SIZES}) s ON c.grp = s.grp WHERE have = n AND kinds = 1"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tree(spark, sf_dir, False).withColumn("grp", F.col("owner") % 200)


@register("props_common", COMMON)
def props_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.common(_grouped(spark, sf_dir), "grp").select("grp", "path", "value")


@register("props_unique", f"SELECT g.grp, g.owner, g.path, g.value FROM ({GROUPED}) g WHERE NOT EXISTS (SELECT 1 FROM ({COMMON}) c WHERE c.grp = g.grp AND c.path = g.path)")
def props_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.unique(_grouped(spark, sf_dir), "grp").select("grp", "owner", "path", "value")


@register("props_find", f"SELECT owner, path, value FROM ({tree_sql(1)}) WHERE path = 'Sub/k'")
def props_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.find(event_tree(spark, sf_dir, True), "K").select("owner", "path", "value")


@register("props_rename", f"SELECT owner, CASE WHEN path = 'Sub/k' THEN 'Top/Deep/k' ELSE path END AS path, value FROM ({tree_sql(0)})")
def props_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.rename(event_tree(spark, sf_dir, False), "sub", "Top/Deep").select("owner", "path", "value")


@register("props_transform", f"SELECT owner, CASE WHEN path = 'Sub/k' THEN 'small' ELSE path END AS path, CASE WHEN path = 'Sub/k' THEN 's8bit' ELSE type END AS type, CASE WHEN path = 'Sub/k' AND NOT value::INTEGER BETWEEN -128 AND 127 THEN NULL ELSE value END AS value FROM ({tree_sql(0)})")
def props_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.transform(event_tree(spark, sf_dir, False), "Sub/K", "s8bit", "small").select("owner", "path", "type", "value")


@register("props_keys", f"SELECT DISTINCT owner, path FROM ({tree_sql(0)})")
def props_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.keys(event_tree(spark, sf_dir, False)).select("owner", "path")


@register("props_missing", f"SELECT DISTINCT owner, 'indexOrigin' AS path FROM ({tree_sql(0)})")
def props_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_tree(spark, sf_dir, False)
    return props.missing(t, t, ("indexOrigin", "USER_ID"))


@register("props_branch", f"SELECT owner, 'k' AS path, value FROM ({tree_sql(0)}) WHERE path = 'Sub/k'")
def props_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.branch(event_tree(spark, sf_dir, False), "SUB").select("owner", "path", "value")


@register("props_get", f"SELECT owner, value::SMALLINT AS value FROM ({tree_sql(0)}) WHERE path = 'Sub/k'")
def props_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.get(event_tree(spark, sf_dir, False), "sub/K", "u8bit")


@register("props_set", f"SELECT owner, path, type, CASE WHEN path = 'Sub/k' THEN (owner % 1000)::VARCHAR ELSE value END AS value FROM ({tree_sql(0)})")
def props_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = event_tree(spark, sf_dir, False)
    new = t.select("owner").distinct().withColumn("value", F.col("owner") % 1000)
    return props.set_value(t, "SUB/k", "double", new).select("owner", F.when(F.col("path_lc") == "sub/k", "Sub/k").otherwise(F.col("path")).alias("path"), "type", "value")


@register("props_listing", f"SELECT owner, string_agg(rpad(path, 10, ' ') || ' : ' || coalesce(value, ''), chr(10) ORDER BY lower(path)) AS text FROM ({tree_sql(0)}) GROUP BY owner")
def props_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return props.listing(event_tree(spark, sf_dir, False))


PRIORITY = "regexp_replace(o_orderpriority, '[\\s/\\\\]', '_', 'g')"


@register("filename_template", f"SELECT o_orderkey, 'S' || lpad((o_orderkey % 60000)::VARCHAR, 5, '0') || '_' || {PRIORITY} || '_.nii' AS name FROM orders")
def filename_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"sequenceNumber": F.col("o_orderkey") % 60000, "priority": F.col("o_orderpriority")}
    return read(spark, sf_dir, "orders").select("o_orderkey", N.file_name("S{%d_sequencenumber}_{Priority}_{gone}.nii", columns, {"sequenceNumber": "u16bit"}).alias("name"))


@register("unique_names", "SELECT o_orderkey, CASE WHEN n > 1 THEN base || '_' || lpad(k::VARCHAR, len(n::VARCHAR)::INTEGER, '0') || '.nii.gz' ELSE base || '.nii.gz' END AS unique_name FROM (SELECT o_orderkey, base, count(*) OVER (PARTITION BY base) AS n, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS k FROM (SELECT o_orderkey, 'c' || o_custkey AS base FROM orders))")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".nii.gz")).alias("name"))
    return N.unique_names(d, "name", ["o_orderkey"], [".gz", ".nii.gz", ".nii"]).select("o_orderkey", "unique_name")


@register("common_source", "SELECT o_custkey, '/data/' || (o_custkey % 10) || '/' || o_custkey || CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN '/' || min(o_orderstatus) ELSE '' END AS folder FROM orders GROUP BY o_custkey")
def common_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("/data"), F.col("o_custkey") % 10, "o_custkey", "o_orderstatus")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(path).alias("p")).select("o_custkey", T.common_folder(F.col("p")).alias("folder"))


LEFT = "SELECT event_id AS image_id, user_id, event_type FROM events WHERE event_id % 2 = 0"
RIGHT = "SELECT event_id AS image_id, user_id, event_type FROM events WHERE event_id % 2 = 1"
MATCH = f"SELECT l.left_id, r.image_id AS right_id FROM (SELECT min(image_id) AS left_id, user_id, event_type FROM ({LEFT}) GROUP BY user_id, event_type) l JOIN ({RIGHT}) r ON l.user_id IS NOT DISTINCT FROM r.user_id AND l.event_type IS NOT DISTINCT FROM r.event_type"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), "user_id", "event_type")
    return e.filter("image_id % 2 = 0"), e.filter("image_id % 2 = 1")


@register("dataset_diff_match", MATCH)
def dataset_diff_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.match(*_sides(spark, sf_dir), ["user_id", "event_type"])


@register("dataset_diff_unmatched", f"SELECT 'left' AS side, image_id FROM ({LEFT}) WHERE image_id NOT IN (SELECT left_id FROM ({MATCH})) UNION ALL SELECT 'right', image_id FROM ({RIGHT}) WHERE image_id NOT IN (SELECT right_id FROM ({MATCH}))")
def dataset_diff_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = _sides(spark, sf_dir)  # noqa: E741
    return D.unmatched(l, r, D.match(l, r, ["user_id", "event_type"]))


@register("dataset_diff_meta", f"SELECT m.left_id AS owner, 'value' AS path, a.value::DECIMAL(12, 2) AS \"left\", b.value::DECIMAL(12, 2) AS \"right\" FROM ({MATCH}) m JOIN events a ON a.event_id = m.left_id JOIN events b ON b.event_id = m.right_id WHERE m.right_id = (SELECT min(x.right_id) FROM ({MATCH}) x WHERE x.left_id = m.left_id) AND a.value <> b.value")
def dataset_diff_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = _sides(spark, sf_dir)  # noqa: E741
    m = D.match(l, r, ["user_id", "event_type"]).groupBy("left_id").agg(F.min("right_id").alias("right_id"))
    tree = props.from_columns(read(spark, sf_dir, "events"), "event_id", {"value": "double", "event_type": "string"})
    left = tree.join(m.select(F.col("left_id").alias("owner")), "owner", "left_semi")
    right = tree.join(m, F.col("owner") == F.col("right_id")).drop("owner", "right_id").withColumnRenamed("left_id", "owner").select(*props.COLUMNS)
    return props.difference(left, right).select("owner", "path", F.col("left").cast("decimal(12,2)").alias("left"), F.col("right").cast("decimal(12,2)").alias("right"))


@register("drop_with", "SELECT event_id AS image_id FROM events WHERE event_id % 2 = 0 AND event_type IS DISTINCT FROM 'click'")
def drop_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.drop_with(_sides(spark, sf_dir)[0], "event_type", "click").select("image_id")


@register("auto_splice", "SELECT vec_id * 10 + s AS acquisitionNumber, vec_id, round(1 + s * 2.0::DOUBLE, 6) AS z, array_to_string(list_transform(embedding[s * 16 + 1:s * 16 + 16], lambda x: round_even(x::DOUBLE * 1000, 0)::INTEGER), '|') AS voxels FROM embeddings, range(4) AS g(s)")
def auto_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("vec_id") * 10).alias("acquisitionNumber"), dims(4, 4, 4, 1).alias("dims"), F.transform("embedding", lambda x: F.rint(x.cast("double") * 1000).cast("int")).alias("voxels"),
        G.struct(G.vector(1, 1, 1)).alias("indexOrigin"), G.struct(G.vector(1, 0, 0)).alias("rowVec"), G.struct(G.vector(0, 1, 0)).alias("columnVec"), G.struct(G.vector(1, 1, 1)).alias("voxelSize"), G.struct(G.vector(1, 1, 1)).alias("voxelGap"),
    )
    s = image.auto_splice(e)
    return s.select("acquisitionNumber", "vec_id", F.round("indexOrigin.z", 6).alias("z"), F.array_join(F.transform("voxels", lambda x: x.cast("string")), "|").alias("voxels"))


@register("gathered_image", "SELECT label::BIGINT AS image_id, (count(*) * 64)::BIGINT AS n, arg_min(embedding, vec_id)[1]::DOUBLE AS first, arg_max(embedding, vec_id)[64]::DOUBLE AS last FROM embeddings GROUP BY label")
def gathered_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("lookup"), F.transform("embedding", lambda x: x.cast("double")).alias("voxels"))
    return image.gathered(e).select("image_id", F.size("voxels").cast("long").alias("n"), F.element_at("voxels", 1).alias("first"), F.element_at("voxels", -1).alias("last"))


@register("voxel_lookup", "SELECT label::BIGINT AS image_id, (vec_id % 8)::BIGINT AS x, 2::BIGINT AS y, r AS z, embedding[vec_id % 8 + 17]::DOUBLE AS value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)")
def voxel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels asked by place: 8 x 8 chunks stacked along the slices of their label's image."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    chunks = e.select(F.col("label").cast("long").alias("image_id"), F.col("r").cast("long").alias("lookup"), F.transform("embedding", lambda x: x.cast("double")).alias("voxels"))
    images = e.groupBy(F.col("label").cast("long").alias("image_id")).agg(F.count(F.lit(1)).alias("n")).select("image_id", dims(8, 8, F.col("n"), 1).alias("dims"))
    places = e.select(F.col("label").cast("long").alias("image_id"), (F.col("vec_id") % 8).alias("x"), F.lit(2).cast("long").alias("y"), F.col("r").cast("long").alias("z"), F.lit(0).cast("long").alias("t"))
    return image.voxel_at(chunks, images, places).select("image_id", "x", "y", "z", "value")


@register("spliced_property", "SELECT vec_id, p, (vec_id + p)::BIGINT AS value FROM embeddings, range(4) AS g(p)")
def spliced_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("vec_id") + i).alias("values"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("p"))
    return e.select("vec_id", "p", F.get(A.spliced_property(F.col("values"), F.lit(4), F.col("p").cast("int")), F.lit(0)).alias("value"))


@register("duplicate_metadata", "SELECT min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1")
def duplicate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = image.duplicate_metadata(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey")
    return d.select(F.element_at("ids", 1).alias("first"), F.size("ids").cast("long").alias("n"))
