"""Edge cases of re-indexing, splices, mixed types, typed voxels, nested documents, matrices, predicates, the writer and the chunk feed."""

import json
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import carrier as V
from lumenframe.functions import geometry as G
from lumenframe.functions import matrices as M
from lumenframe.operators import assemble as AS
from lumenframe.operators import image, nested, props, walk
from lumenframe.plans import registry, structures  # noqa: F401
from lumenframe.plans.bindings import dims
from lumenframe.sources import load, sink
from lumenframe.streaming import records as R

TREE = "owner long, path string, idx int, type string, value string"


def headers(spark, rows, extra="a long, b long, c string"):
    """(arrival, group, z, a, b, c) as chunk headers."""
    d = spark.createDataFrame(rows, f"arrival long, sequenceNumber long, z double, {extra}")
    return d.select(
        "arrival", "sequenceNumber", dims(2, 2, 1, 1).alias("dims"), G.struct(G.vector(0, 0, F.col("z"))).alias("indexOrigin"), G.struct(G.vector(3, 0, 0)).alias("rowVec"), G.struct(G.vector(0, 1, 0)).alias("columnVec"),
        G.struct(G.vector(1, 1, 0)).alias("voxelSize"), F.lit(0).cast("long").alias("acquisitionNumber"), "a", "b", "c",
    )


NEEDED = ("indexOrigin", "voxelSize", "rowVec", "columnVec")


def test_first_chunk_decides_the_sorting(spark):
    rows = [
        (0, 1, 0.0, 5, 1, "x"), (1, 1, 0.0, 4, 1, "x"),  # by a
        (2, 1, 1.0, None, 7, "x"), (3, 1, 2.0, None, 6, "x"),  # lack a: an image of their own, by b
        (4, 2, 0.0, None, 2, "x"), (5, 2, 0.0, 1, 1, "x"),  # the first has no a, so b decides for both
        (6, 3, 0.0, None, None, "q"), (7, 3, 0.0, None, None, "p"),
        (8, 4, 0.0, None, None, None), (9, 1, 0.0, 5, 9, "x"),  # the same place and a: the next image
    ]
    r = AS.assemble(headers(spark, rows), secondary=("a", "b", "c"), needed=NEEDED)
    got = {x.arrival: (x.image_id, x.lookup) for x in r.chunks.collect()}
    assert got == {0: (0, 1), 1: (0, 0), 2: (2, 0), 3: (2, 1), 4: (4, 1), 5: (4, 0), 6: (6, 1), 7: (6, 0), 9: (9, 0)}
    assert [(x.arrival, x.reason) for x in r.rejected.collect()] == [(8, "no property to sort by")]


def test_headers_are_dealt_finer_than_the_session_says(spark):
    c = AS.assemble(headers(spark, [(i, i, 0.0, i, 1, "x") for i in range(200)], "a long, b long, c string"), secondary="a", needed=NEEDED).chunks
    assert c.count() == 200 and c.rdd.getNumPartitions() == AS.FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_reindex_carries_properties_and_geometry(spark):
    rows = [(i, 1, float(i * 3), i, 7, "same" if i < 4 else None) for i in range(5)] + [(10, 2, 0.0, 1, 1, "only")]
    chunks = headers(spark, rows).withColumn("props", F.create_map(F.lit("k"), F.lit("v"), F.lit("n"), F.col("arrival").cast("string")))
    r = AS.assemble(chunks, common=("a", "b", "c", "props"), geometry=True)
    one, two = sorted(r.images.collect(), key=lambda x: x.image_id)
    assert tuple(one.dims) == (2, 2, 5, 1) and (one.a, one.b, one.c, one.props) == (None, 7, None, {"k": "v"})
    assert tuple(one.rowVec) == (1, 0, 0) and tuple(one.voxelSize) == (1, 1, 1) and tuple(one.sliceVec) == (0, 0, 1) and tuple(one.voxelGap) == (0, 0, 2) and tuple(one.fov) == (2, 2, 13)
    assert two.props == {"k": "v", "n": "10"} and two.c == "only" and tuple(two.sliceVec) == (0, 0, 1)
    left = {x.arrival: x for x in r.chunks.collect()}
    assert left[2].b is None and left[2].a == 2 and left[2].c == "same" and left[2].props == {"n": "2"} and left[10].props == {}


def test_reindex_moves_headers_once(spark):
    rows = [(i, i % 3, float(i), i, 7, "x") for i in range(30)]
    r = AS.assemble(headers(spark, rows), common=("b", "c"), geometry=True)
    for d in (r.images, r.chunks):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_dimension_to_lay_chunks_along(spark):
    rows = [(i, 1, float(i), 0, 0, "") for i in range(6)]
    flat = headers(spark, rows).withColumn("dims", dims(1, 1, 1, 1))
    shape = lambda n: tuple(AS.assemble(flat, min_dim=n).images.first().dims)
    assert shape(2) == (1, 1, 6, 1) and shape(3) == (1, 1, 1, 6)


def test_lists_of_splices(spark):
    leaves = [(1, "One", 0, "string", "v"), *[(1, "Times", i, "s32bit", str(i)) for i in range(6)], *[(1, "Odd", i, "s32bit", str(i)) for i in range(4)], (2, "Times", 0, "s32bit", "9")]
    tree = props.with_key(spark.createDataFrame(leaves, TREE)).select(*props.COLUMNS)
    kept, dropped = image.splice_properties(tree, spark.createDataFrame([(1, 3), (2, 2), (3, 2)], "owner long, parts int"))
    got = sorted((r.owner, r.part, r.path, r.idx, r.value) for r in kept.collect())
    assert got == sorted([(1, p, "One", 0, "v") for p in range(3)] + [(1, p, "Times", i, str(2 * p + i)) for p in range(3) for i in range(2)] + [(2, p, "Times", 0, "9") for p in range(2)])
    assert [(r.owner, r.path, r.length, r.parts) for r in dropped.collect()] == [(1, "Odd", 4, 3)]


def test_swap_needs_a_partner(spark):
    c = spark.createDataFrame([(1, k, k * 10, [float(k)]) for k in range(5)], "image_id long, lookup long, number int, voxels array<double>").withColumn("dims", dims(1, 1, 1, 1))
    images = spark.createDataFrame([(1,)], "image_id long").withColumn("dims", dims(1, 1, 2, 3))
    got = {r.lookup: (r.number, r.voxels[0]) for r in image.swapped_properties(c, images, "t").collect()}
    assert got == {0: (40, 0.0), 1: (10, 1.0), 2: (20, 2.0), 3: (30, 3.0), 4: (0, 4.0)}  # the partner of chunk 1 isn't there


@pytest.mark.parametrize("axis", ["r", "s", "t"])
def test_swap_queries_on_an_image_that_lacks_chunks(spark, tmp_path, axis):
    import duckdb

    e = spark.range(0, 33).select(F.col("id").alias("vec_id"), F.array(*[F.col("id").cast("float") + k for k in range(64)]).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    e.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    name = f"swap_properties_{axis}"
    want = duckdb.execute(registry.oracle_sql()[name].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).select("image_id", "lookup", "number", "label", "first").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and 20 <= len(want) < 33


def test_conversion_leaves_chunks_of_the_type(spark):
    rows = [(1, 0, "u8bit", [1.0, 250.0]), (1, 1, "float", [-1.0, 2.0]), (2, 0, "u8bit", [3.0, 4.0]), (3, 0, "float", [float("nan")]), (3, 1, "u8bit", [7.0])]
    c = spark.createDataFrame(rows, "image_id long, lookup long, type_id string, voxels array<double>")
    plan = {r.image_id: r for r in image.conversion(c, "u8bit").collect()}
    assert (plan[2].scale, plan[2].offset, plan[2].source) == (1.0, 0.0, None) and plan[1].source == "float" and (plan[1].low, plan[1].high) == (-1.0, 250.0)
    got = {(r.image_id, r.lookup): r.voxels for r in image.converted(c, "u8bit").collect()}
    assert got[1, 0] == [1, 250] and got[2, 0] == [3, 4] and got[3, 1] == [7] and got[1, 1] == [0, 3]
    major = {r.image_id: (r.target, r.error) for r in image.conversion(c).collect()}
    assert major[1] == ("float", None) and major[2] == ("u8bit", None) and major[3][0] == "u8bit"
    none = spark.createDataFrame([(1, 0, "s8bit", [-5.0]), (1, 1, "u32bit", [4e9])], c.schema)
    assert image.conversion(none).first().error == "no type of s8bit, u32bit holds both ends"
    assert image.converted(none, None).count() == 2


def test_typed_voxels_keep_their_digits(spark):
    big = (1 << 63) - 1
    d = spark.createDataFrame([([big, -big, 300, 0],)], "v array<bigint>").select(V.hold(F.col("v"), "s64bit").alias("x"))
    own = lambda t: V.values(V.converted(F.col("x"), "s64bit", t), t)
    r = d.select(own("u64bit").alias("u"), own("u8bit").alias("b"), own("complex_double").alias("c"), own("color24").alias("k"), own("double").alias("d"), V.value_range(F.col("x")).alias("r"), V.size(F.col("x")).alias("n")).first()
    assert [None if x is None else int(x) for x in r.u] == [big, None, 300, 0] and r.b == [None, None, None, 0] and r.n == 4
    assert (r.c[2].re, r.c[2].im) == (300.0, 0.0) and tuple(r.k[3]) == (0, 0, 0) and r.k[0].r is None and r.d[0] == float(big)
    assert int(r.r.low) == -big and int(r.r.high) == big
    color = spark.createDataFrame([([(1, 2, 3), (4, 5, 6)],)], "v array<struct<r:int,g:int,b:int>>").select(V.hold(F.col("v"), "color24").alias("x"), dims(2, 1, 1, 1).alias("dims"))
    r = color.select(V.text_of(V.flip(F.col("x"), F.col("dims"), "c"), "color24").alias("t"), F.size(V.splice(F.col("x"), F.lit(1))).alias("n"), V.text_of(V.gathered(F.array("x", "x")), "color24").alias("g")).first()
    assert r.t == "2#{4,5,6}|{1,2,3}" and r.n == 2 and r.g == "4#{1,2,3}|{4,5,6}|{1,2,3}|{4,5,6}"
    scaled = color.select(V.text_of(V.converted(F.col("x"), "color24", "color48", F.lit(10.0), F.lit(1.0)), "color48").alias("t")).first().t
    assert scaled == "2#{11,21,31}|{41,51,61}"
    with pytest.raises(ValueError):
        V.converted(F.col("x"), "color24", "u8bit")
    with pytest.raises(ValueError):
        V.field_of("string")


def test_nested_documents(spark):
    deep = "1"
    for _ in range(150):
        deep = '{"d":%s}' % deep
    docs = [
        (1, '{"a":{"B":[1,2],"b.c":2.5,"t":true,"n":null,"e":{},"l":[]},"A":{"x":"}{]["}}'), (2, "not json"), (3, None), (4, "[1,2]"), (5, "{}"), (6, '{"deep":%s}' % deep),
        (7, '{"Slices":{"p":[1,"q",[1,2]],"one":[5]},"m":[[1,2],[3.5,4]],"o":[{"k":1},[7],{"k":{"z":9}}],"big":3000000000}'), (8, '{"s":["x","y"],"f":[1,2.5],"esc":"a\\\\"}'),
    ]
    tree, refused = nested.from_nested_json(spark.createDataFrame(docs, "id long, text string"), "id", "text", separator=".")
    assert sorted(r.owner for r in refused.collect()) == [2, 4]
    got = {}
    for r in tree.collect():
        got.setdefault(r.owner, []).append((r.path, r.idx, r.type, r.value))
    assert sorted(got[1]) == sorted([("a/B", 0, "list_int", "[1,2]"), ("a/b/c", 0, "double", "2.5"), ("a/t", 0, "boolean", "true"), ("a/n", 0, "string", None), ("A/x", 0, "string", "}{][")])
    assert got[6] == [("deep" + "/d" * 150, 0, "s32bit", "1")] and 5 not in got
    assert sorted(got[7], key=repr) == sorted([
        ("Slices/p", 0, "s32bit", "1"), ("Slices/p", 1, "string", "q"), ("Slices/p", 2, "list_int", "[1,2]"), ("Slices/one", 0, "s32bit", "5"), ("m", 0, "list_int", "[1,2]"), ("m", 1, "list_double", "[3.5,4]"),
        ("o[0]/k", 0, "s32bit", "1"), ("o[1]", 0, "list_int", "[7]"), ("o[2]/k/z", 0, "s32bit", "9"), ("big", 0, "s64bit", "3000000000"),
    ], key=repr)
    assert sorted(got[8]) == [("esc", 0, "string", "a\\"), ("f", 0, "list_double", "[1,2.5]"), ("s", 0, "list_string", '["x","y"]')]
    both, _ = nested.from_nested_json(spark.createDataFrame([(1, '{"k.x":1,"K":{"X":2}}')], "id long, text string"), "id", "text", separator=".")
    assert [(r.path, r.value) for r in both.collect()] == [("K/X", "2")]
    empty, _ = nested.from_nested_json(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert empty.count() == 0 and empty.columns == list(props.COLUMNS)


def test_nested_documents_stay_in_their_rows(spark):
    wide = '{"list":[%s],"A.b":1,"a":{"B":2,"c":3},"a.C":4}' % ",".join('{"k":%d}' % i for i in range(300))
    tree, _ = nested.from_nested_json(spark.createDataFrame([(1, wide), (2, '{"a.C":5}')], "id long, text string"), "id", "text", separator=".")
    got = sorted((r.owner, r.path, r.value) for r in tree.collect())
    assert got == sorted([(1, f"list[{i}]/k", str(i)) for i in range(300)] + [(1, "A/b", "1"), (1, "a/C", "4"), (2, "a/C", "5")])
    assert "Exchange" not in tree._jdf.queryExecution().executedPlan().toString()  # leaves aren't shuffled


def test_nested_documents_keep_texts_and_numbers(spark):
    docs = [
        (1, '{"A":[],"a":1}'),  # an empty list is no leaf, so it hides none
        (2, '{"zero":[-0.0,1],"z":-0.0,"ze":-0e0,"big":1e400,"long":9223372036854775808,"s":-2147483649,"small":0.0001,"huge":12345678901234567890123456789012345678901}'),
        (3, '{"l":[2.50,1e2,null],"n":[1,null],"none":[null],"b":[true,null],"far":[9223372036854775808],"t":["\\u001f/\\"é",null],"o":[[{"z":1,"b":2.50}],3]}'),
        (4, '{"":{"x":1},"half\\ud800":"\\udc00"} beyond'), (5, '{"q":%s1%s}' % ("[" * 900, "]" * 900)), (6, '{"x":{"A":1,"b":2},"X":{"a":3}}'), (7, '{"a":1,"a":2}'), (8, '{"a":NaN}'),
    ]
    rows = spark.createDataFrame(docs, "id long, text string")
    broken = spark.range(9, 10).select("id", F.concat(F.encode(F.lit('{"k":"'), "utf-8"), F.unhex(F.lit("80ff")), F.encode(F.lit('"}'), "utf-8")).cast("string").alias("text"))
    tree, refused = nested.from_nested_json(rows.union(broken), "id", "text", separator=".")
    assert sorted(r.owner for r in refused.collect()) == [7, 8]
    got = {}
    for r in tree.collect():
        got.setdefault(r.owner, []).append((r.path, r.idx, r.type, r.value))
    assert got[1] == [("a", 0, "s32bit", "1")]
    assert sorted(got[2]) == sorted([
        ("zero", 0, "list_double", "[0,1]"), ("z", 0, "double", "0.0"), ("ze", 0, "double", "-0.0"), ("big", 0, "double", "Infinity"), ("long", 0, "double", "9.223372036854776E18"), ("s", 0, "s64bit", "-2147483649"),
        ("small", 0, "double", "1.0E-4"), ("huge", 0, "double", "1.2345678901234568E40"),
    ])
    assert sorted(got[3], key=repr) == sorted([
        ("l", 0, "list_double", "[2.5,100.0,null]"), ("n", 0, "list_int", "[1,null]"), ("none", 0, "list_int", "[null]"), ("b", 0, "boolean", "true"), ("b", 1, "string", None), ("far", 0, "list_double", "[9223372036854775808]"),
        ("t", 0, "list_string", '["\\u001F/\\"é",null]'), ("o", 0, "string", '[{"b":2.5,"z":1}]'), ("o", 1, "s32bit", "3"),
    ], key=repr)
    assert sorted(got[4]) == [("half?", 0, "string", "?"), ("x", 0, "s32bit", "1")]
    assert got[5] == [("q", 0, "string", "[" * 899 + "1" + "]" * 899)]
    assert sorted(got[6]) == [("X/a", 0, "s32bit", "3"), ("x/b", 0, "s32bit", "2")]
    assert got[9] == [("k", 0, "string", "\ufffd\ufffd")]


def test_nested_documents_are_read_once_in_batches(spark):
    many = spark.range(0, 3000, 1, 2).select("id", F.format_string('{"a":%d,"wide":[%s]}', "id", F.array_join(F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 7, 40000).otherwise(20)), lambda i: F.format_string('{"k":%d}', i)), ",")).alias("text"))
    tree, _ = nested.from_nested_json(many, "id", "text")
    n = tree.groupBy("owner").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.sum(F.col("value").cast("long")).alias("sum"))
    assert n.filter("n != if(owner = 7, 40001, 21) or paths != n or sum != owner + if(owner = 7, 800020000, 210)").count() == 0 and n.count() == 3000
    plan = tree._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"wide":') == 1 and "aggregate(" not in plan  # texts are made once, and not walked by an expression


def test_files_are_written_in_batches(spark, tmp_path):
    rows = [(f"f{i % 5}.nii" if i < 15 else f"g{i}.png", -i) for i in range(40)]
    d = spark.createDataFrame(rows, "file_name string, lookup int").select(
        "file_name", "lookup", F.lit("u8bit").alias("type_id"), dims(2, 2, 1, 1).alias("dims"), F.lit(None).cast("int").alias("sequenceNumber"), F.lit(1).cast("long").alias("acquisitionNumber"), F.lit(None).cast("double").alias("acquisitionTime"),
        *[G.struct(G.vector(*v)).alias(n) for n, v in (("indexOrigin", (0, 0, 0)), ("rowVec", (1, 0, 0)), ("columnVec", (0, 1, 0)), ("sliceVec", (0, 0, 1)), ("voxelSize", (1, 1, 1)), ("voxelGap", (0, 0, 0)))],
        F.lit(None).cast("double").alias("repetitionTime"), F.create_map().cast("map<string,string>").alias("props"), F.array_repeat(-F.col("lookup").cast("double"), 4).alias("voxels"),
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # files cross batches
    try:
        done = load.write(d, str(tmp_path))
        assert "FlatMapGroups" not in done._jdf.queryExecution().executedPlan().toString()  # no table of its own for each file
        got = {r.file_name: (r.bytes, r.error, r.format, r.refused) for r in done.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 30 and all(n > 0 and e is None and f == ("nifti" if k[0] == "f" else "png") and r is None for k, (n, e, f, r) in got.items())
    for k in range(5):  # in the order of lookup: 10 + k, 5 + k, k
        voxels = [v for x in load.decode_file(f"f{k}.nii", (tmp_path / f"f{k}.nii").read_bytes())[0] for v in x.voxels]
        assert voxels == [10 + k] * 4 + [5 + k] * 4 + [k] * 4


def test_matrices(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(3, 5)), rng.normal(size=(5, 2))
    s = rng.normal(size=(6, 6))
    s[0, 0] = 0.0  # the first pivot must come from below
    d = spark.createDataFrame([(a.tolist(), b.tolist(), s.tolist())], "a array<array<double>>, b array<array<double>>, s array<array<double>>")
    r = d.select(M.multiply(F.col("a"), F.col("b")).alias("p"), M.multiply(F.col("b"), F.col("a")).alias("none"), M.transposed(F.col("a")).alias("t"), M.inverse(F.col("s")).alias("i"), M.inverse(F.col("a")).alias("wide"), M.chain(F.col("s"), M.identity(6), M.inverse(F.col("s"))).alias("one")).first()
    assert np.allclose(r.p, a @ b) and r.none is None and np.allclose(r.t, a.T) and np.allclose(r.i, np.linalg.inv(s)) and r.wide is None and np.allclose(r.one, np.eye(6))
    flat = spark.range(1).select(M.inverse(M.literal([[1, 2], [2, 4]])).alias("s"), M.map_point(M.affine(M.literal([[0, 1], [1, 0]]), F.array(F.lit(1.0), F.lit(2.0))), F.array(F.lit(5.0), F.lit(7.0))).alias("p"), M.element(M.identity(3), 1, 1).alias("e")).first()
    assert flat.s is None and flat.p == [8.0, 7.0] and flat.e == 1.0


def test_predicates(spark):
    leaves = [(1, "A/x", 0, "s32bit", "5"), (1, "A/y", 0, "string", None), (1, "l", 0, "s32bit", "1"), (1, "l", 1, "s32bit", "2"), (2, "a/X", 0, "s32bit", "50")]
    tree = props.with_key(spark.createDataFrame(leaves, TREE)).select(*props.COLUMNS)
    holds = lambda p, every=None: {r.owner: r.holds for r in walk.owners(tree, p, every).collect()}
    big = (walk.path("A/X") & walk.number(lambda x: x > 10)).some()
    assert holds(big) == {1: False, 2: True} and holds(~big | walk.is_list().some()) == {1: True, 2: False}
    assert holds(walk.under("a").all()) == {1: False, 2: True} and holds(walk.anything().count(lambda n: n == 4)) == {1: True, 2: False}
    everyone = spark.createDataFrame([(1,), (2,), (3,)], "owner long")
    assert holds(walk.empty().some(), everyone) == {1: True, 2: False, 3: False} and holds(walk.under("a").all(), everyone)[3]
    assert sorted((r.path, r.idx) for r in walk.leaves(tree, walk.is_list() | walk.empty()).collect()) == [("A/y", 0), ("l", 0), ("l", 1)]
    assert [r.value for r in walk.leaves(tree, walk.like("^a/") & ~walk.of_type("string") & ~walk.equals("5")).collect()] == ["50"]


def slices(spark, n=6, kind="u8bit"):
    c = spark.createDataFrame([(f"f{k % 2}.nii", k, [float(k)] * 4) for k in range(n)], "file_name string, lookup int, voxels array<double>")
    return c.select("*", F.lit(kind).alias("type_id"), dims(2, 2, 1, 1).alias("dims"), F.lit(0).alias("sequenceNumber"), F.col("lookup").cast("long").alias("acquisitionNumber"), G.struct(G.vector(0, 0, F.col("lookup").cast("double"))).alias("indexOrigin"))


def test_writer_replaces_and_reads_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    for _ in range(2):
        sink.write_chunks(slices(spark), folder)
    assert sorted(os.listdir(folder)) == ["f0.nii", "f1.nii"]
    got = spark.read.format("chunks").load(f"file://{folder}").collect()
    assert sorted(sum(r.voxels) for r in got) == [24.0, 36.0]
    sink.write_chunks(slices(spark, 1), folder, mode="overwrite")
    assert os.listdir(folder) == ["f0.nii"]


def test_writer_leaves_nothing_of_a_failed_job(spark, tmp_path):
    folder = str(tmp_path / "out")
    sink.write_chunks(slices(spark), folder)
    before = {n: os.path.getmtime(f"{folder}/{n}") for n in os.listdir(folder)}
    broken = slices(spark).withColumn("lookup", F.when(F.col("lookup") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("lookup")))
    with pytest.raises(Exception, match="lost"):
        sink.write_chunks(broken, folder)
    assert {n: os.path.getmtime(f"{folder}/{n}") for n in os.listdir(folder)} == before
    with pytest.raises(Exception, match="png"):  # no format takes them
        sink.write_chunks(slices(spark, kind="double"), folder, formats="png")
    assert sorted(os.listdir(folder)) == ["f0.nii", "f1.nii"]
    sink.write_chunks(slices(spark, kind="double"), folder, formats="png", ignoreErrors="true")
    with open(f"{folder}/_failures.json") as f:
        assert sorted(json.loads(x)["file_name"] for x in f) == ["f0.nii", "f1.nii"]
    with pytest.raises(Exception, match="come together|more than one task"):
        slices(spark).repartition(1).sortWithinPartitions("lookup").write.format("chunks").mode("append").save(folder)


def test_writer_survives_a_killed_task(tmp_path):
    """In a session that tries tasks again: the worker of the first attempt ends in the middle of its files."""
    code = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {str(os.getcwd())!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from tests.test_structures import slices
        from lumenframe.sources import sink
        mark = {str(tmp_path / "died")!r}
        real = sink.encode_file
        chunks = slices(spark, 40).withColumn("file_name", F.concat(F.lit("g"), F.col("lookup").cast("string"), F.lit(".nii")))
        class Dying(sink.ChunkWriter):
            def write(self, rows):
                from lumenframe.sources import sink as s
                plain, count = s.encode_file, [0]
                def encode(*a):
                    count[0] += 1
                    if count[0] == 5 and not os.path.exists(mark):
                        open(mark, "w").close()
                        os._exit(1)
                    return plain(*a)
                s.encode_file = encode
                return super().write(rows)
        class Source(sink.ChunkSource):
            @classmethod
            def name(cls): return "dying"
            def writer(self, schema, overwrite): return Dying(dict(self.options), overwrite)
        spark.dataSource.register(Source)
        chunks.repartition("file_name").sortWithinPartitions("file_name").write.format("dying").mode("append").save({str(tmp_path / "out")!r})
        assert os.path.exists(mark)
        names = sorted(os.listdir({str(tmp_path / "out")!r}))
        assert names == sorted(f"g{{k}}.nii" for k in range(40)), names
        print("whole")
    """)
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, env=os.environ)
    assert "whole" in r.stdout, r.stderr[-3000:]


def test_encoders_in_turn():
    from lumenframe.sources.model import Chunk

    c = Chunk(np.zeros(8), (2, 2, 2, 1), "double")
    data, used, reasons = load.encode_file("x.img", [c], ("png", "nifti"))
    assert data and used == "nifti" and len(reasons) == 1 and reasons[0].startswith("png")
    assert load.encode_file("x.png", [c])[0] is None and load.encode_file("x.unknown", [c])[2] == ["no format writes this suffix"]


class Kept:
    """State in memory, with the bytes that were written to it."""

    def __init__(self):
        self.rows, self.written = None, 0

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def update(self, row):
        self.rows = row
        self.written += sum(len(x) for x in row if isinstance(x, (str, bytes)))

    def appendList(self, rows):
        self.rows = (self.rows or []) + list(rows)
        self.written += sum(len(r[0]) for r in rows)

    def clear(self):
        self.rows = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def state(self, name, *_):
        return self.states.setdefault(name, Kept())

    getValueState = getListState = state

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Now:
    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_record_over_many_batches_writes_each_byte_once():
    import pandas as pd

    h = Handle()
    p = R.Assembler(500)
    p.init(h)
    n = 1000
    head = f"<data_block_header>\nacquisition=7\nwidth=100\nheight={n}\ndata_size_in_bytes={200 * n}\n".encode()
    out = []
    for k, payload in enumerate([head, *[bytes(200)] * n]):
        out += [f for f in p.handleInputRows(("s",), iter([pd.DataFrame({"seq": [k], "payload": [payload]})]), Now()) if len(f)]
    assert len(out) == 1 and out[0]["complete"].tolist() == [True] and out[0]["dims"][0] == {"c": 100, "r": n, "s": 1, "t": 1} and len(out[0]["voxels"][0]) == 100 * n
    assert h.states["parts"].written == 200 * (n - 1)  # the last part completes the record
    assert not h.states["open"].exists() and not h.states["parts"].exists() and h.timers == []


def test_record_cut_short():
    import pandas as pd

    h = Handle()
    p = R.Assembler(500)
    p.init(h)
    send = lambda *parts: [f for f in p.handleInputRows(("s",), iter([pd.DataFrame({"seq": range(len(parts)), "payload": list(parts)})]), Now()) if len(f)]
    head = b"<data_block_header>\nacquisition=7\ncolumns=2\nrows=2\ndata_size_in_bytes=8\n"
    assert send(head, b"1234") == [] and h.timers == [1500]
    cut = send(head, b"12345678")
    assert [c for f in cut for c in f["complete"]] == [False, True] and h.timers == []
    send(head)
    late = list(p.handleExpiredTimer(("s",), Now(), None))[0]
    assert late["complete"].tolist() == [False] and late["acquisitionNumber"].tolist() == [7] and not h.states["open"].exists()
    assert send(b"no header") == []


def test_feed_geometry():
    tag = lambda k, v: f"<{k}>\n{v}\n</{k}>\n"
    f = R.header(("<data_block_header>\n" + "".join(tag(*x) for x in (("slice_orientation", "SAGITTAL"), ("inplane_rotation", "0"), ("read_vector", "0,1,0"), ("phase_vector", "0,0,1"), ("slice_norm_vector", "1,0,0"), ("fov_read", "40"), ("fov_phase", "20"), ("slice_thickness", "3"), ("slice_position_0", "5,1,1"), ("slice_position_1", "1,1,1")))).encode())
    g = R.geometry(f, 10, 10, 2)
    assert g["InPlanePhaseEncodingDirection"] == "ROW" and g["rowVec"] == (0, 1, 0) and g["columnVec"] == (0, 0, -1) and g["sliceVec"] == (1, 0, 0)
    assert g["voxelSize"] == (2, 4, 3) and g["voxelGap"] == (0, 0, 1) and g["indexOrigin"] == (1, -9, 21)
    assert R.geometry({}, 1, 1, 1)["InPlanePhaseEncodingDirection"] == "ROW"


def test_program_options(spark, tmp_path, capsys):
    from lumenframe.plans import programs
    from lumenframe.sources import nifti, raw
    from lumenframe.sources.model import Chunk

    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for s in range(3):
        c = Chunk(np.arange(4, dtype="u1") + 10 * s, (2, 2, 1, 1), "u8bit", indexOrigin=(1.0, 2.0, float(s)), acquisitionNumber=s)
        (tmp_path / "in" / f"s{s}.nii").write_bytes(nifti.encode([c]))
    where = ["--in", str(tmp_path / "in"), "--out", str(tmp_path / "out")]
    read = lambda n: nifti.decode((tmp_path / "out" / n).read_bytes())[0]
    # above the chunks' dimensions properties are exchanged, so that slices come in the other order
    assert programs.main(["flip", *where, "--along", "slice", "--name", "a.nii"], spark) == 0
    assert read("a.nii").voxels.tolist() == [20, 21, 22, 23, 10, 11, 12, 13, 0, 1, 2, 3]
    assert programs.main(["flip", *where, "--along", "row", "--flip", "space", "--name", "b.img", "--wf", "nii"], spark) == 0
    got = read("b.nii")
    assert got.voxels[0] == 0 and got.indexOrigin[0] == -1.0 and got.rowVec[0] == -1.0
    assert programs.main(["flip", *where, "--along", "x", "--flip", "both", "--center", "--name", "c.nii", "--wformats", "png", "nifti"], spark) == 0
    got = read("c.nii")
    assert got.voxels[0] == 1 and got.indexOrigin[0] == 2.0 and got.rowVec[0] == -1.0
    assert programs.main(["dump", "--in", str(tmp_path / "in")], spark) == 0
    text = capsys.readouterr().out
    assert "2x2x3x1" in text and "voxelGap" in text
    (tmp_path / "raw").mkdir()
    data = raw.encode([Chunk(np.arange(12, dtype="i2"), (3, 2, 2, 1), "s16bit")], swap=True)
    (tmp_path / "raw" / "x.raw").write_bytes(b"head" + data)
    options = ["--rawdims", "3", "2", "2", "--read-repn", "s16bit", "--offset", "4", "--byteswap", "--voxel", "1", "2", "3", "--origin", "4", "5", "6"]
    assert programs.main(["raw", "--in", str(tmp_path / "raw"), "--out", str(tmp_path / "out"), "--name", "r.nii", *options], spark) == 0
    got = read("r.nii")
    assert got.voxels.tolist() == list(range(12)) and got.voxelSize == (1, 2, 3) and got.indexOrigin == (4, 5, 6)
    assert programs.main(["dump", "--help-io"], spark) == 0 and "nifti: nii" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        programs.main(["dump"], spark)


def test_names_from_standard_input(spark, tmp_path, monkeypatch):
    import io

    from lumenframe.sources import nifti
    from lumenframe.sources.model import Chunk

    (tmp_path / "a.nii").write_bytes(nifti.encode([Chunk(np.zeros(4), (2, 2, 1, 1), "double")]))
    monkeypatch.setattr(sys, "stdin", io.StringIO(f"{tmp_path}/a.nii\n\n"))
    assert load.load_list(spark, "-").count() == 1


def test_formats_are_discovered(spark, tmp_path):
    (tmp_path / "mods").mkdir()
    (tmp_path / "in").mkdir()
    (tmp_path / "mods" / "plain_format.py").write_text(textwrap.dedent("""
        import numpy as np
        from lumenframe.sources.load import Format
        from lumenframe.sources.model import Chunk

        def decode(data, dialect, name):
            v = np.array([float(x) for x in data.split()])
            return [Chunk(v, (len(v), 1, 1, 1), "double")]

        def factory():
            return Format("plain", ("pln",), decode)
    """))
    (tmp_path / "mods" / "broken_format.py").write_text("raise RuntimeError('no')")
    (tmp_path / "mods" / "other.py").write_text("raise RuntimeError('not looked at')")
    assert load.discover(spark, str(tmp_path / "mods")) == {"broken_format.py": "RuntimeError: no"}
    (tmp_path / "in" / "a.pln").write_text("1 2 3.5")
    assert load.load(spark, str(tmp_path / "in")).first().voxels == [1.0, 2.0, 3.5]


def test_slices_get_files_of_their_own(spark, tmp_path):
    c = spark.createDataFrame([("v.png", k, [float(10 * k + i) for i in range(12)]) for k in range(4)], "file_name string, lookup long, voxels array<double>")
    c = c.select("*", F.lit("u8bit").alias("type_id"), dims(2, 2, 3, 1).alias("dims"), F.lit(0).alias("sequenceNumber"), F.lit(0).cast("long").alias("acquisitionNumber"))
    got = {r.file_name: r.voxels for r in load.sliced(c).collect()}
    assert len(got) == 12 and got["v_01.png"] == [0, 1, 2, 3] and got["v_05.png"] == [14, 15, 16, 17] and got["v_12.png"] == [38, 39, 40, 41]
    assert {r.file_name: r.voxels for r in load.sliced(c, middle=True).collect()} == {"v.png": [20, 21, 22, 23]}
    sink.write_chunks(load.sliced(c), str(tmp_path / "out"))
    assert len(os.listdir(tmp_path / "out")) == 12


def test_stream_deliveries_are_written_by_every_task(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lumenframe.plans import files

    spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id")).repartition(12).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(files, "own_folder", lambda _: str(tmp_path / "feed"))
    rows = files.stream_chunks(spark, str(tmp_path)).collect()
    assert sorted((r.source, r.acquisitionNumber, r.total) for r in rows) == sorted((str(k % 5), k, 12 * (k % 200) + 70) for k in range(600) if k % 7)
    assert len(list((tmp_path / "feed/in").glob("*.parquet"))) > 3 * 2  # three deliveries
