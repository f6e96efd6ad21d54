import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geometry as G
from lumenframe.operators import assemble, diff, filters, image, props, steps
from lumenframe.plans.bindings import dims
from lumenframe.sources import null

V = "struct<x:double,y:double,z:double>"
CHUNK = f"arrival long, c int, r int, s int, t int, x double, y double, z double, acquisitionNumber long, sequenceNumber int"


def chunks(spark, rows):
    """(columns, rows, slices, timesteps, x, y, z, acquisition[, sequence])"""
    d = spark.createDataFrame([(i, *r[:4], *map(float, r[4:7]), r[7], r[8] if len(r) > 8 else 0) for i, r in enumerate(rows)], CHUNK)
    unit = lambda *v: G.struct(G.vector(*v))
    return d.select("arrival", dims(F.col("c"), F.col("r"), F.col("s"), F.col("t")).alias("dims"), G.struct(G.vector(F.col("x"), F.col("y"), F.col("z"))).alias("indexOrigin"), unit(1, 0, 0).alias("rowVec"), unit(0, 1, 0).alias("columnVec"), unit(1, 1, 1).alias("voxelSize"), "acquisitionNumber", "sequenceNumber")


def shapes(spark, rows, **options):
    return [tuple(r.dims) for r in assemble.assemble(chunks(spark, rows), **options).images.orderBy("image_id").collect()]


def slices(columns, rows, n_s, n_t):
    return [(columns, rows, 1, 1, 0, 0, s, s + t * n_s) for t in range(n_t) for s in range(n_s)]


def stripes(columns, rows, n, n_t):
    """Rows (or columns) of one slice as chunks of their own."""
    return [(columns, rows, 1, 1, 0 if rows == 1 else k, k if rows == 1 else 0, 0, k + t * n) for t in range(n_t) for k in range(n)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        (slices(32, 12, 27, 17), (32, 12, 27, 17)),
        (slices(29, 54, 21, 1), (29, 54, 21, 1)),
        (slices(4, 4, 1, 2), (4, 4, 1, 2)),
        (slices(2, 212, 1, 2), (2, 212, 1, 2)),
        (stripes(64, 1, 64, 20), (64, 64, 1, 20)),
        ([(3, 3, 3, 1, 0, 0, 0, a) for a in range(10)], (3, 3, 3, 10)),
        ([(5, 5, 5, 5, 0, 0, 0, 0)], (5, 5, 5, 5)),
        ([(8, 1, 1, 1, 0, y, z, y + 4 * z) for z in range(3) for y in range(4)], (8, 4, 3, 1)),
    ],
)
def test_shapes(spark, rows, want):
    rnd = random.Random(0)
    rnd.shuffle(rows)
    assert shapes(spark, rows) == [want]


def test_smallest_indexed_dimension(spark):
    rows = [(4, 4, 1, 1, 0, 0, s, s) for s in range(3)]
    assert shapes(spark, rows) == [(4, 4, 3, 1)]
    assert shapes(spark, rows, min_dim=3) == [(4, 4, 1, 3)]


def test_duplicates_go_to_further_images(spark):
    rows = [(3, 3, 3, 1, 0, 0, 0, a) for c in range(5) for a in range(10)]
    a = assemble.assemble(chunks(spark, rows))
    assert [tuple(r.dims) for r in a.images.collect()] == [(3, 3, 3, 10)] * 5
    got = a.chunks.orderBy("image_id", "lookup").select("image_id", "arrival", "lookup").collect()
    assert [(r.arrival - r.image_id, r.lookup) for r in got] == [(k, k) for _ in range(5) for k in range(10)]


def test_rectangularity_and_invalid_chunks(spark):
    base = [(4, 4, 1, 1, 0, 0, s, 0) for s in range(3)]
    assert len(shapes(spark, base)) == 1
    a = assemble.assemble(chunks(spark, [*base, (4, 4, 1, 1, 0, 0, 0, 1), (0, 4, 1, 1, 0, 0, 0, 9)]))
    assert a.images.count() == 0 and sorted((r.arrival, r.reason) for r in a.rejected.collect()) == [(0, "not rectangular"), (1, "not rectangular"), (2, "not rectangular"), (3, "not rectangular"), (4, "invalid")]
    full = [(4, 4, 1, 1, 0, 0, s, t) for s in range(3) for t in range(2)]
    assert shapes(spark, full) == [(4, 4, 3, 2)]
    assert shapes(spark, []) == []


def test_generator_round_trip(spark):
    c = null.null_chunks(spark, 11, timesteps=4)
    a = assemble.assemble(c)
    assert [tuple(r.dims) for r in a.images.collect()] == [(11, 11, 11, 4)] * 2
    assert null.differences(a.chunks, 11, timesteps=4).count() == 0
    assert null.differences(a.chunks.filter("lookup > 0"), 11, timesteps=4).count() == 2


def test_geometry_repair(spark):
    unit = lambda *v: G.struct(G.vector(*v))
    d = spark.range(1).select(
        F.lit(0).alias("image_id"), dims(4, 4, 3, 1).alias("dims"), unit(0, 0, 0).alias("rowVec"), unit(0, 2, 0).alias("columnVec"), F.lit(None).cast(V).alias("sliceVec"),
        unit(0, float("inf"), 1).alias("voxelSize"), F.lit(None).cast(V).alias("voxelGap"), unit(0, 0, 0).alias("first_origin"), unit(0, 0, 4).alias("last_origin"),
    )
    r = assemble.repaired_geometry(d).first()
    assert tuple(r.rowVec) == (1, 0, 0) and tuple(r.columnVec) == (0, 1, 0) and tuple(r.sliceVec) == (0, 0, 1) and tuple(r.voxelSize) == (1, 1, 1)
    assert tuple(r.voxelGap) == (0, 0, 1) and tuple(r.fov) == (4, 4, 5)


def tree(spark, rows):
    return props.with_key(spark.createDataFrame([(0, p, t, v) for p, t, v in rows], "owner int, path string, type string, value string")).select(*props.COLUMNS)


def test_property_trees(spark):
    a = tree(spark, [("Test1", "s32bit", "1"), ("sub/Test2", "string", "x"), ("Test4", "double", "4"), ("Test5", "string", None), ("sub/deep/Name", "string", "n")])
    b = tree(spark, [("test1", "s32bit", "1"), ("SUB/test2", "string", "x"), ("Test4", "double", "5"), ("Test5", "string", "five"), ("other", "u8bit", "9")])
    d = {r.path: (r.left, r.right) for r in props.difference(a, b).collect()}
    assert d == {"Test4": ("4", "5"), "Test5": (None, "five"), "other": (None, "9"), "sub/deep/Name": ("n", None)}
    j = {r.path.lower(): r.value for r in props.join(a, b).collect()}
    assert j["test4"] == "4" and j["test5"] == "five" and j["other"] == "9"
    assert {r.path.lower(): r.value for r in props.join(a, b, overwrite=True).collect()}["test4"] == "5"
    assert [r.path for r in props.rejected(a, b).collect()] == ["Test4"]
    assert props.difference(a, a).count() == 0 and props.equal(a, a).first().equal
    assert sorted(r.path for r in props.remove_equal(a, b).collect()) == ["Test4", "Test5", "sub/deep/Name"]
    assert [tuple(r)[1:] for r in props.find(a, "name").collect()] == [("sub/deep/Name", "string", "n")]
    assert sorted(r.path for r in props.rename(a, "sub", "moved").collect()) == ["Test1", "Test4", "Test5", "moved/Test2", "moved/deep/Name"]
    assert {r.path: (r.type, r.value) for r in props.transform(a, "test4", "s8bit").collect()}["Test4"] == ("s8bit", "4")
    assert sorted(r.path for r in props.branch(a, "sub").collect()) == ["Test2", "deep/Name"]
    assert [r.path for r in props.missing(a, a, ("test1", "Test5", "gone")).orderBy("path").collect()] == ["Test5", "gone"]
    assert props.insert_branch(a, b, "in").count() == 10 and props.lists(a).count() == 0


def test_common_and_unique(spark):
    rows = [(0, "A", "s32bit", "1"), (1, "a", "s32bit", "1"), (0, "B", "s32bit", "1"), (1, "B", "s32bit", "2"), (0, "C", "string", "x")]
    p = props.with_key(spark.createDataFrame(rows, "owner int, path string, type string, value string")).withColumn("g", F.lit(0))
    assert [r.path_lc for r in props.common(p, "g").collect()] == ["a"]
    assert sorted(r.path for r in props.unique(p, "g").collect()) == ["B", "B", "C"]


def test_splice_and_assemble_is_the_identity(spark):
    unit = lambda *v: G.struct(G.vector(*v))
    c = spark.range(1).select(
        F.lit(0).cast("long").alias("arrival"), dims(10, 10, 10, 10).alias("dims"), F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: i.cast("double")).alias("voxels"), F.lit(1).cast("long").alias("acquisitionNumber"), F.lit(0).alias("sequenceNumber"),
        unit(0, 0, 0).alias("indexOrigin"), unit(1, 0, 0).alias("rowVec"), unit(0, 1, 0).alias("columnVec"), unit(1, 1, 1).alias("voxelSize"),
    )
    parts = image.splice_down_to(c, 2).withColumn("arrival", F.element_at("voxels", 1).cast("long"))
    assert parts.count() == 100
    z = [r.z for r in parts.orderBy("arrival").select("indexOrigin.z").collect()]
    assert z == [k % 10 for k in range(100)]
    a = assemble.assemble(parts.withColumn("acquisitionNumber", F.col("arrival")))
    assert tuple(a.images.first().dims) == (10, 10, 10, 10)
    assert image.gathered(a.chunks).first().voxels == [float(i) for i in range(10_000)]


def test_filters():
    k = filters.gauss_kernel(1.0)
    assert len(k) == 9 and abs(sum(k) - 1) < 1e-12 and k[4] == max(k)
    assert abs(filters.fwhm_to_sigma(filters.sigma_to_fwhm(3.0)) - 3.0) < 1e-12
    t = np.arange(200)
    slow, fast = np.sin(2 * np.pi * t / 100), np.sin(2 * np.pi * t / 4)
    got = filters.filter_series(slow + fast, 1.0, None, 0.1)
    assert np.abs(got - slow)[20:-20].max() < 0.1
    stop = filters.filter_series(slow + fast, 1.0, None, 0.1, stop=True)
    assert np.abs(stop - fast)[20:-20].max() < 0.1


def test_convolution(spark):
    v = [float(x) for x in range(12)]
    d = spark.createDataFrame([(v,)], "voxels array<double>").withColumn("dims", dims(4, 3, 1, 1))
    got = d.select(filters.convolve(F.col("voxels"), F.col("dims"), [0.25, 0.5, 0.25], "c").alias("c"), filters.convolve(F.col("voxels"), F.col("dims"), [0.25, 0.5, 0.25], "r").alias("r"), filters.convolve(F.col("voxels"), F.col("dims"), [0.5, 0.5, 0.0], "c", sequential=True).alias("s")).first()
    a = np.array(v).reshape(3, 4)
    assert np.allclose(np.array(got.c).reshape(3, 4), [np.convolve(row, [0.25, 0.5, 0.25], "same") for row in a])
    assert np.allclose(np.array(got.r).reshape(3, 4).T, [np.convolve(col, [0.25, 0.5, 0.25], "same") for col in a.T])
    want = a.copy()
    for row in want:
        for i in range(4):
            row[i] = 0.5 * (row[i - 1] if i else 0) + 0.5 * row[i]
    assert np.allclose(np.array(got.s).reshape(3, 4), want)


def test_data_set_difference(spark):
    left = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, None, "b")], "image_id int, sequenceNumber int, kind string")
    right = spark.createDataFrame([(10, 1, "a"), (11, None, "b"), (12, 3, "c")], "image_id int, sequenceNumber int, kind string")
    m = diff.match(left, right, ["sequenceNumber", "kind"])
    assert sorted(map(tuple, m.collect())) == [(0, 10), (2, 11)]
    assert sorted(map(tuple, diff.unmatched(left, right, m).collect())) == [("left", 1), ("right", 12)]
    assert diff.nth(left, 1).first().image_id == 1


def test_removed_keys_take_their_branches(spark):
    a = tree(spark, [("Test1", "s32bit", "1"), ("sub/Test2", "string", "x"), ("sub/deep/Name", "string", "n"), ("subway", "string", "s"), ("other/sub", "string", "o")])
    gone = lambda keys, needed=(): sorted(r.path for r in props.remove_keys(a, spark.createDataFrame([(k,) for k in keys], "path string"), needed).collect())
    assert gone(["SUB"]) == ["Test1", "other/sub", "subway"]
    assert gone(["sub/deep", "test1", None]) == ["other/sub", "sub/Test2", "subway"]
    assert gone(["sub", "test1"], ("Test1", "sub/deep/name")) == ["Test1", "other/sub", "sub/deep/Name", "subway"]
    assert len(gone([])) == 5


def test_required_leaves(spark):
    a = tree(spark, [("Test1", "s32bit", "1"), ("Test5", "string", None)])
    out, gaps = props.require(a, a, {"test1": "moved", "gone": "elsewhere"})
    assert sorted(r.path for r in out.collect()) == ["Test5", "moved"] and [r.path for r in gaps.collect()] == ["gone"]


def test_steps(spark):
    d, other = spark.range(6), spark.range(3)
    seen = []
    step = steps.Step(
        "among", lambda df, p, i: (df.filter(F.col("id") >= p["least"]).join(i["mask"], "id"), {"least": p["least"]}),
        {"least": steps.REQUIRED, "unused": 1}, ("mask",), lambda p, _: "least is negative" if p["least"] < 0 else None,
    )
    out, results = step.run(d, {"least": 1}, {"mask": other}, lambda *x: seen.append(x))
    assert sorted(r.id for r in out.collect()) == [1, 2] and results == {"least": 1} and seen == [("among", "started"), ("among", "finished")]
    assert d.transform(step.transform({"mask": other}, least=2)).count() == 1
    for given, inputs, word in (({}, {"mask": other}, "without"), ({"least": 1}, {}, "not given"), ({"least": 1, "x": 2}, {"mask": other}, "unknown"), ({"least": -1}, {"mask": other}, "negative")):
        with pytest.raises(steps.StepError, match=word):
            step.run(d, given, inputs)
