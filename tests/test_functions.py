import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays as A
from lumenframe.functions import convert as C
from lumenframe.functions import expr as E
from lumenframe.functions import geometry as G
from lumenframe.functions import names as N
from lumenframe.functions import scaling as S
from lumenframe.functions import text as T
from lumenframe.functions import types


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_type_registry():
    assert [t.id for t in types.TYPES] == list(range(1, 28))
    assert types.of("u16bit").high == 65535 and types.of(4).name == "s16bit" and types.array_id("u8bit") == 3 << 8


def test_golden_scalings(spark):
    s = lambda lo, hi, a, b, m="autoscale": S.scaling(F.lit(float(lo)), F.lit(float(hi)), a, b, m)
    r = one(spark, a=s(-50, 2500, "s16bit", "u8bit"), b=s(-2, 2, "float", "s32bit"), c=s(-2, 2, "float", "u8bit"), d=s(0, 510, "u16bit", "u8bit"), e=s(5, 255, "u16bit", "u8bit"), f=s(0, 9, "float", "double"), g=s(1, 9, "u8bit", "u8bit"))
    assert (round(r.a.scale, 12), round(r.a.offset, 12)) == (0.1, 5.0)
    assert (r.b.scale, r.b.offset) == ((2**31 - 1) / 2, 0.0) and r.c.scale == 255 / 4 and r.c.offset == 2 * r.c.scale
    assert (r.d.scale, r.d.offset) == (0.5, 0.0) and (r.e.scale, r.e.offset) == (1.0, -5.0)
    assert (r.f.scale, r.f.offset) == (1.0, 0.0) == (r.g.scale, r.g.offset)


def test_ranges_skip_what_is_not_finite(spark):
    v = F.array(*[F.lit(x) for x in (-1.8, float("inf"), float("nan"), 1.8, float("-inf"))])
    r = one(spark, a=S.array_range(v), b=S.array_range(F.array(F.lit(float("nan")))))
    assert (r.a.low, r.a.high) == (-1.8, 1.8) and r.b is None


def test_both_roundings(spark):
    v = F.array(*[F.lit(x) for x in (2.5, 3.5, -2.5, -0.5, 0.49)])
    r = one(spark, a=S.convert_array(v, "s16bit"), b=F.transform(v, lambda x: C.to_number(x, "s16bit")))
    assert r.a == [3, 4, -3, -1, 0] and r.b == [2, 4, -2, 0, 0]


def test_conversion_flags_and_comparison(spark):
    n = lambda x, t: C.convert_number(F.lit(x), t)
    r = one(spark, a=n(1000.0, "u8bit"), b=n(-1.0, "u8bit"), c=n(200.4, "u8bit"), d=n(float("nan"), "s32bit"), e=n(2.0**63, "s64bit"), f=n(1e39, "float"))
    assert (r.a.flag, r.a.value) == ("pos_overflow", 255) and (r.b.flag, r.b.value) == ("neg_overflow", 0) and (r.c.flag, r.c.value) == ("in_range", 200)
    assert r.d.flag == r.e.flag == r.f.flag == "pos_overflow"
    c = lambda first, t, second, how: C.compare(F.lit(first), t, F.lit(second), how)
    r = one(spark, a=c(200, "u8bit", 1000.0, "lt"), b=c(200, "u8bit", -1.0, "gt"), d=c(200, "u8bit", 200.4, "eq"), e=c(200, "u8bit", 200.6, "eq"), f=c(1000, "s16bit", 1.7e308, "lt"), g=c("x", "string", 1.0, "lt"))
    assert (r.a, r.b, r.d, r.e, r.f, r.g) == (True, True, True, False, True, False)


def test_texts(spark):
    r = one(
        spark,
        a=C.pick_numbers(F.lit("1, 2, 3 and 4.4 or maybe 4.6"), "s32bit"), b=C.pick_numbers(F.lit("1, 2, 3 and 4.4 or maybe 4.6")), c=C.string_to_vector(F.lit("<1|2|3|4|5>"), "ivector4"),
        d=C.split_strings(F.lit(" a, b;c ")), e=C.string_to_number(F.lit("nothing"), "s32bit"), f=C.string_to_number(F.lit("nothing"), "s32bit", strict=True), g=C.string_to_bool(F.lit("Yes")),
        h=C.string_to_complex(F.lit("(1.5,-2)")), i=T.age_to_days(F.lit("012M")), j=T.age_to_days(F.lit("7")), k=C.string_to_timestamp(F.lit("not a time")), l=T.string_to_list(F.lit(",a,b,"), ","),
        m=T.common_folder(F.array(F.lit("/a/b/c"), F.lit("/a/b/d/e"), F.lit("/a/b"))), n=C.text_of_vector(C.string_to_vector(F.lit("1 2 3"), "dvector3"), ["x", "y", "z"]), o=T.number_in_name(F.lit("a12b007.png")),
    )
    assert r.a == [1, 2, 3, 4, 5] and r.b == [1, 2, 3, 4.4, 4.6] and tuple(r.c) == (1, 2, 3, 4) and r.d == ["a", "b", "c"]
    assert r.e == 0 and r.f is None and r.g is True and tuple(r.h) == (1.5, -2.0) and r.i == 365 and r.j == 7 and r.k is None and r.l == ["a", "b"]
    assert r.m == "/a/b" and r.n == "<1.0|2.0|3.0>" and r.o == 7


def test_flip_is_an_involution_and_splice_keeps_everything(spark):
    rnd = random.Random(1)
    for dims in ((5, 4, 3, 2), (7, 1, 1, 1), (2, 3, 1, 4)):
        n = math.prod(dims)
        v = F.array(*[F.lit(rnd.randrange(100)) for _ in range(n)])
        d = F.struct(*[F.lit(k).alias(a) for k, a in zip(dims, "crst")])
        row = spark.range(1).select(v.alias("v"), d.alias("d"))
        for axis in "crst":
            r = row.select("v", A.flip(F.col("v"), F.col("d"), axis).alias("f"), A.flip(A.flip(F.col("v"), F.col("d"), axis), F.col("d"), axis).alias("g"), F.flatten(A.splice(F.col("v"), 4)).alias("s")).first()
            assert r.g == r.v == r.s
            k = "crst".index(axis)
            for _ in range(10):
                at = [rnd.randrange(m) for m in dims]
                other = list(at)
                other[k] = dims[k] - 1 - at[k]
                lin = lambda p: p[0] + dims[0] * (p[1] + dims[1] * (p[2] + dims[2] * p[3]))  # noqa: E731, B023
                assert r.f[lin(at)] == r.v[lin(other)]


def test_index_and_coordinates(spark):
    d = F.struct(*[F.lit(k).alias(a) for k, a in zip((4, 3, 5, 2), "crst")])
    rows = spark.range(120).select("id", A.coordinates(d, F.col("id")).alias("p")).withColumn("back", A.linear_index(d, F.col("p.x"), F.col("p.y"), F.col("p.z"), F.col("p.t")))
    assert rows.filter("id <> back").count() == 0
    r = one(spark, a=A.swap_bytes(F.lit(0x0102), 2), b=A.swap_bytes(F.lit(0x01), 4), c=A.swap_bytes(A.swap_bytes(F.lit(-123456789012345), 8), 8), d=A.pack_bits(A.unpack_bits(F.lit(0b10110001))))
    assert (r.a, r.b, r.c, r.d) == (0x0201, 0x01000000, -123456789012345, [0b10110001])


def test_geometry(spark):
    rnd = random.Random(3)
    rows = [[rnd.uniform(-2, 2) for _ in range(3)] for _ in range(3)]
    m = G.matrix(rows)
    same = G.multiply(m, G.inverse(m))
    r = one(spark, **{f"r{i}": G.struct(v) for i, v in enumerate(same)})
    assert all(abs(r[i][j] - (i == j)) < 1e-9 for i in range(3) for j in range(3))
    a = 0.7
    turn = G.matrix([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = G.matrix_to_quaternion(turn)
    back = G.quaternion_to_matrix(q["b"], q["c"], q["d"], q["qfac"])
    r = one(spark, a=G.struct(back[0]), b=G.struct(back[1]), o=G.main_orientation(G.vector(1, 0, 0), G.vector(0, -1, 0)), n=G.struct(G.normalized(G.vector(0, 0, 0), G.vector(0, 1, 0))))
    assert abs(r.a.x - math.cos(a)) < 1e-9 and abs(r.b.x - math.sin(a)) < 1e-9 and r.o == "reversed_axial" and tuple(r.n) == (0, 1, 0)


def test_published_flip_of_an_image(spark):
    """An image of 320 x 320 x 240 voxels of 0.7 whose columns are flipped about its center."""
    origin, r = G.vector(92.5167, -159.366, -108.687), G.from_columns(G.vector(1, 0, 0), G.vector(0, 1, 0), G.vector(0, 0, 1))
    new, turned = G.transform_about_center(G.matrix([[1, 0, 0], [0, -1, 0], [0, 0, 1]]), origin, r, (F.lit(320), F.lit(320), F.lit(240)), G.vector(0.7, 0.7, 0.7))
    got = one(spark, o=G.struct(new), c=turned[1]["y"])
    assert abs(got.o.y - (-159.366 + 0.7 * 319)) < 1e-6 and got.c == -1.0


@pytest.mark.parametrize(
    ("text", "want"),
    [("vox*2+pos_z", 23.0), ("2^3^2", 512.0), ("-vox^2", -100.0), ("vox > 5 && pos_x != 1 ? 1 : 2", 2.0), ("max(1, vox, pos_y)", 10.0), ("ln(_e)", 1.0), ("1/0", math.inf), ("(1 + 2) * 3 - -1", 10.0), ("avg(1,2,3)", 2.0)],
)
def test_expressions(spark, text, want):
    v = E.voxel_expression(text, F.lit(10), F.lit(1), F.lit(2), F.lit(3), F.lit(4))
    assert one(spark, v=v).v == pytest.approx(want)


@pytest.mark.parametrize("text", ["vox +", "system(1)", "vox vox", "a", "1 $ 2", "min(1"])
def test_bad_expressions(spark, text):
    with pytest.raises(E.ExpressionError):
        E.voxel_expression(text, *[F.lit(0)] * 5)


def test_file_names(spark):
    p = {"sequenceNumber": F.lit(7), "Name": F.lit("a b/c\\d"), "empty": F.lit(None).cast("string")}
    kinds = {"sequencenumber": "u16bit"}
    r = one(spark, a=N.file_name("S{%d_sequenceNumber}_{NAME}{empty}{gone}.nii", p, kinds), b=N.file_name("{sequenceNumber}{}", p, kinds))
    assert r.a == "S00007_a_b_c_d.nii" and r.b == "7{}"
    df = spark.createDataFrame([(i, "x.nii.gz") for i in range(12)] + [(20, "y.nii.gz")], "id int, name string")
    got = {r.id: r.unique_name for r in N.unique_names(df, "name", ["id"], ["nii.gz", "gz"]).collect()}
    assert got[0] == "x_01.nii.gz" and got[11] == "x_12.nii.gz" and got[20] == "y.nii.gz"
