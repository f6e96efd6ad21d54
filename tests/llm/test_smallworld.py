import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import smallworld as S

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, top=20):
    """All pairs in double precision: for each query its best rows."""
    kept = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        kept[i] = min(kept.get(i, v), v)
    out = {}
    for q in (i for i in kept if i % 20 == 0):
        scored = []
        for i, v in kept.items():
            if i != q:
                score = 0.0
                for a, b in zip(kept[q], v):
                    score += a * b
                scored.append((-score, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items() if w])


@pytest.mark.parametrize("shard_rows", [100, 700, 5000])
def test_recall(spark, shard_rows):
    r = np.random.default_rng(3)
    x = r.normal(size=(2000, 32)) * r.uniform(0.5, 2, size=(2000, 1))  # unequal lengths
    rows = [(i, [float(v) for v in row.astype(np.float32)], None) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = found(S.nearest(df, shard_rows=shard_rows)), exact([(i, v) for i, v, _ in rows])
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.95
    scores = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(scores[q, i] == s for q, g in got.items() for i, s in g if (q, i) in scores)


def test_index_is_flat_and_whole(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in r.normal(size=8)], 0) for i in range(300)], SCHEMA)
    index = S.build_index(df, shard_rows=100).collect()
    members = sorted(i for row in index for i in np.frombuffer(row["members"], "<i8").tolist())
    assert members == list(range(300)) and len(index) == 3
    for row in index:
        sizes = row["level_nodes"]
        assert sizes[0] == row["nodes"] and sizes == sorted(sizes, reverse=True)
        assert len(row["links"]) == 4 * (sizes[0] * S.BASE_LINKS + sum(sizes[1:]) * S.LINKS)
        base = np.frombuffer(row["links"], "<i4")[: sizes[0] * S.BASE_LINKS].reshape(-1, S.BASE_LINKS)
        assert base.max() < row["nodes"] and all(len(set(b[b >= 0])) == (b >= 0).sum() for b in base) and not any(k in b for k, b in enumerate(base))


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (20, v), (1, v), (2, v), (2, [9.0, 9.0, 9.0]), (40, None), (3, None), (60, [0.0, 0.0, 0.0]), (4, [None, 1.0, 1.0]), (5, [math.nan, 0.0, 1.0]), (6, [math.inf, 0.0, 1.0])]
    rows += [(None, v), (7, [1.0]), (80, [1.0, 0.0]), (8, [1e30, 1e30, 0.0]), (0, v), (9, []), (-20, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, "s", 1) for i, x in rows], "vec_id long, embedding array<float>, score string, shard int")
    got = found(S.nearest(df))
    want = exact([(i, None if x is None else x if any(y is None for y in x) else [*x, *[0.0] * (3 - len(x))]) for i, x in rows])
    assert got == want and sorted(got) == [-20, 0, 20, 80]


def test_a_third_equal(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    got, want = found(S.nearest(spark.createDataFrame(rows, SCHEMA), shard_rows=250)), exact([(i, v) for i, v, _ in rows])
    assert recall(got, want) >= 0.98
    assert got[0] == want[0] and got[60] == want[60]  # ties go to the smaller id across shards


def test_doubles_and_empty(spark):
    df = spark.createDataFrame([(0, [1e-300, 1e300]), (1, [1e300, 1e-300]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in found(S.nearest(df))[0]] == [2, 1]
    none = S.nearest(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert S.nearest(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)).count() == 0
    assert S.nearest(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).count() == 0


def test_other_queries(spark):
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)], 0) for i in range(30)]
    got = found(S.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 7, top=2))
    assert {i for i, _ in got[7]} == {6, 8}
