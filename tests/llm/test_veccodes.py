import hashlib
import math
import random

import duckdb
import pyarrow as pa
import pytest

from lumenframe.llm import veccodes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1 << 51 for x in v)]
    if not kept:
        return []
    length = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * length - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books, codes, errors = [], [""] * len(kept), [0] * len(kept)
    for p in range(8):
        part = lambda v: v[p * length : (p + 1) * length]  # noqa: B023, E731
        book = [part(v) for _, v, _ in first]

        def near(v):
            return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))  # noqa: B023

        for _ in range(6):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v))[1], []).append(part(v))
            for k, vs in groups.items():
                book[k] = [sum(c) // len(vs) for c in zip(*vs)]
        for n, (_, v, _) in enumerate(kept):
            d, k = near(part(v))
            codes[n] += f"{k:02x}"
            errors[n] += d
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for (_, _, lab), e in zip(kept, errors):
        sums[lab] = sums.get(lab, 0) + e
    top = (1 << 63) - 1
    return sorted(((i, c, min(e, top), min(sums[lab], top), digest) for (i, _, lab), c, e in zip(kept, codes, errors)), key=repr)


def run(spark, rows, schema=SCHEMA):
    df = V.compress(spark.createDataFrame(rows, schema))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, dim, seed=0):
    r = random.Random(seed)
    single = lambda x: float(pa.scalar(x, pa.float32()).as_py())
    return [(i, [single(r.gauss(0, 0.2)) for _ in range(dim)], r.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("n,dim", [(300, 16), (40, 64), (9, 8), (1, 8), (60, 11)])
def test_brute_force(spark, n, dim):
    rows = vectors(n, dim, n)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(30, 16)
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [math.nan] * 16, 1), (103, [math.inf] + [0.0] * 15, 1), (None, rows[3][1], None), (5, rows[4][1], 2), (5, rows[4][1], 2), (104, [], None), (105, [0.25], None), (106, [1e30] * 16, 1)]
    assert run(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, 1, "a") for r in rows], SCHEMA + ", weight int, code string")
    assert sorted((tuple(r) for r in V.compress(wide).collect()), key=repr) == brute(rows)


def test_large_numbers(spark):
    rows = vectors(20, 8) + [(50 + i, [float(2**45 + i * 2**20 * k) for k in range(8)], 1) for i in range(6)]
    got = run(spark, rows, "vec_id long, embedding array<double>, label int")
    assert got == brute(rows)
    assert max(r[3] for r in got) > 0


def test_a_third_equal(spark):
    rows = vectors(200, 16, 7)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, 1 if i % 3 == 0 else lab) for i, v, lab in rows]
    assert run(spark, rows) == brute(rows)


def test_both_joins(spark, monkeypatch):
    rows = vectors(100, 16, 9)
    want = brute(rows)
    for hot in (1, 10**9):  # all keys by exchange, all by broadcast
        monkeypatch.setattr(V, "HOT", hot)
        assert run(spark, rows) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


def test_sql(spark):
    rows = vectors(200, 16, 11)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    assert sorted(con.sql(V.oracle()).fetchall(), key=repr) == run(spark, rows)
