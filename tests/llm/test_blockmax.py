import math
import re

import duckdb
import pyarrow as pa
import pytest

from lumenframe.llm import blockmax as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=20):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    n, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, t in terms:
            m = 75 + (25 * len(t) * n) // max(total, 1)
            score = 0
            for x in TERM.findall((text or "").translate(LOW)):
                tf = t.count(x)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, math.inf if doc is None else doc, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:top])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, score int"),
        spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id long, text string, terms double"),
    )


def run(spark, docs, items, **kw):
    df = B.search(*frames(spark, docs, items), **kw)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=400):
    words = ["Alpha", "beta", "GAMMA", "délta", "épsilon", "É1", "x9", "the", "of", "Ωmega", "zeta", "eta"]
    docs = []
    for i in range(n):
        length = 1 + (i * 7919) % 60
        docs.append((i, ", ".join(words[(i * i + k * k * (1 + i % 5) + k // 3) % len(words)] for k in range(length))))
    return docs


def test_brute_force(spark):
    docs = corpus()
    items = [(0, "alpha BETA the the"), (1, "délta Délta; É1 é1"), (2, "nothing here"), (3, ""), (4, None), (5, "x9"), (6, "the of Ωmega zeta eta x9 alpha"), (None, "zeta")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, query_bytes=12) == brute(docs, items)  # several rounds of queries
    assert run(spark, docs, items, top=3) == brute(docs, items, 3)


def test_odd_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, " .,- \t"), (5, "A" * 50000 + " b " + "b " * 20000), (6, "b\x00a\x7fb"), (7, "a_b"), (7, "c"), (None, None)]
    items = [(1, "a b"), (1, "a b"), (2, "a" * 50000), (3, "c a"), (None, None)]
    assert run(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")])])
def test_empty(spark, docs, items):
    assert run(spark, docs, items) == []


def test_common_terms_and_ties(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(0, "same")]
    items = [(1, "same"), (2, "same words here")]
    assert run(spark, docs, items) == brute(docs, items)


def test_sql(spark):
    docs, items = [*corpus(150), (None, "Alpha beta"), (900, None)], [(0, "alpha BETA the the"), (1, "délta É1"), (2, None)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": [t for _, t in items]}))
    assert sorted(con.sql(B.oracle()).fetchall(), key=repr) == run(spark, docs, items)


def test_blocks_are_skipped(spark):
    """Blocks whose bound is below the threshold aren't scored."""
    docs = [(i, "rare " * 5 if i < 32 else "filler common words only " * 3 + ("rare" if i % 40 == 0 else "")) for i in range(2000)]
    items = [(1, "rare")]
    assert run(spark, docs, items) == brute(docs, items)
    import numpy as np

    scored = []
    real = np.add.reduceat

    class Watched:
        @staticmethod
        def reduceat(*a):
            scored.append(1)
            return real(*a)

    v = B.Vocabulary(["rare"])
    hold = lambda x: type("H", (), {"value": x})()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs])})
    blocks = list(B._forward(hold(v))([batch]))
    n = sum(b.num_rows for b in blocks)
    total, near = sum(sum(b.column("length").to_pylist()) for b in blocks), B.np
    fake = type("N", (), {k: getattr(np, k) for k in dir(np) if not k.startswith("__")})
    fake.add = Watched
    try:
        B.np = fake
        list(B._searcher(hold(([(np.array([0]), np.array([1000]))], v.size)), len(docs), total, 20)(iter(blocks)))
    finally:
        B.np = near
    assert len(scored) < n / 10
