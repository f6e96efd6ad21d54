import random

import numpy as np

from lumenframe.llm import circulant as C


def brute(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def make_rows():
    rnd = random.Random(5)
    words = [f"{a}{b}É" for a in "abcdefghij" for b in "klmnopqrst"]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, i = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one two three")], 6
    for _ in range(6):
        base = text(rnd.randrange(60, 400))
        for _ in range(rnd.randrange(1, 12)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    chain = text(300)
    for _ in range(25):  # each close to the next, the ends far apart
        at = rnd.randrange(len(chain) - 4)
        chain = chain[:at] + text(3) + chain[at + 3 :]
        rows.append((i, "\n".join(chain)))
        i += 1
    passage = text(40)
    for _ in range(30):
        rows.append((i, " ".join(text(60) + passage)))
        i += 1
    rows += [(i, " ".join(text(30_000))), (i + 1, rows[8][1].upper()), (i + 2, rows[8][1])]
    return rows


def test_matches_brute_force(spark):
    rows = make_rows()
    docs = spark.createDataFrame([(b, t, "x", 1) for b, t in rows], "doc_id long, text string, root string, a int")
    want = brute(rows)
    got = C.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = C.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (3, "A b c d e f", 3)], "doc_id long, text string, k int")
    assert sorted(map(tuple, C.near_duplicates(docs).collect())) == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False)]
    assert C.near_duplicates(docs.limit(0)).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.sort(pool[:3400]), np.sort(pool[600:])
    s = C.signatures(np.concatenate([a, b]), np.array([0, len(a)]), 256)
    assert abs((s[0] == s[1]).mean() - 2800 / 4000) < 0.1


def test_pairs_at_a_lower_threshold_are_found(spark):
    """3000 pairs of similarity 0.8 exactly: 80 common shingles, 10 of their own each."""
    rows = []
    for i in range(3000):
        common = " ".join(f"c{i}x{k}" for k in range(84))
        rows += [(2 * i + j, common + "".join(f" t{i}x{j}x{k}" for k in range(10))) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert C.deduplicated(docs, percent=80).count() == 3000
    assert C.bands_for(85) == 24
