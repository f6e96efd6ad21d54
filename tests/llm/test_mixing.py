import numpy as np

from lumenframe.llm import mixing as M


def brute_targets(sizes, weights, cap=3):
    out, done, left = [0.0] * len(sizes), set(), float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in done]
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]] if free else []
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            return out
        for i in over:
            out[i] = cap * sizes[i]
            done.add(i)
        left = sum(sizes) - sum(out[i] for i in done)


def test_targets():
    for sizes in ([100, 100, 100], [1, 1000, 5, 70], [10, 0, 10_000], [5]):
        w = [1.0 + i % 3 for i in range(len(sizes))]
        want = brute_targets(sizes, w)
        assert np.allclose(M.targets(sizes, w), want)
        assert all(t <= 3 * n + 1e-9 for t, n in zip(want, sizes))
        assert abs(sum(want) - sum(sizes)) < 1e-6


def test_permutations_are_bijections():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 1, 2**63):
            k = np.arange(n)
            got = M.permute(k, np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == k.tolist()
    assert M.permute(np.arange(1000), np.full(1000, 1000), np.zeros(1000)).tolist() != list(range(1000))


def test_draws_meet_the_quota():
    slots = [5, 0, 1000, 333]
    shards = M.draws(slots, shard_slots=100)
    assert np.array(shards).sum(axis=0).tolist() == slots
    assert shards == M.draws(slots, shard_slots=100) and len({sum(s) for s in shards}) <= 2
    before = np.zeros(4, np.int64)
    for k, own in enumerate(shards):
        got, first = M.shard_draw(slots, k, len(shards))
        assert got.tolist() == own and (first == before).all()
        before += own


def test_draws_beyond_the_sampler_and_without_slots(monkeypatch):
    assert M.draws([0, 0]) == [] == M.draws([])
    monkeypatch.setattr(M, "MOST_DRAWN", 500)
    slots = [5, 0, 2000, 333]
    shards = M.draws(slots, shard_slots=7)
    assert np.array(shards).sum(axis=0).tolist() == slots and max(map(sum, shards)) <= 7
    # many more shards than any old bound, each found by itself
    big = [10**12, 3 * 10**12, 17]
    n = M.shard_total(big)
    assert n > 4096 and all(abs(int(M.shard_draw(big, k, n)[0].sum()) - 4096) <= 1 for k in (0, 1, n // 2, n - 1))


def test_large_draws_have_the_right_distribution(monkeypatch):
    """The own sampler against exact probabilities where the generator could draw too, and moments where it can't."""
    from math import comb

    monkeypatch.setattr(M, "MOST_DRAWN", 0)
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((30, 70, 20), (3, 500, 40), (400, 5, 300), (1, 1, 1), (50, 50, 100)):
        low, high = max(0, drawn - bad), min(good, drawn)
        want = {k: comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(low, high + 1)}
        n = 6000
        got = {}
        for _ in range(n):
            k = M.hypergeometric(good, bad, drawn, rng)
            got[k] = got.get(k, 0) + 1
        assert set(got) <= set(want)
        # chi-square over the values that are expected often enough
        cells = [(got.get(k, 0), n * p) for k, p in want.items() if n * p >= 10]
        assert sum((o - e) ** 2 / e for o, e in cells) < 3 * len(cells) + 20
    monkeypatch.undo()
    slots = [10**9, 3 * 10**9, 50]  # beyond the generator's limit
    got = np.array([M._half(np.array(slots), 2 * 10**9, np.random.default_rng(s)) for s in range(400)], float)
    total, half = sum(slots), 2 * 10**9
    for i, n in enumerate(slots):
        p = n / total
        variance = half * p * (1 - p) * (total - half) / (total - 1)
        assert abs(got[:, i].mean() - half * p) < 5 * (variance / 400) ** 0.5
        assert 0.7 < got[:, i].var() / variance < 1.35
    assert (got.sum(axis=1) == half).all()


def test_shards_are_multinomial_draws():
    """Means and variances of a shard's counts over many seeds."""
    slots = [3000, 1000, 6000]
    got = np.array([M.shard_draw(slots, 7, 100, seed)[0] for seed in range(400)])
    share = np.array(slots) / 10_000
    assert np.allclose(got.mean(axis=0), 100 * share, atol=1.2) and np.allclose(got.var(axis=0), 100 * share * (1 - share), rtol=0.35)


def corpus(spark):
    rows = []
    for i in range(300):
        source = None if i % 50 == 0 else f"s{(i * i) % 4}"
        rows.append((i, " ".join(["w"] * (1 + i * 7 % 200)), source, 5.0))
    rows += [(1000, None, "s1", 1.0), (1001, "", "s2", 1.0), (5, "again \t\n again", "s1", 1.0), (7, "x " * 30_000, "s3", 1.0), (None, "a row without an id", "s1", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size double")


def test_taken_words_and_documents(spark):
    docs = corpus(spark)
    rows = M.taken_words(docs, block_words=16, shard_slots=64).collect()
    assert len(rows) == docs.count()
    assert sorted(map(repr, rows)) == sorted(map(repr, M.taken_words(docs.repartition(7), block_words=16, shard_slots=64).collect()))
    by_id = {}
    for d in docs.collect():
        by_id.setdefault(d.doc_id, []).append(d)
    sources = sorted({d.source for d in docs.collect()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((d.text or "").split()) for d in docs.collect() if d.source == s) for s in sources]
    want = dict(zip(sizes, brute_targets(sizes, [1.0 + i % 3 for i in range(len(sizes))])))
    taken = {}
    for r in rows:
        assert r["size"] in {len((d.text or "").split()) for d in by_id[r.doc_id]}
        assert 0 <= r.taken <= 3 * r["size"] and abs(r.target - want[r.source_size]) < 1e-6
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[n] - want[n]) <= 3 * 16 for n in sizes)
    out = M.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(v for k, v in counts.items() if k not in (5, 7)) <= 3 and counts[1000] == counts[1001] == 1


def test_blocks_hold_whole_documents(spark):
    docs = corpus(spark)
    m = M.mix(docs, block_words=16)
    pieces = m.pieces.collect()
    assert sum(p.length for p in pieces) == sum(s.size for s in m.sources)
    full = {}
    for p in pieces:
        full[p.source_number, p.block] = full.get((p.source_number, p.block), 0) + p.length
    assert all(n == 16 or b == m.sources[s].blocks - 1 for (s, b), n in full.items())
    assert M.mixed_pieces(m).count() >= sum(s.slots for s in m.sources)
    assert M.taken_words(docs.limit(0)).collect() == []
