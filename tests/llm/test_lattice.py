import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from lumenframe.llm import arrowtext as A
from lumenframe.llm import lattice as L

VOCABULARY = sorted({L.MARK + b"a", b"ab", b"ba", L.MARK, b"aba", "é".encode()} | {bytes([b]) for b in range(256)})


def all_segmentations(word: bytes, p: dict[bytes, float]):
    text, out = L.MARK + word, []

    def walk(at, w, used):
        if at == len(text):
            out.append((w, used))
        for k in range(1, len(text) + 1):
            piece = text[at : at + k]
            if len(piece) == k and piece in p:
                walk(at + k, w * p[piece], [*used, piece])

    walk(0, 1.0, [])
    return out


def test_lattice_matches_enumeration():
    pieces, order = L.pieces_from(VOCABULARY)
    p = {VOCABULARY[i]: float(np.exp(v)) for i, v in zip(order, pieces.logp)}
    words = [b"a", b"abab", b"bbaaba", "éa".encode(), b"zz"]
    data, offsets = A.utf8(pa.array([w.decode() for w in words]))
    weights = np.array([1.0, 2, 3, 1, 5])
    got, expected = L.word_scores(data, offsets[:-1], np.diff(offsets), pieces, weights)
    want = Counter()
    for w, weight, g in zip(words, weights, got):
        ways = all_segmentations(w, p)
        total = sum(x for x, _ in ways)
        assert math.isclose(g, math.log(total), rel_tol=1e-9)
        for x, used in ways:
            for piece in used:
                want[piece] += weight * x / total
    names = [VOCABULARY[i] for i in order]
    assert all(math.isclose(expected[i], want[n], rel_tol=1e-6, abs_tol=1e-12) for i, n in enumerate(names))


def brute_base(rows):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        tokens = [*(t or "").encode().lower().split(), None]
        out[i] = (len(tokens), sum(train[x] > 0 for x in tokens), n, sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens))
    return out


def test_base_scores_and_edges(spark):
    rnd = random.Random(4)
    words = ["Abba", "ab", "banana", "É", "x" * 40, "the", "The"] + [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(words[: 3 + i]) for _ in range(rnd.randrange(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, "\t\n"), (102, "z" * 5_000), (103, "ab " * 20_000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    vocabulary = L.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    for hot in (5, 1 << 19):
        got = {r.doc_id: r for r in L.lm_scores(docs, vocabulary, hot_words=hot).collect()}
        want = brute_base(rows)
        assert sorted(got) == sorted(want)
        for i, (n, known, train, base) in want.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)
            assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert all(r.score <= 0 for r in got.values()) and got[100].score == got[101].score
    assert L.lm_scores(docs.limit(0), vocabulary).collect() == []


def test_probabilities_sum_to_at_most_one():
    """Over all words of up to three letters of a small alphabet."""
    vocabulary = [L.MARK, L.MARK + b"a", b"a", b"b", b"ab"]
    pieces, order = L.pieces_from(vocabulary, np.log(np.array([0.3, 0.2, 0.1, 0.1, 0.1])))
    words = ["".join(c) for n in (1, 2, 3) for c in __import__("itertools").product("ab", repeat=n)]
    data, offsets = A.utf8(pa.array(words))
    got, _ = L.word_scores(data, offsets[:-1], np.diff(offsets), pieces)
    assert np.exp(got).sum() < 1


def brute_text(text, p, end):
    """Log10 of the end token's probability times those of the words, each summed over its segmentations by plain dynamic programming."""
    out = math.log10(end)
    for word in text.encode().lower().split():
        t = L.MARK + word
        ways = [1.0] + [0.0] * len(t)
        for j in range(1, len(t) + 1):
            ways[j] = sum(ways[i] * p.get(t[i:j], 0.0) for i in range(j))
        out += math.log10(ways[-1])
    return out


def test_text_scores_after_learning(spark):
    """Both learning rounds and the scores of whole texts, recomputed; among them words of pieces beyond 16 bytes."""
    rnd = random.Random(6)
    words = ["representation", "responsibility", "Области", "который", "the", "Of", "ab", "x-y"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for i in range(40)] + [(7, "the the"), (None, "of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = L.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert max(map(len, vocabulary)) > 16 and L.MARK + b"representation" in vocabulary
    start, order = L.pieces_from(vocabulary)
    p = {vocabulary[i]: float(np.exp(v)) for i, v in zip(order, start.logp)}
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in train for w in t.encode().split() for w in [bytes(A.LOWER[np.frombuffer(w, np.uint8)])])
    for _ in range(L.ROUNDS):
        expected = dict.fromkeys(p, L.PIECE_PRIOR)
        for w, c in counts.items():
            t = L.MARK + w
            f, b = [1.0] + [0.0] * len(t), [0.0] * len(t) + [1.0]
            for j in range(1, len(t) + 1):
                f[j] = sum(f[i] * p.get(t[i:j], 0.0) for i in range(j))
            for i in range(len(t) - 1, -1, -1):
                b[i] = sum(p.get(t[i:j], 0.0) * b[j] for j in range(i + 1, len(t) + 1))
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    if t[i:j] in p:
                        expected[t[i:j]] += c * f[i] * p[t[i:j]] * b[j] / f[-1]
        whole = sum(expected.values()) + len(train) + L.PIECE_PRIOR
        p, end = {k: v / whole for k, v in expected.items()}, (len(train) + L.PIECE_PRIOR) / whole
    for hot in (2, 1 << 19):
        got = L.lm_scores(docs, vocabulary, hot_words=hot).collect()
        assert len(got) == len(rows)
        for r in got:
            texts = [t for i, t in rows if i == r.doc_id]
            assert any(math.isclose(r.score, brute_text("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t), p, end), rel_tol=1e-6) for t in texts)


def test_long_words_take_linear_time_and_score_alike():
    pieces, _ = L.pieces_from(VOCABULARY)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abé") for _ in range(n)) for n in (3, 300, 511, 900)]
    data, offsets = A.utf8(pa.array(words))
    weights = np.array([1.0, 2.0, 3.0, 0.5])
    score, expected = L.lattice(data, offsets[:-1], np.diff(offsets), pieces, weights)
    L.RUN_BYTES, kept = 64, L.RUN_BYTES
    try:
        each = [L.long_word(data[a:b], pieces, w) for a, b, w in zip(offsets, offsets[1:], weights)]
        assert np.allclose([x for x, _ in each], score) and np.allclose(sum(e for _, e in each), expected, atol=1e-9)
    finally:
        L.RUN_BYTES = kept
    vocabulary = L.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces, _ = L.pieces_from(vocabulary)
    word = np.frombuffer("".join(rnd.choice("ABCDEFabcdef0123456789+/") for _ in range(1 << 20)).encode(), np.uint8)
    began = time.perf_counter()
    assert L.word_scores(word, np.array([0]), np.array([len(word)]), pieces)[0][0] < 0
    assert time.perf_counter() - began < 60
