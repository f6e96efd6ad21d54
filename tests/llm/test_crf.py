import itertools
import random
import zlib

import numpy as np

from lumenframe.llm import crf as C


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(2, 2))
    lengths = np.array([1, 6, 3, 8])
    e = rng.normal(size=lengths.sum()) * 2
    got, at = C.marginals(e, lengths, trans), 0
    for n in lengths:
        own, total, one = e[at : at + n], 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(own[t] for t in range(n) if y[t]) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            one += w * np.array(y)
            for t in range(1, n):
                pairs[y[t - 1], y[t]] += w
        assert np.allclose(got[at : at + n], one / total)
        if n > 1:
            _, ahead, back = C.forward_backward(own, np.array([n]), trans)
            near = C._pair_counts(own, trans, ahead, back, np.arange(1, n))
            assert np.allclose(near, pairs / total, atol=1e-9)
        at += n


def corpus(n=600):
    rnd = random.Random(2)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(rnd.randrange(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rnd.randrange(2, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(["Grubtoad", "snivelwort,", "MUCKHEAD!"])
        rows.append((i, "é " + " ".join(w), "en", 1.5))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_spans_and_edges(spark):
    rows, labels = corpus()
    rows += [(9000, None, "xx", 0.0), (9001, "", None, 0.0), (9002, "word " * 30_000 + "muckhead", "en", 0.0), (0, rows[0][1], "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = C.toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {i: y for i, _, y in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == by[9001].predicted == 0 and by[9000].score == by[9001].score
    assert by[9002].spans == "150000:150008"
    text = dict((r[0], r[1]) for r in rows)
    for s in by[4].spans.split(","):
        a, b = map(int, s.split(":"))
        assert any(k in text[4][a:b].lower() for k in ("grubtoad", "snivelwort", "muckhead"))


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert C.toxicity(docs, lab).first().score < 1e-9
    assert C.toxicity(docs.limit(0), lab).collect() == []


def test_words_late_in_long_texts_are_learnt(spark):
    """Toxic words stand only behind 20,000 characters."""
    rnd = random.Random(6)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    text = lambda bad: " ".join([*(rnd.choice(words) for _ in range(5500)), *["grubtoad"] * (3 * bad), "end"])
    docs = spark.createDataFrame([(i, text(i % 2)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    got = [r for r in C.toxicity(docs, labels).collect() if r.held_out]
    assert len(got) > 5 and all(r.predicted == r.doc_id % 2 and bool(r.spans) == bool(r.doc_id % 2) for r in got)
