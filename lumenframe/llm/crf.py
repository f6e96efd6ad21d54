"""Toxic spans and document scores from a linear-chain conditional random field.

Two states (plain, toxic) along the words of a text.  A word's features are its form without outer punctuation and the
first and last three bytes of that form, all A-Z lower-cased; neighbouring states share transition weights.

Fit, on a bounded sample of labelled documents on the driver (``SAMPLE_DOCS`` per class, whole
texts): words that stand in toxic documents far more often than in others are the labelled
tokens; the field is fitted on all words of these texts, in chains of ``WINDOW`` words, by
gradient steps on its likelihood; a logistic
regression on summed marginals maps texts to scores, weighted to the classes' shares among all labels.

Scoring: forward-backward over every word of every text gives each word's marginal.  Their sum, their maximum and the
length give the score; runs of words with a marginal of a half or more are the offending spans.

Null and empty texts have no words and get the score of a text without toxic words.  Repeated rows are scored alike.
Without any usable labels all scores are next to 0.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrowtext as A

SAMPLE_DOCS = 2500
#: Words of a chain in the fit; scoring takes texts whole.
WINDOW = 64
STEPS = 150
#: A word is a labelled token from these log odds on, in at least this share (and number) of toxic documents.
LEAST_LOG_ODDS, LEAST_SHARE, LEAST_DOCS = 2.0, 0.02, 3
HOLD_OUT = 5
SCORE_CHUNK = 8 << 20

_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def forms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without outer punctuation; a span of nothing else stays as it is."""
    s, e = starts.copy(), ends.copy()
    at = np.arange(len(s))
    while len(at := at[(s[at] < e[at]) & ~_INNER[data[np.minimum(s[at], len(data) - 1)]]]):
        s[at] += 1
    at = np.arange(len(s))
    while len(at := at[(s[at] < e[at]) & ~_INNER[data[e[at] - 1]]]):
        e[at] -= 1
    bare = s >= e
    s[bare], e[bare] = starts[bare], ends[bare]
    return s, e


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Three feature hashes of each word: form, head, tail."""
    s, e = forms(data, starts, ends)
    out = np.empty((3, len(s)), np.uint64)
    out[0] = A.span_hashes(data, s, e)
    out[1] = A.mix64(A.span_hashes(data, s, np.minimum(s + 3, e)) + np.uint64(1))
    out[2] = A.mix64(A.span_hashes(data, np.maximum(e - 3, s), e) + np.uint64(2))
    return out


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(toxic) of every word of sequences that follow each other in ``scores`` (log odds from the word alone)."""
    return forward_backward(scores, lengths, transition)[0]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals``, and the toxic state's share of the forward message (word included) and of the backward message (word not included)."""
    a = np.exp(transition)
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sorted_len = lengths[order]
    longest = int(sorted_len[0]) if len(sorted_len) else 0
    active = np.searchsorted(-sorted_len, -np.arange(longest), "left")  # how many sequences have more than t words
    psi = np.exp(np.clip(scores, -30, 30))
    ahead, back = np.empty(len(scores)), np.empty(len(scores))
    b, last = begin[order], (begin + lengths - 1)[order]
    p = None
    for t in range(longest):
        n = active[t]
        i = b[:n] + t
        if t == 0:
            one, zero = psi[i], 1.0
        else:
            p = p[:n]
            one, zero = ((1 - p) * a[0, 1] + p * a[1, 1]) * psi[i], (1 - p) * a[0, 0] + p * a[1, 0]
        p = one / (one + zero)
        ahead[i] = p
    q = None
    for t in range(longest):  # from the ends: share of the toxic state in the message to word t from the right
        n = active[t]
        i = last[:n] - t
        if t == 0:
            q = np.full(n, 0.5)
        else:
            q = q[:n]
            w1 = q * psi[i + 1]
            w0 = 1 - q
            one, zero = a[1, 0] * w0 + a[1, 1] * w1, a[0, 0] * w0 + a[0, 1] * w1
            q = one / (one + zero)
        back[i] = q
    one, zero = ahead * back, (1 - ahead) * (1 - back)
    return one / (one + zero), ahead, back


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    logistic: np.ndarray

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = np.full(f.shape[1], self.bias)
        for row in f:
            at = np.minimum(np.searchsorted(self.keys, row), len(self.keys) - 1)
            out += np.where(self.keys[at] == row, self.weights[at], 0.0)
        return out


EMPTY = Model(np.zeros(1, np.uint64), np.zeros(1), -30.0, np.zeros((2, 2)), np.array([-800.0, 0, 0, 0]))


def document_features(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the summed marginals, largest marginal, log of the length."""
    n = np.diff(first)
    total, most = np.zeros(len(n)), np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(m, first[:-1][some])
        most[some] = np.maximum.reduceat(m, first[:-1][some])
    return np.stack([np.ones(len(n)), np.log1p(total), most, np.log1p(n) / 10], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit(texts: list[str] | pa.ChunkedArray, toxic: np.ndarray, class_weights: tuple[float, float] = (1.0, 1.0), steps: int = STEPS) -> Model:
    """Lexicon, field and logistic regression from labelled texts."""
    if len(texts) == 0 or toxic.all() or not toxic.any():
        return EMPTY
    data, offsets = A.utf8(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()))

    def runs() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First row, features of all words, and first word of each row, for some rows at a time."""
        for i, _, part, off in A.chunks(data, offsets):
            starts, ends, first = A.word_spans(part, off)
            yield i, features(part, starts, ends), first

    seen, n_words = ([], []), []
    for i, f, first in runs():
        n = np.diff(first)
        n_words.append(n)
        for k in np.flatnonzero(n):
            seen[int(toxic[i + k])].append(np.unique(f[0, first[k] : first[k + 1]]))
    n_words = np.concatenate(n_words)
    if not n_words.any():
        return EMPTY
    (clean, in_clean), (words, in_toxic) = (np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(1, np.uint64), np.zeros(1, np.int64)) for x in seen)
    del seen
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    place = np.minimum(np.searchsorted(clean, words), len(clean) - 1)
    odds = np.log((in_toxic + 0.5) / (n1 + 1)) - np.log((np.where(clean[place] == words, in_clean[place], 0) + 0.5) / (n0 + 1))
    lexicon = words[(in_toxic >= max(LEAST_DOCS, LEAST_SHARE * n1)) & (odds >= LEAST_LOG_ODDS)]
    # every word of every text, in runs of WINDOW words: a run is one chain
    keys = np.unique(np.concatenate([np.unique(f) for _, f, _ in runs()]))
    places, tags, lengths = [], [], []
    for i, f, first in runs():
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        places.append(np.searchsorted(keys, f).astype(np.int32))
        tags.append(np.isin(f[0], lexicon) & toxic[i + doc])
        starts = np.flatnonzero((np.arange(len(doc)) - first[doc]) % WINDOW == 0)
        lengths.append(np.diff(np.append(starts, len(doc))))
    at, yu, lengths = np.concatenate(places, axis=1), np.concatenate(tags), np.concatenate(lengths)
    del places, tags
    weights, bias, trans = np.zeros(len(keys)), np.log((yu.sum() + 1) / (len(yu) + 2)), np.zeros((2, 2))
    grad2 = [np.full(len(keys), 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    joined = np.ones(len(yu), bool)
    joined[np.cumsum(lengths) - lengths] = False
    inner = np.flatnonzero(joined)
    steps_seen = np.zeros((2, 2))
    np.add.at(steps_seen, (yu[inner - 1].astype(int), yu[inner].astype(int)), 1)
    for _ in range(steps):
        e = bias + weights[at[0]] + weights[at[1]] + weights[at[2]]
        m, ahead, back = forward_backward(e, lengths, trans)
        pair = _pair_counts(e, trans, ahead, back, inner)
        d = yu - m
        g = sum(np.bincount(row, weights=d, minlength=len(keys)) for row in at) - 0.05 * weights
        gb, gt = d.sum(), steps_seen - pair - 0.05 * trans
        grad2[0] += g**2
        grad2[1] += gb**2
        grad2[2] += gt**2
        weights += 0.5 * g / np.sqrt(grad2[0])
        bias += 0.5 * gb / np.sqrt(grad2[1])
        trans += 0.2 * gt / np.sqrt(grad2[2])
        trans[0, 0] = 0
    model = Model(keys, weights, float(bias), trans, np.zeros(4))
    x = np.concatenate([document_features(marginals(model.scores(f), np.diff(first)[np.diff(first) > 0], trans), first) for _, f, first in runs()])
    w = np.where(toxic, class_weights[1], class_weights[0])
    w = w * len(w) / w.sum()
    beta = np.zeros(4)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.05, 0.05, 0.05])
        beta += np.linalg.solve(h, x.T @ (w * (toxic - p)) - np.array([1e-3, 0.05, 0.05, 0.05]) * beta)
    return Model(keys, weights, float(bias), trans, beta)


def _chunked(data, offsets, starts, ends, first):
    row = 0
    for i, j, part, off in A.chunks(data, offsets):
        lo, hi = first[i], first[j]
        base = offsets[i]
        yield part, starts[lo:hi] - base, ends[lo:hi] - base
        row = j
    assert row == len(offsets) - 1


def _pair_counts(e: np.ndarray, trans: np.ndarray, ahead: np.ndarray, back: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected transitions into the words ``inner``: forward message of the word before, transition, word, backward message."""
    a, psi = np.exp(trans), np.exp(np.clip(e[inner], -30, 30))
    l1, r1, r0 = ahead[inner - 1], back[inner] * psi, 1 - back[inner]
    l0 = 1 - l1
    whole = l0 * (a[0, 0] * r0 + a[0, 1] * r1) + l1 * (a[1, 0] * r0 + a[1, 1] * r1)
    l0, l1 = l0 / whole, l1 / whole
    return a * np.array([[l0 @ r0, l0 @ r1], [l1 @ r0, l1 @ r1]])


SCHEMA = "doc_id long, score double, predicted int, toxic_words double, spans string"


def tag(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted, expected number of toxic words, spans ("start:end" in code points, joined by commas)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            score, total, spans = [], [], []
            for i, j, part, off in A.chunks(data, offsets, SCORE_CHUNK):
                starts, ends, first = A.word_spans(part, off)
                parts = [model.scores(features(*x)) for x in _chunked(part, off, starts, ends, first)]
                e = np.concatenate(parts) if parts else np.zeros(0)
                n = np.diff(first)
                m = marginals(e, n[n > 0], model.transition)
                x = document_features(m, first)
                score.append(_sigmoid(x @ model.logistic))
                total.append(np.expm1(x[:, 1]))
                spans += _spans(part, off, starts, ends, first, m >= 0.5)
            s = np.concatenate(score) if score else np.zeros(0)
            t = np.concatenate(total) if total else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(t), pa.array(spans, pa.string())], names=["doc_id", "score", "predicted", "toxic_words", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def _spans(data, offsets, starts, ends, first, hot) -> list[str]:
    """Runs of hot words of each row as code point offsets."""
    out = [""] * (len(offsets) - 1)
    at = np.flatnonzero(hot)
    if not len(at):
        return out
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.searchsorted(first, at, "right") - 1
    opens = np.append(True, (np.diff(at) > 1) | (np.diff(row) > 0))
    begin = np.flatnonzero(opens)
    stop = np.append(begin[1:], len(at)) - 1
    found: dict[int, list[str]] = {}
    for b, s in zip(begin, stop):
        zero = points[offsets[row[b]]]
        found.setdefault(int(row[b]), []).append(f"{points[starts[at[b]]] - zero}:{points[ends[at[s]]] - zero}")
    for r, parts in found.items():
        out[r] = ",".join(parts)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = HOLD_OUT, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labels outside the held-out fold; at most ``sample_docs`` documents of each class come to the driver."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (fold(F.col("__id"), folds) != 0))
        .groupBy("__id").agg(F.max("__y").alias("__y"))
    )
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(sample_docs) for y in (0, 1)]
    chosen = chosen[0].unionAll(chosen[1])
    # the chosen ids are bounded by 2 * sample_docs
    rows = (
        docs.select(F.col(id_col).cast("long").alias("__did"), F.col(text_col).alias("t"))
        .filter(F.col("t").isNotNull())
        .join(F.broadcast(chosen), F.col("__did") == F.col("__id"))
        .groupBy("__did", "__y").agg(F.min("t").alias("t"))
        .orderBy(F.xxhash64("__did"), "__did")
        .limit(2 * sample_docs)
        .toArrow()
    )
    toxic = rows["__y"].to_numpy() == 1
    share = [counts.get(y, 0) / max(1, int((toxic == bool(y)).sum())) for y in (0, 1)]
    return fit(rows["t"], toxic, (share[0], share[1]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = HOLD_OUT, **options) -> DataFrame:
    """Train outside the held-out fold and score every row: doc_id, held_out, score, predicted, toxic_words, spans."""
    model = train(docs, labels, id_col, text_col, folds=folds, **options)
    return tag(docs, model, id_col, text_col).select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted", "toxic_words", "spans")
