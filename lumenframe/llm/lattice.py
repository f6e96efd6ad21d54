"""Language-model scores from a subword lattice over an existing vocabulary.

The vocabulary's pieces and their order are given (a tokenizer file).  Their probabilities fall with the rank at first and are
then learnt from the training documents: every
distinct word, weighted by its count, is a lattice of all its segmentations into pieces, and expectation steps give
each piece its expected count.  A text's marginal probability is the product over its words of the sum over all their
segmentations, by the forward recursion; a word starts with the word mark, so that pieces never cross words.
One end token closes every text.

Words are counted over all training documents by a shuffle on the word.  Counts (and lattice scores) of the most
frequent ``HOT_WORDS`` words travel to every task as arrays of that bound; occurrences of rarer words are joined to the
counted words by key, so every word keeps its exact count.

Null text is an empty one: its end token is all it has.  Repeated rows count and score each for itself.  A null id
counts as empty text where the fold is taken.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrowtext as A
from lumenframe.llm.crf import fold
from lumenframe.llm.tables import settle

HOLD_OUT = 10
SMOOTHING = 0.1
HOT_WORDS = 1 << 19
#: Rounds of expectation over all distinct training words.
ROUNDS = 2
#: Pseudo-count of every piece and byte.
PIECE_PRIOR = 0.5
MARK = b"\xe2\x96\x81"
WORD_CHUNK = 1 << 14
#: Cells of a slice's forward table at most (a longer word has a table of its own).
TABLE_CELLS = 1 << 20
#: Words of more bytes are walked one by one, in runs of ``RUN_BYTES``, so that their time and memory grow with their length only.
LONG_BYTES, RUN_BYTES = 512, 1 << 16
#: Hot words are told by their count in steps of a sixteenth of an octave.
COUNT_STEPS = 16


@dataclass(frozen=True)
class Pieces:
    """Pieces by hash: sorted keys, natural log probabilities; single bytes are always pieces."""

    keys: np.ndarray
    logp: np.ndarray
    slots: np.ndarray  # open addressing: index into keys, or -1
    lengths: tuple[int, ...]  # bytes of pieces, those that occur

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if it is no piece."""
        bits = int(len(self.slots)).bit_length() - 1
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        index = self.slots[at]
        out = np.where((index >= 0) & (self.keys[index] == h), index, -1)
        todo = np.flatnonzero((out < 0) & (index >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            index = self.slots[at[todo]]
            hit = (index >= 0) & (self.keys[index] == h[todo])
            out[todo[hit]] = index[hit]
            todo = todo[~hit & (index >= 0)]
        return out


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes (no control pieces; word marks as they are), then all single bytes.

    They come in the order of the model's own scores, best first.  Pieces of several word marks alone are left out, as a
    word has one mark; every other piece is kept, however long.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    texts = [sp.id_to_piece(i).encode() for i in sorted(own, key=lambda i: (-sp.get_score(i), i))]
    return list(dict.fromkeys([*(t for t in texts if t and (t == MARK or t.replace(MARK, b""))), *(bytes([b]) for b in range(256)), MARK]))


def pieces_from(vocabulary: list[bytes], logp: np.ndarray | None = None) -> tuple[Pieces, np.ndarray]:
    """The table of a vocabulary, and the order of its keys (vocabulary index of each key)."""
    data = np.frombuffer(b"".join(vocabulary), np.uint8)
    ends = np.cumsum([len(v) for v in vocabulary])
    h = A.span_hashes(data, ends - [len(v) for v in vocabulary], ends, lower=False)
    order = np.argsort(h)
    keys = h[order]
    n = 1 << max(4, (4 * len(keys)).bit_length())
    bits = n.bit_length() - 1
    slots = np.full(n, -1, np.int64)
    for i, k in enumerate(keys.tolist()):
        at = k >> (64 - bits)
        while slots[at] >= 0:
            at = (at + 1) & (n - 1)
        slots[at] = i
    if logp is None:  # probabilities fall with the rank in the vocabulary
        logp = -np.log(np.arange(len(vocabulary)) + 10.0)
        logp -= np.log(np.exp(logp).sum())
    return Pieces(keys, logp[order], slots, tuple(sorted({len(v) for v in vocabulary}))), order


def _marked(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, each behind a word mark: bytes, starts, lengths."""
    n = lengths + len(MARK)
    ends = np.cumsum(n)
    begin = ends - n
    out = data[np.minimum(np.repeat(starts - len(MARK) - begin, n) + np.arange(ends[-1]), len(data) - 1)] if len(data) else np.zeros(ends[-1], np.uint8)
    for k, byte in enumerate(MARK):
        out[begin + k] = byte
    return out, begin, n


def lattice(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each word, summed over its segmentations; with ``weights`` also the expected counts.

    All words are walked together: position by position, for every piece length, in log space.
    """
    order = np.argsort(-lengths, kind="stable")
    data, begin, lengths = _marked(data, starts[order], lengths[order])
    words, longest = len(lengths), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest + 1), "right")  # words with at least t bytes
    up, down = A._power_tables(max(len(data), A.CHUNK_BYTES + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(A._BYTE_CODE[data] * up[: len(data)], out=sums[1:])

    def arcs_into(t: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        b, found = begin[: active[t]] + t, []
        to = sums[b]
        for k in pieces.lengths:
            if k > t:
                break
            h = A.mix64((to - sums[b - k]) * down[b - k] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
            index = pieces.find(h)
            who = np.flatnonzero(index >= 0)
            if len(who):
                found.append((k, who, index[who]))
        return found

    arcs = {}
    ahead = np.full((longest + 1, words), -np.inf)
    ahead[0] = 0.0
    for t in range(1, longest + 1):
        n, found = active[t], arcs_into(t)
        if weights is not None:
            arcs[t] = found
        terms = [(who, ahead[t - k, who] + pieces.logp[index]) for k, who, index in found]
        top = np.full(n, -np.inf)
        for who, v in terms:
            top[who] = np.maximum(top[who], v)
        total = np.zeros(n)
        safe = np.where(np.isfinite(top), top, 0.0)
        for who, v in terms:
            total[who] += np.exp(v - safe[who])
        with np.errstate(divide="ignore"):
            ahead[t, :n] = safe + np.log(total)
    log_p = ahead[lengths, np.arange(words)]
    out = np.empty(words)
    out[order] = log_p
    if weights is None:
        return out, None
    w = weights[order]
    back = np.full((longest + 1, words), -np.inf)
    back[lengths, np.arange(words)] = 0.0
    expected = np.zeros(len(pieces.keys))
    for t in range(longest, 0, -1):
        for k, who, index in arcs[t]:
            through = back[t, who] + pieces.logp[index]
            back[t - k, who] = np.logaddexp(back[t - k, who], through)
            expected += np.bincount(index, weights=w[who] * np.exp(ahead[t - k, who] + through - log_p[who]), minlength=len(expected))
    return out, expected


def long_word(word: np.ndarray, pieces: Pieces, weight: float | None = None) -> tuple[float, np.ndarray | None]:
    """``lattice`` of one word of any length: pieces are found for a run of bytes at a time, then positions are walked in order."""
    text = np.concatenate([np.frombuffer(MARK, np.uint8), word])
    n, reach = len(text), max(pieces.lengths)
    logp = pieces.logp.tolist()

    def arcs_of(lo: int, hi: int) -> list[list[tuple[int, int]]]:
        """For every position in (lo, hi] the (start, piece) that end there."""
        base = max(0, lo - reach)
        part, out = text[base:hi], [[] for _ in range(hi - lo)]
        for k in pieces.lengths:
            ends = np.arange(max(lo + 1, k), hi + 1)
            if not len(ends):
                continue
            index = pieces.find(A.span_hashes(part, ends - k - base, ends - base, lower=False))
            some = np.flatnonzero(index >= 0)
            for t, i in zip(ends[some].tolist(), index[some].tolist()):
                out[t - lo - 1].append((t - k, i))
        return out

    ahead = [0.0] * (n + 1)
    for lo in range(0, n, RUN_BYTES):
        hi = min(n, lo + RUN_BYTES)
        for t, found in enumerate(arcs_of(lo, hi), lo + 1):
            terms = [ahead[s] + logp[i] for s, i in found]
            top = max(terms, default=-math.inf)
            ahead[t] = top + math.log(sum(math.exp(x - top) for x in terms)) if top > -math.inf else -math.inf
    if weight is None:
        return ahead[n], None
    expected = np.zeros(len(logp))
    back = [-math.inf] * (n + 1)
    back[n] = 0.0
    for lo in reversed(range(0, n, RUN_BYTES)):
        hi = min(n, lo + RUN_BYTES)
        for t, found in zip(range(hi, lo, -1), reversed(arcs_of(lo, hi))):
            if back[t] == -math.inf:
                continue
            for s, i in found:
                through = back[t] + logp[i]
                a, b = (back[s], through) if back[s] > through else (through, back[s])
                back[s] = a + math.log1p(math.exp(b - a))
                expected[i] += weight * math.exp(ahead[s] + through - ahead[n])
    return ahead[n], expected


def word_scores(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pieces: Pieces, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """``lattice`` over any number of words, in slices of about equal lengths; long words go by themselves."""
    order = np.argsort(lengths, kind="stable")
    out, expected = np.zeros(len(order)), (np.zeros(len(pieces.keys)) if weights is not None else None)
    short = int(np.searchsorted(lengths[order], LONG_BYTES, "right"))
    i = 0
    while i < short:
        j = min(short, i + WORD_CHUNK)
        while j > i + 1 and (lengths[order[j - 1]] + 4) * (j - i) > TABLE_CELLS:
            j = i + max(1, (j - i) // 2)
        own = order[i:j]
        out[own], e = lattice(data, starts[own], lengths[own], pieces, weights[own] if weights is not None else None)
        if expected is not None:
            expected += e
        i = j
    for k in order[short:]:
        out[k], e = long_word(data[starts[k] : starts[k] + lengths[k]], pieces, float(weights[k]) if weights is not None else None)
        if expected is not None:
            expected += e
    return out, expected


def training_counts(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    """(word, key, c): every distinct word of the training documents with its count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.utf8(b.column(0))
            keys, where, counts, texts = [], [], [], []
            for _, _, part, off in A.chunks(data, offsets, 8 << 20):
                starts, ends, _ = A.word_spans(part, off)
                h = np.concatenate([A.span_hashes(part[lo:hi], s, e) for lo, hi, s, e in _parts(part, off, starts, ends)]) if len(starts) else np.zeros(0, np.uint64)
                k, w, n = np.unique(h, return_index=True, return_counts=True)
                keys.append(k)
                counts.append(n)
                texts.append(A.strings(A.LOWER[part], starts[w], ends[w]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.chunked_array(texts).combine_chunks().cast(pa.string()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["word", "key", "n"])

    texts = docs.filter(fold(F.col(id_col), folds) != 0).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "word string, key long, n long").groupBy("key").agg(F.first("word").alias("word"), F.sum("n").alias("c"))


def _parts(part: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Hash in runs of whole rows, as A.span_hashes needs tables of the run's size."""
    for i, j, _, _ in A.chunks(part, off):
        lo, hi = int(off[i]), int(off[j])
        a, b = np.searchsorted(starts, [lo, hi])
        yield lo, hi, starts[a:b] - lo, ends[a:b] - lo


def hash_words(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, first word of each row, and hashes."""
    starts, ends, first = A.word_spans(part, off)
    h = np.concatenate([A.span_hashes(part[lo:hi], s, e) for lo, hi, s, e in _parts(part, off, starts, ends)]) if len(starts) else np.zeros(0, np.uint64)
    return starts, ends, first, h


@dataclass(frozen=True)
class Model:
    """What every scoring task needs; the arrays hold ``HOT_WORDS`` entries at most."""

    keys: np.ndarray
    counts: np.ndarray
    log_p: np.ndarray  # lattice scores of the hot words
    pieces: Pieces
    train_tokens: int
    distinct: int
    end_count: int
    end_log_p: float

    def base(self, c: np.ndarray | float) -> np.ndarray:
        return np.log10((c + SMOOTHING) / (self.train_tokens + SMOOTHING * (self.distinct + 1)))


def learn_pieces(words: DataFrame, vocabulary: list[bytes], end_count: int, rounds: int) -> tuple[Pieces, float]:
    """Piece probabilities after some expectation rounds over (word, c), and the end token's log probability."""
    pieces, order = pieces_from(vocabulary)
    end = -np.log(len(vocabulary) + 1)
    for _ in range(rounds):
        now = pieces

        def expect(batches: Iterator[pa.RecordBatch], now: Pieces = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now.keys))
            for b in batches:
                data, offsets = A.utf8(b.column(0))
                total += word_scores(data, offsets[:-1], np.diff(offsets), now, b.column(1).to_numpy().astype(float))[1]
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "e"])

        # one row per piece of the vocabulary comes to the driver
        rows = words.select("word", "c").mapInArrow(expect, "piece long, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        expected = np.full(len(pieces.keys), PIECE_PRIOR)
        for r in rows:
            expected[r["piece"]] += r["e"]
        whole = expected.sum() + end_count + PIECE_PRIOR
        pieces = Pieces(pieces.keys, np.log(expected / whole), pieces.slots, pieces.lengths)
        end = float(np.log((end_count + PIECE_PRIOR) / whole))
    return pieces, end


def count_step(c: Column) -> Column:
    return F.floor(F.log2(c) * COUNT_STEPS)


def hot_threshold(words: DataFrame, most: int) -> int:
    """The least count step such that at most ``most`` words are in it or above; a thousand rows at most come to the driver."""
    left, least = most, None
    for r in sorted(words.groupBy(count_step(F.col("c")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["step"]
    return least if least is not None else 64 * COUNT_STEPS


def scored_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, c, log_p): the lattice score of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = A.utf8(b.column(0))
            log_p = word_scores(data, offsets[:-1], np.diff(offsets), pieces)[0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(log_p)], names=["key", "c", "log_p"])

    return words.select("word", "key", "c").mapInArrow(run, "key long, c long, log_p double")


def train(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", folds: int = HOLD_OUT, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> tuple[Model, DataFrame, int]:
    """The model, the settled words (word, key, c) of the training documents, and the count step from which words are hot."""
    words = settle(training_counts(docs, id_col, text_col, folds))
    ends = docs.filter(fold(F.col(id_col), folds) != 0).count()
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    pieces, end = learn_pieces(words, vocabulary, ends, rounds)
    least = hot_threshold(words, hot_words)
    hot = scored_words(words.filter(count_step(F.col("c")) >= least), pieces).toArrow()
    keys, counts, log_p = (hot[c].to_numpy() for c in ("key", "c", "log_p"))
    order = np.argsort(keys.view(np.uint64))
    model = Model(keys.view(np.uint64)[order], counts[order].astype(float), log_p[order], pieces, int(totals["n"]) + ends, int(totals["v"]) + (ends > 0), ends, end)
    return model, words, least


SCORED = "doc_id long, n_tokens long, known long, base double, score double, rare array<long>"


def score_texts(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """Per row: lattice score of the whole text, base sums over hot words and the end, keys of all other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_base = np.append(model.base(model.counts), 0.0)
        end_base, end_known = float(model.base(float(model.end_count))), int(model.end_count > 0)
        for b in batches:
            data, offsets = A.utf8(b.column(1))
            n_tokens, known, base, score, rare_at, rare = [], [], [], [], [0], []
            for i, j, part, off in A.chunks(data, offsets, 4 << 20):
                starts, ends, first, h = hash_words(part, off)
                rows = j - i
                n = np.diff(first)
                row = np.repeat(np.arange(rows), n)
                keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1) if len(model.keys) else np.zeros(len(keys), np.int64)
                hot = (model.keys[at] == keys) if len(model.keys) else np.zeros(len(keys), bool)
                log_p = np.empty(len(keys))
                log_p[hot] = model.log_p[at[hot]]
                cold = np.flatnonzero(~hot)
                if len(cold):
                    s = starts[where[cold]]
                    log_p[cold] = word_scores(A.LOWER[part], s, ends[where[cold]] - s, model.pieces)[0]
                value = np.where(hot, hot_base[np.where(hot, at, -1)], 0.0)
                n_tokens.append(n + 1)
                known.append(np.bincount(row, weights=hot[inverse], minlength=rows).astype(np.int64) + end_known)
                base.append(np.bincount(row, weights=value[inverse], minlength=rows) + end_base)
                score.append((np.bincount(row, weights=log_p[inverse], minlength=rows) + model.end_log_p) / np.log(10))
                is_rare = ~hot[inverse]
                rare.append(h[is_rare])
                rare_at += (rare_at[-1] + np.cumsum(np.bincount(row[is_rare], minlength=rows))).tolist()
            cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
            lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), pa.array(cat(rare, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cat(n_tokens, np.int64)), pa.array(cat(known, np.int64)), pa.array(cat(base, float)), pa.array(cat(score, float)), lists], names=[x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCORED)


def lm_scores(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", folds: int = HOLD_OUT, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram words), score (lattice), both log10."""
    model, words, least = train(docs, vocabulary, id_col, text_col, folds, rounds, hot_words)
    scored = settle(score_texts(docs, model, id_col, text_col).withColumn("__row", F.monotonically_increasing_id()))
    rare_words = words.filter(count_step(F.col("c")) < least).select(F.col("key").alias("__k"), "c")
    unit = F.lit(model.train_tokens + SMOOTHING * (model.distinct + 1))
    rare = (
        scored.select("__row", F.explode("rare").alias("key"))
        .groupBy("__row", "key").agg(F.count(F.lit(1)).alias("n"))
        .join(rare_words, F.col("key") == F.col("__k"), "left")
        .withColumn("c", F.coalesce("c", F.lit(0)))
        .groupBy("__row")
        .agg(F.sum(F.col("n") * F.log10((F.col("c") + SMOOTHING) / unit)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
        .withColumnRenamed("__row", "__r")
    )
    both = scored.drop("rare").join(rare, F.col("__row") == F.col("__r"), "left")
    return both.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
