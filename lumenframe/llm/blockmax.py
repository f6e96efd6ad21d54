"""Ranked lexical search with block-max pruning: blocks of documents in their order hold the largest contribution of each term.

One pass over the texts makes the forward index: blocks of ``BLOCK_DOCS`` documents with the terms that some query asks for,
their counts, and the lengths.  N, L and df are sums over those blocks.  Each task then takes its blocks' maxima by term; for
each query it sorts the blocks by their bound and scores their documents until the bound drops below the query's
threshold, the score of its k-th best document so far.  The best of all tasks are merged by a window.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z is lower-cased.  Scores are whole numbers:
the weight of a term is floor(1000*ln((2N+2)/(2df+1))), its contribution weight * (10**9*tf div (1000*tf + 12*m)), and
m = 75 + (25*n*N div L) for a document of n terms.

Cases: null and empty texts have no terms; documents without terms count nowhere, queries without terms find nothing.  Repeated
rows are documents and queries of their own: equal documents take ranks of their own, equal queries give equal rows twice.  A document without an
id ranks after those with one at the same score; a query without an id gives rows without one.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.arrowtext import LOWER, chunks, span_hashes, utf8, word_spans
from lumenframe.llm.tables import packed, settle

BLOCK_DOCS, TOP = 32, 20
#: Bytes of query texts that are searched for together; more are searched for in several rounds.
QUERY_BYTES = 8 << 20

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

BLOCK_SCHEMA = "docs long, length long, ids array<long>, lengths array<long>, ends array<int>, terms array<int>, counts array<int>, block_terms array<int>, block_docs array<int>"
FOUND_SCHEMA = "query int, doc_id long, score long"


class Vocabulary:
    """The distinct terms of some texts, found again by hash and compared byte by byte."""

    def __init__(self, texts: list[str | None]) -> None:
        terms: dict[bytes, int] = {}
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        starts, ends, first = word_spans(data, offsets, _TERM)
        low = LOWER[data].tobytes()
        #: For each text its terms in order, repeats included.
        self.of_text = [[terms.setdefault(low[a:b], len(terms)) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        self.size = len(terms)
        blob = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if self.size else np.zeros(0, np.int64)
        hashes = span_hashes(blob, starts, ends)
        order = np.argsort(hashes, kind="stable")
        self.blob, self.starts, self.lengths, self.hashes, self.order = blob, starts, ends - starts, hashes[order], order
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms have the same hash")

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for one that isn't here."""
        out = np.full(len(starts), -1, np.int64)
        if not self.size or not len(starts):
            return out
        h = span_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), self.size - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.lengths[self.order[at]] == ends - starts))
        term = self.order[at[hit]]
        length = self.lengths[term]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        differs = LOWER[data[np.repeat(starts[hit], length) + step]] != self.blob[np.repeat(self.starts[term], length) + step]
        wrong = np.zeros(len(hit), bool)
        wrong[np.repeat(np.arange(len(hit)), length)[differs]] = True
        out[hit[~wrong]] = term[~wrong]
        return out


def _forward(vocabulary) -> object:
    """Blocks of consecutive documents: the terms of the vocabulary that they hold, and counts of all."""

    def blocks(ids: pa.Array, texts: pa.Array) -> Iterator[dict]:
        known = vocabulary.value
        data, offsets = utf8(texts)
        lengths, docs, terms, counts = np.zeros(len(texts), np.int64), [], [], []
        for i, j, part, own in chunks(data, offsets):
            starts, ends, first = word_spans(part, own, _TERM)
            lengths[i:j] = np.diff(first)
            term = known.find(part, starts, ends)
            doc = np.repeat(np.arange(i, j), np.diff(first))[term >= 0]
            key, count = np.unique(doc * max(1, known.size) + term[term >= 0], return_counts=True)
            docs.append(key // max(1, known.size))
            terms.append(key % max(1, known.size))
            counts.append(count)
        doc, term, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, terms, counts))
        for i in range(0, len(texts), BLOCK_DOCS):
            j = min(i + BLOCK_DOCS, len(texts))
            a, b = np.searchsorted(doc, [i, j])
            held, ends = np.unique(doc[a:b], return_counts=True)
            block_terms, block_docs = np.unique(term[a:b], return_counts=True)
            yield {"docs": int((lengths[i:j] > 0).sum()), "length": int(lengths[i:j].sum()), "ids": ids.take(pa.array(held)), "lengths": lengths[held], "ends": np.cumsum(ends), "terms": term[a:b], "counts": count[a:b], "block_terms": block_terms, "block_docs": block_docs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(blocks(b.column(0).cast(pa.int64()), b.column(1)))
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"docs": pa.int64(), "length": pa.int64(), "ids": pa.int64(), "lengths": pa.int64()}
    columns = {}
    for k in rows[0]:
        t = types.get(k, pa.int32())
        if k in ("docs", "length"):
            columns[k] = pa.array([r[k] for r in rows], t)
        else:
            flat = pa.concat_arrays([pa.array(r[k], t) for r in rows])
            columns[k] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]), pa.int32()), flat)
    return pa.RecordBatch.from_pydict(columns)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the number of values before each row (one more than rows)."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def contributions(tf: np.ndarray, lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The part of a term's score that doesn't depend on its weight, in whole numbers."""
    wide = 25 * n_docs * int(lengths.max(initial=0)) >= 1 << 63
    m = 75 + ((25 * lengths.astype(object) * n_docs) // max(1, total)).astype(np.int64) if wide else 75 + (25 * lengths * n_docs) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _searcher(asked, n_docs: int, total: int, top: int):
    """Search the blocks of a partition for every query; ``asked`` has for each query its terms, their weights (times repeats), and the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, size = asked.value
        weight = np.zeros(size + 1, np.int64)
        best: list[list[tuple]] = [[] for _ in queries]  # heaps of (score, -doc_id), the worst first
        for b in batches:
            col = {n: _flat(b.column(n)) for n in ("lengths", "ends", "terms", "counts")}
            ids = b.column("ids").flatten().to_pylist()
            per_doc, doc_from = col["ends"]
            per_doc, (terms, entry_from) = per_doc.astype(np.int64), col["terms"]
            block_of_doc = np.repeat(np.arange(len(b)), np.diff(doc_from))
            doc_ends = per_doc + entry_from[block_of_doc]
            doc_starts = np.concatenate([[0], doc_ends[:-1]]).astype(np.int64)
            gain = contributions(col["counts"][0].astype(np.int64), np.repeat(col["lengths"][0], doc_ends - doc_starts), n_docs, total)
            block_of_entry = np.repeat(np.arange(len(b)), np.diff(entry_from))
            order = np.lexsort((-gain, block_of_entry, terms))  # maxima: the first of each (term, block)
            t, k = terms[order], block_of_entry[order]
            first = np.ones(len(order), bool)
            first[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
            max_term, max_block, max_gain = t[first], k[first], gain[order[first]]
            for number, (own, weights) in enumerate(queries):
                heap, bound = best[number], np.zeros(len(b), np.int64)
                lo, hi = np.searchsorted(max_term, own), np.searchsorted(max_term, own, "right")
                for i, j, w in zip(lo, hi, weights, strict=True):
                    bound[max_block[i:j]] += w * max_gain[i:j]
                weight[own] = weights
                for block in np.argsort(-bound, kind="stable"):
                    if bound[block] < (heap[0][0] if len(heap) == top else 1):
                        break
                    i, j = doc_from[block], doc_from[block + 1]
                    e = slice(entry_from[block], entry_from[block + 1])
                    scores = np.add.reduceat(weight[terms[e]] * gain[e], doc_starts[i:j] - entry_from[block])
                    for d in np.flatnonzero(scores >= (heap[0][0] if len(heap) == top else 1)):
                        x = (int(scores[d]), -math.inf if ids[i + d] is None else -ids[i + d])
                        if len(heap) < top:
                            heapq.heappush(heap, x)
                        elif x > heap[0]:
                            heapq.heapreplace(heap, x)
                weight[own] = 0
        found = [(q, None if at == -math.inf else -at, score) for q, heap in enumerate(best) for score, at in heap]
        if found:
            q, doc, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def _round(docs: DataFrame, ids: list, texts: list[str | None], top: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(texts)
    index = settle(docs.mapInArrow(_forward(spark.sparkContext.broadcast(vocabulary)), BLOCK_SCHEMA))
    sums = index.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    df = dict(index.select(F.explode(F.arrays_zip("block_terms", "block_docs")).alias("x")).groupBy("x.block_terms").agg(F.sum("x.block_docs").alias("df")).toLocalIterator())
    weights = {t: math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * n + 1))) for t, n in df.items()}
    queries = []
    for terms in vocabulary.of_text:
        own, repeats = np.unique(np.array([t for t in terms if t in weights], np.int64), return_counts=True)
        queries.append((own, np.array([weights[t] for t in own.tolist()], np.int64) * repeats))
    asked = spark.sparkContext.broadcast((queries, vocabulary.size))
    found = packed(index, sums["blocks"] * BLOCK_DOCS).mapInArrow(_searcher(asked, sums["n"], sums["length"], top), FOUND_SCHEMA)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {item_type}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # as many rows as queries of the round


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``top`` documents (doc_id, text) with the highest scores above 0 for each query (item_id, text): item_id, rank, doc_id, score."""
    item_type = queries.schema["item_id"].dataType.simpleString()
    asked = settle(queries.select("item_id", "text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    rounds = max(1, -(-size // query_bytes))
    dealt = asked.withColumn("__round", F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)))
    out = None
    for r in range(rounds):
        rows = dealt.where(F.col("__round") == r).select("item_id", "text").collect()  # about query_bytes of texts
        part = _round(docs.select(F.col("doc_id").cast("long"), "text"), [x[0] for x in rows], [x[1] for x in rows], top, item_type)
        out = part if out is None else out.unionByName(part)
    return out


def oracle() -> str:
    """DuckDB SQL for the rows of the registered query over ``documents`` and ``benchmark``."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH asked AS MATERIALIZED (
  SELECT q, item_id, unnest(regexp_extract_all({low}, '{term}')) AS term FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)
), asked_terms AS MATERIALIZED (
  SELECT q, any_value(item_id) AS item_id, term, count(*) AS repeats FROM asked GROUP BY q, term
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({low}, '{term}') AS terms FROM documents
), sums AS MATERIALIZED (
  SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0
), tf AS MATERIALIZED (
  SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY d, term
), weights AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), sums
), gains AS MATERIALIZED (
  SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms)::BIGINT * n) // total))) AS gain
  FROM tf JOIN docs USING (d) JOIN weights USING (term), sums
), scored AS (
  SELECT q, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id, sum(repeats * gain)::BIGINT AS score
  FROM asked_terms JOIN gains USING (term) GROUP BY q, d
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= {TOP}
"""
