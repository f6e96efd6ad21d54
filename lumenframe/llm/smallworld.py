"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by a hash of their id, about ``SHARD_ROWS`` to each.  One task grows the graph of one shard by
insertion: a block of nodes descends the levels that stand, searches its neighbours with a beam, keeps diverse ones, and is
linked back.  The graph is stored as flat neighbour arrays, one row per shard.  Queries go to every shard in groups; each
(shard, group) is one task's work, and the best of all shards are merged by a window.

Nearness is the inner product.  Vectors of unequal length get one more component that brings all of a shard to one norm, so
the largest product is the nearest point; queries have zero there.  The graph is walked in single precision; what it
finds is scored again on the original vectors in double precision, from the first component to the last.

Cases: null, zero, or not wholly finite vectors take no part, nor do rows without an id.  Of rows with the same id the smallest vector
counts.  A shorter vector counts as if followed by zeros.  Equal vectors are one node of the graph, so their number doesn't matter to
it.  Other columns are neither read nor kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.tables import settle

#: Links of a node on the upper levels and on the lowest.
LINKS, BASE_LINKS = 16, 32
#: Width of the beam while the graph grows and while it is searched.
BUILD_BEAM, SEARCH_BEAM = 64, 128
#: Vectors of a shard and queries of a group, about; and bytes of a shard's vectors, which lower the former for wide vectors.
SHARD_ROWS, QUERY_GROUP, SHARD_BYTES = 8192, 4096, 32 << 20
#: Nodes inserted or queries searched together, at most, and the numbers that one step may gather.
BLOCK, GATHERED = 256, 1 << 24
#: Candidates that are expanded in one step of a beam.
STEP = 4
TOP, QUERY_STEP = 20, 20
#: Stands for zero where a division follows.
TINY = float(np.finfo(np.float64).tiny)

INDEX_SCHEMA = "shard int, nodes int, dim int, vectors binary, member_ends binary, members binary, level_nodes array<int>, links binary"
FOUND_SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    """Whether a vector takes part: there, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def same_norm(x: np.ndarray) -> np.ndarray:
    """Unit rows in single precision: each row over the largest norm, and the component that it lacks to 1."""
    x = x / max(np.abs(x).max(initial=0), TINY)
    square = np.einsum("ij,ij->i", x, x)
    most = max(square.max(initial=0), TINY)
    rest = np.sqrt(np.maximum(0, 1 - square / most))
    return np.column_stack([x / math.sqrt(most), rest]).astype(np.float32)


def block_rows(dim: int, width: int) -> int:
    """Rows whose ``width`` vectors each are gathered at once."""
    return max(1, min(BLOCK, GATHERED // max(1, width * dim)))


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes reached from ``start`` (one row of nodes per query), best first: nodes (-1: none) and their products.

    Every query has its list of the best nodes seen; the best ones not yet expanded give their neighbours, until all in the list are expanded.
    """
    rows, n = len(q), len(links)
    seen = np.full((rows, n), -1, np.int32)
    nodes = np.full((rows, width), -1, np.int64)
    near = np.full((rows, width), -np.inf, np.float32)
    done = np.ones((rows, width), bool)
    row, node = np.repeat(np.arange(rows), start.shape[1]), start.ravel()
    live = np.arange(rows)
    while True:
        row, node = row[node >= 0], node[node >= 0]
        fresh = seen[row, node] == -1
        row, node = row[fresh], node[fresh]
        order = np.arange(len(row), dtype=np.int32)
        seen[row, node] = order
        first = seen[row, node] == order
        row, node = row[first], node[first]
        score = np.einsum("ij,ij->i", x[node], q[row])
        better = score > near[row, -1]
        row, node, score = row[better], node[better], score[better]
        if len(row):
            live, at, count = np.unique(row, return_inverse=True, return_counts=True)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            wide = width + int(count.max())
            all_nodes, all_near, all_done = np.full((len(live), wide), -1, np.int64), np.full((len(live), wide), -np.inf, np.float32), np.zeros((len(live), wide), bool)
            all_nodes[:, :width], all_near[:, :width], all_done[:, :width] = nodes[live], near[live], done[live]
            all_nodes[at, width + place], all_near[at, width + place] = node, score
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            nodes[live], near[live] = np.take_along_axis(all_nodes, best, 1), np.take_along_axis(all_near, best, 1)
            done[live] = np.take_along_axis(all_done, best, 1)
        open_ = ~done & (nodes >= 0)
        chosen = open_ & (np.cumsum(open_, axis=1) <= STEP)
        row, column = np.nonzero(chosen)
        if not len(row):
            return nodes, near
        done[row, column] = True
        out = links[nodes[row, column]]
        row, node = np.repeat(row, out.shape[1]), out.ravel()


def diverse(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) up to ``most`` that are nearer to the row's own point than to any kept before; free places go to the best of the rest."""
    rows, width = nodes.shape
    step = max(1, GATHERED // max(1, width * (width + x.shape[1])))
    if rows > step:
        return np.concatenate([diverse(x, nodes[i : i + step], near[i : i + step], most) for i in range(0, rows, step)])
    points = x[np.maximum(nodes, 0)]
    between = points @ points.transpose(0, 2, 1)
    closest = np.full((rows, width), -np.inf, np.float32)
    kept, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for j in range(width):
        take = (nodes[:, j] >= 0) & (count < most) & (closest[:, j] < near[:, j])
        kept[:, j] = take
        count += take
        closest[take] = np.maximum(closest[take], between[take, :, j])
    rank = np.where(nodes >= 0, np.where(kept, 0, 1), 2) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(nodes, order, 1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the links from chosen neighbours to the new nodes; lists that are too long keep diverse ones."""
    most = links.shape[1]
    source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    near = np.einsum("ij,ij->i", x[source], x[target])
    order = np.lexsort((-near, target))
    source, target = source[order], target[order]
    ends, at, count = np.unique(target, return_inverse=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(np.cumsum(count) - count, count)
    extra = np.full((len(ends), min(int(count.max(initial=0)), most)), -1, np.int64)
    fits = place < extra.shape[1]
    extra[at[fits], place[fits]] = source[fits]
    extra[(links[ends][:, :, None] == extra[:, None, :]).any(axis=1)] = -1  # nodes of one block may have chosen each other
    both = np.concatenate([links[ends], extra], axis=1)
    near = np.full(both.shape, -np.inf, np.float32)
    row, column = np.nonzero(both >= 0)
    for i in range(0, len(row), step := max(1, GATHERED // x.shape[1])):
        r, c = row[i : i + step], column[i : i + step]
        near[r, c] = np.einsum("ij,ij->i", x[both[r, c]], x[ends[r]])
    order = np.argsort(-near, axis=1, kind="stable")
    both, near = np.take_along_axis(both, order, 1), np.take_along_axis(near, order, 1)
    full = both.shape[1] > most and (both[:, most:] >= 0).any(axis=1)
    kept = both[:, :most].copy()
    if np.any(full):
        kept[full] = diverse(x, both[full], near[full], most)
    links[ends, : kept.shape[1]] = kept


def grow(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Neighbour arrays of the levels, lowest first.  Nodes are in order of their level, so those of a level are the first rows of ``x``.

    A node is on level l with probability LINKS**-l, drawn by ``seed``: the number of nodes of a level is drawn, as the order of the rows is.
    """
    n = len(x)
    level = np.sort(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(np.int64))[::-1]
    levels = [np.full((int((level >= k).sum()), LINKS if k else BASE_LINKS), -1, np.int64) for k in range(int(level[0]) + 1)] if n else []
    at, most_rows = 1, block_rows(x.shape[1], STEP * BASE_LINKS)
    while at < n:
        own = int(level[at])
        until = min(at + min(most_rows, at), int(np.searchsorted(-level, -own, "right")))
        new = np.arange(at, until)
        q, start = x[new], np.zeros((len(new), 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            there = min(at, len(levels[k]))  # nodes of this level that are linked already
            nodes, near = beam(x, levels[k][:there], q, start, BUILD_BEAM if k <= own else 1)
            if k <= own:
                among = q @ q.T
                np.fill_diagonal(among, -np.inf)
                most = levels[k].shape[1]
                best = np.argsort(-among, axis=1, kind="stable")[:, :most]
                own_near = np.take_along_axis(among, best, 1)
                all_nodes, all_near = np.concatenate([nodes, np.where(np.isneginf(own_near), -1, new[best])], 1), np.concatenate([near, own_near], 1)
                order = np.argsort(-all_near, axis=1, kind="stable")[:, :BUILD_BEAM]
                chosen = diverse(x, np.take_along_axis(all_nodes, order, 1), np.take_along_axis(all_near, order, 1), LINKS)
                levels[k][new, :LINKS] = chosen
                link_back(x, levels[k], new, chosen)
            start = nodes
        at = until
    return levels


def find(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, width: int) -> np.ndarray:
    """Nodes near each query, best first (-1: none): the best node of each upper level leads to the next, the lowest is searched with the whole beam."""
    start = np.zeros((len(q), 1), np.int64)
    for links in levels[:0:-1]:
        start, _ = beam(x, links, q, start, 1)
    return beam(x, levels[0], q, start, width)[0]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    values = np.asarray(column.flatten(), dtype=kind)
    out = np.zeros((len(column), int(sizes.max(initial=0))), dtype=kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _index_of(kind: str):
    def build(key: tuple, t: pa.Table) -> pa.Table:
        ids, x = t["vec_id"].to_numpy(), _matrix(t["vector"], kind)
        order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids)
        ids, x = ids[order], x[order]
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        ids, x = ids[first], x[first] + 0  # no negative zeros, so that equal vectors have equal bytes
        _, node, node_of = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        seed = int(key[0].as_py())
        drawn = np.random.default_rng(seed).permutation(len(node))  # node number of each distinct vector
        node_of, vectors = drawn[node_of], np.empty((len(node), x.shape[1]), kind)
        vectors[drawn] = x[node]
        members = np.lexsort((ids, node_of))
        levels = grow(same_norm(vectors.astype(np.float64)), seed)
        links = b"".join(v.astype("<i4").tobytes() for v in levels)
        ends = np.cumsum(np.bincount(node_of, minlength=len(node)))
        row = {"shard": seed, "nodes": len(node), "dim": x.shape[1], "vectors": vectors.tobytes(), "member_ends": ends.astype("<i8").tobytes(), "members": ids[members].astype("<i8").tobytes(), "level_nodes": [len(v) for v in levels], "links": links}
        types = {"shard": pa.int32(), "nodes": pa.int32(), "dim": pa.int32(), "level_nodes": pa.list_(pa.int32())}
        return pa.table({k: pa.array([v], types.get(k, pa.binary())) for k, v in row.items()})

    return build


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its distinct vectors, the ids of each, and its graph.  Settled."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    kind = _kind(vectors, vector_col)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("dim")).first()
    most = max(1, min(shard_rows, SHARD_BYTES // (size["dim"] * np.dtype(kind).itemsize)))
    shards = max(1, -(-size["n"] // most))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return settle(dealt.groupBy("shard").applyInArrow(_index_of(kind), INDEX_SCHEMA))


def _kind(vectors: DataFrame, vector_col: str) -> str:
    return "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"


def _searcher(kind: str, query_kind: str, top: int, width: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and queries.num_rows:
            g = index.to_pylist()[0]
            vectors = np.frombuffer(g["vectors"], kind).reshape(g["nodes"], g["dim"])
            ends, members = np.frombuffer(g["member_ends"], "<i8"), np.frombuffer(g["members"], "<i8")
            starts, flat, levels, at = np.concatenate([[0], ends[:-1]]), np.frombuffer(g["links"], "<i4"), [], 0
            for k, n in enumerate(g["level_nodes"]):
                levels.append(flat[at : at + n * (LINKS if k else BASE_LINKS)].reshape(n, -1))
                at += levels[-1].size
            x = same_norm(vectors.astype(np.float64))
            ids, q = queries["query_id"].to_numpy(), _matrix(queries["vector"], query_kind)
            q = np.pad(q, ((0, 0), (0, max(0, g["dim"] - q.shape[1]))))[:, : g["dim"]].astype(np.float64)
            step = block_rows(g["dim"], STEP * BASE_LINKS)
            for i in range(0, len(ids), step):
                found.append(_best(ids[i : i + step], q[i : i + step], x, vectors, levels, starts, ends, members, top, width))
        parts = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, parts), strict=True)))

    return run


def _best(ids, q, x, vectors, levels, starts, ends, members, top: int, width: int):
    """The best ``top`` members for each query of a block, without the query itself: query ids, ids, scores."""
    unit = q / np.maximum(TINY, np.abs(q).max(axis=1, initial=0))[:, None]
    unit /= np.maximum(TINY, np.linalg.norm(unit, axis=1))[:, None]
    nodes = find(x, levels, np.column_stack([unit, np.zeros(len(q))]).astype(np.float32), max(width, top + 1))[:, : 2 * (top + 1)]
    row, column = np.nonzero(nodes >= 0)
    node = nodes[row, column]
    score = np.zeros(len(row))
    for j in range(q.shape[1]):  # in this order everywhere, so that equal vectors have equal scores in every shard
        score += q[row, j] * vectors[node, j].astype(np.float64)
    count = np.minimum(ends[node] - starts[node], top + 1)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    row, score, member = np.repeat(row, count), np.repeat(score, count), members[np.repeat(starts[node], count) + inner]
    other = member != ids[row]
    row, score, member = row[other], score[other], member[other]
    order = np.lexsort((member, -score, row))
    row, score, member = row[order], score[order], member[order]
    count = np.bincount(row, minlength=len(q))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) < top
    return ids[row[keep]], member[keep], score[keep]


def search(index: DataFrame, queries: DataFrame, index_kind: str, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, width: int = SEARCH_BEAM) -> DataFrame:
    """The ``top`` nearest found for each query: query_id, rank, vec_id, score.  ``queries`` have one vector per id."""
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).where(F.col("query_id").isNotNull() & usable("vector"))
    asked = settle(asked.groupBy("query_id").agg(F.min("vector").alias("vector")))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    numbers = index.agg(F.coalesce(F.max("shard"), F.lit(0)).alias("n")).first()["n"]
    copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(numbers))))
    run = _searcher(index_kind, _kind(queries, vector_col), top, width)
    found = copies.groupBy("shard", "group").cogroup(sent.groupBy("shard", "group")).applyInArrow(run, FOUND_SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, width: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``top`` nearest rows found for each row with ``is_query`` (ids divisible by ``QUERY_STEP``) among all other rows."""
    index = build_index(vectors, id_col, vector_col, shard_rows)
    asked = vectors.where(F.col(id_col) % QUERY_STEP == 0 if is_query is None else is_query)
    return search(index, asked, _kind(vectors, vector_col), id_col, vector_col, top, width)
