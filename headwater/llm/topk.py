"""Exact top-k by inner product with two cover trees.

Rows go into blocks by a hash of their id, and each block gets a cover tree: a node has a centre, a covering radius and
children whose centres are apart. Queries get trees too. A pair of a query block and a data block is searched in one task: a
pair of nodes is left when even the largest inner product that their centres and radii allow is below the worst kth score of
the node's queries. Scores start from a bound that a bounded sample of rows gives; it only prunes. All is integer arithmetic,
so ties are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as c

#: Vectors of a data block and of a query block, about.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Vectors of a leaf at most, unless they are equal; the radius of a child against its parent's.
LEAF, SHRINK = 64, 0.7
#: Rows, those with the least hash, that give each query a first bound: a limit of that sample, not of the search.
SAMPLE = 2048
STEP = 1024
#: Products below this are exact in doubles.
EXACT = float(1 << 53)


def packed(groups: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Groups too small to be worth a node of their own share one, under the first one's centre; the node's radius covers them all."""
    out: list[tuple[int, list]] = []
    for at, g in groups:
        if out and len(g) < LEAF // 2 and sum(map(len, out[-1][1])) < LEAF // 2:
            out[-1][1].append(g)
        else:
            out.append((at, [g]))
    return [(at, np.concatenate(g)) for at, g in out]


class Tree:
    """A cover tree over the rows of an array. order: rows so that a node's are start to end; child nodes stand next to each other."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        order = np.arange(n)
        norms = (points * points).sum(1)
        centre, radius, start, end, first, count = [], [], [], [], [], []

        def add(s: int, e: int, at: int) -> int:
            own = order[s:e]
            d = norms[own] + norms[at] - 2 * (points[own] @ points[at])
            centre.append(at)
            radius.append(float(np.sqrt(max(d.max(), 0.0))))
            start.append(s)
            end.append(e)
            first.append(0)
            count.append(0)
            return len(centre) - 1

        todo = [add(0, n, 0)] if n else []
        while todo:
            k = todo.pop()
            s, e, r = start[k], end[k], radius[k]
            if e - s <= LEAF or r == 0:
                continue
            rest = order[s:e]
            limit = (r * SHRINK) ** 2
            groups = []
            at = centre[k]
            while len(rest):
                d = norms[rest] + norms[at] - 2 * (points[rest] @ points[at])
                near = d <= limit
                near[np.flatnonzero(rest == at)] = True
                groups.append((at, rest[near]))
                rest = rest[~near]
                if len(rest):
                    at = rest[0]
            groups = packed(groups)
            if len(groups) == 1:
                continue
            order[s:e] = np.concatenate([g for _, g in groups])
            first[k], count[k] = len(centre), len(groups)
            for at, g in groups:
                todo.append(add(s, s + len(g), at))
                s += len(g)
        self.order = order
        self.centre, self.start, self.end, self.first, self.count = (np.array(x, np.int64) for x in (centre, start, end, first, count))
        self.radius = np.array(radius)
        self.length = np.sqrt(norms[self.centre]) if n else np.empty(0)

    def children(self, nodes: np.ndarray) -> np.ndarray:
        n = self.count[nodes]
        return np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(nodes) else nodes


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they are exact, else in 64-bit integers; beyond those, an error."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("inner products go beyond 64-bit integers")
    return a.astype(np.int64) @ b.T.astype(np.int64)


class Search:
    """Best k of a data block for each query of a query block."""

    def __init__(self, queries: dict, data: dict, k: int):
        self.q, self.d, self.k = queries["tree"], data["tree"], k
        self.q_ids, self.d_ids = queries["ids"], data["ids"]
        self.floor = queries["floor"].astype(float)  # a lower bound of the kth best score; no row below it can be among the best
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.q_ids)
        self.slack = 1e-9 * (1 + np.abs(self.q.points).max(initial=0) * np.abs(self.d.points).max(initial=0) * self.q.points.shape[1])
        self.done = 0
        if len(self.q_ids) and len(self.d_ids):
            self.visit(0, np.array([0]))

    def worst(self, node: int) -> float:
        return self.floor[self.q.order[self.q.start[node] : self.q.end[node]]].min()

    def pruned(self, node: int, nodes: np.ndarray) -> np.ndarray:
        """Data nodes that may hold a score as good as the worst kth of the query node, the most promising first."""
        q, d = self.q, self.d
        at = q.centre[node]
        most = d.points[d.centre[nodes]] @ q.points[at] + q.radius[node] * d.length[nodes] + d.radius[nodes] * q.length[node] + q.radius[node] * d.radius[nodes]
        keep = most + self.slack >= self.worst(node)
        return nodes[keep][np.argsort(-most[keep], kind="stable")]

    def visit(self, node: int, nodes: np.ndarray) -> None:
        todo = [(node, nodes)]
        while todo:
            node, nodes = todo.pop()
            nodes = self.pruned(node, nodes)
            if not len(nodes):
                continue
            open_ones = self.d.count[nodes] > 0
            if self.q.count[node] and not (open_ones & (self.d.radius[nodes] > self.q.radius[node])).any():
                todo += [(int(x), nodes) for x in self.q.children(np.array([node]))]
            elif open_ones.any():
                todo.append((node, np.concatenate([nodes[~open_ones], self.d.children(nodes[open_ones])])))
            elif self.q.count[node]:
                todo += [(int(x), nodes) for x in self.q.children(np.array([node]))]
            else:
                self.scan(node, nodes)

    def scan(self, node: int, nodes: np.ndarray) -> None:
        rows = self.q.order[self.q.start[node] : self.q.end[node]]
        while len(nodes):
            size = np.cumsum(self.d.end[nodes] - self.d.start[nodes])
            n = max(1, int(np.searchsorted(size, STEP)))
            own = np.concatenate([self.d.order[self.d.start[x] : self.d.end[x]] for x in nodes[:n]])
            nodes = nodes[n:]
            scores = product(self.q.points[rows], self.d.points[own])
            self.done += scores.size
            ids = self.d_ids[own]
            good = scores >= self.floor[rows][:, None]
            good &= ids[None, :] != self.q_ids[rows][:, None]
            for i in np.flatnonzero(good.any(1)):
                r, g = rows[i], good[i]
                s, v = np.concatenate([self.best[r][0], scores[i][g]]), np.concatenate([self.best[r][1], ids[g]])
                top = np.lexsort((v, -s))[: self.k]
                self.best[r] = (s[top], v[top])
                if len(top) == self.k:
                    self.floor[r] = max(self.floor[r], float(s[top][-1]))
            if len(nodes):
                nodes = self.pruned(node, nodes)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, dim, v): floor(scale * x) of each component as a double; only rows with an id, and all components finite."""
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("x"))
    own = own.filter("id is not null and x is not null").filter(F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e)))
    return own.select("id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * scale).cast("double")).alias("v"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(column), dim)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row whose id is divisible by `every`; ties to the smaller id.

    Rows without an id, and vectors that are null or hold null or non-finite components, take no part; a query sees vectors
    of its own length only. Rows that share the query's id are its own; a repeated query row gives repeated results, a
    repeated candidate counts as often as it stands there. Other columns are not read.
    """
    rows = c.written(quantised(vectors, id_col, vector_col, scale), "vectors")
    n = rows.count()
    sample = [(r.id, r.dim, r.v) for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()]
    n_data, n_query = max(1, -(-n // BLOCK)), max(1, -(-n // every // QUERY_BLOCK))

    def built(table: pa.Table) -> tuple[int, dict]:
        dim = table.column("dim")[0].as_py()
        return dim, {"ids": np.asarray(table.column("id").combine_chunks(), np.int64), "tree": Tree(matrix(table.column("v"), dim))}

    def data_block(table: pa.Table) -> pa.Table:
        dim, out = built(table)
        return pa.table([pa.array([x], t) for x, t in ((dim, pa.int32()), (table.column("block")[0].as_py(), pa.int32()), (pickle.dumps(out, 5), pa.binary()))], names=["dim", "block", "tree"])

    def query_block(table: pa.Table) -> pa.Table:
        dim, out = built(table)
        own = [(i, v) for i, d, v in sample if d == dim]
        floor = np.full(len(out["ids"]), -np.inf)
        if len(own) > k:
            ids = np.array([i for i, _ in own], np.int64)
            scores = product(out["tree"].points, np.array([v for _, v in own], float).reshape(len(own), dim)).astype(float)
            scores[out["ids"][:, None] == ids[None, :]] = -np.inf
            floor = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k]
        out["floor"] = floor
        return pa.table([pa.array([x], t) for x, t in ((dim, pa.int32()), (table.column("query_block")[0].as_py(), pa.int32()), (pickle.dumps(out, 5), pa.binary()))], names=["dim", "query_block", "queries"])

    data = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_data)).cast("int")).groupBy("dim", "block").applyInArrow(data_block, "dim int, block int, tree binary")
    queries = rows.filter(F.col("id") % every == 0).withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_query)).cast("int")).groupBy("dim", "query_block").applyInArrow(query_block, "dim int, query_block int, queries binary")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_data - 1)))).withColumn("query", F.col("query_block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qb, q, d in zip(*b.columns, strict=True):
                queries_of = pickle.loads(q.as_py())
                best = Search(queries_of, pickle.loads(d.as_py()), k).best
                ids = queries_of["ids"]
                at = [(qb.as_py() << 32) | i for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array([s for s, _ in best], pa.list_(pa.int64())), pa.array([v for _, v in best], pa.list_(pa.int64()))], names=["at", "query_id", "scores", "ids"])

    pairs = queries.join(data, ["dim", "block"]).repartition(max(1, min(4096, n_data * n_query)), "query_block", "block").select((F.col("dim") * F.lit(1 << 20).cast("long") + F.col("query_block")).alias("q"), "queries", "tree")
    found = c.map_arrow(pairs, search, "at long, query_id long, scores array<long>, ids array<long>")
    flat = found.select("at", "query_id", F.explode(F.arrays_zip("scores", "ids")).alias("e")).select("at", "query_id", F.col("e.scores").alias("score"), F.col("e.ids").alias("vec_id"))
    order = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
