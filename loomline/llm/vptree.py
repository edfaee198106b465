"""Approximate nearest neighbours by inner product: a vantage-point tree for each shard of the vectors.

A shard's vectors are cut into bands of about equal length, a tree each. There the largest inner product becomes the
nearest distance by one more coordinate: if the band's longest vector has length M, x becomes (x, sqrt(M^2 - |x|^2))
and a query is scaled to length M. Bands are searched from the longest on, with the k best so far. A node holds a vantage point and splits the rest at
the median distance. A child is left out for a query if the triangle inequality's lower bound, times `relax`, exceeds
the query's k-th distance so far: relax = 1 is exact search, more prunes more. The default is the largest whole number
whose recall was 0.95 or more on all tables measured (README). Equal vectors are one point, named after
their smallest id, and of equal scores the smaller name is kept, so ties go to smaller ids. Scores are inner products of
the original vectors in double precision.

Shards are cut by hash of the id, queries into blocks. A shard's trees are built once and written; a (shard, block) pair
is one task with bounded rows on both sides, which loads the shard's trees. Each gives k rows a query, ranked again over the shards.

Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; candidates are those
of the query's own length. Rows that repeat an id are candidates of their own, and queries of their own; a query leaves
out one row that has its id and its vector. Bands and queries are scaled by powers of two, which changes no tie, so components of any
size have distances and ranks; a score may still be too large for a double, then it is infinite. An empty table gives none.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise

TREES = "shard long, dim int, trees binary"
HIT = "node long, query_id long, vec_id long, score double, key double"


def best_of(score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k largest scores, largest first, of equal ones the smaller names."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        tied = np.flatnonzero((score >= edge).sum(axis=1) > k)  # more than k reach the k-th score
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        if len(tied):
            top[tied] = np.lexsort((name[tied], -score[tied]), axis=1)[:, :k]
        score, name = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    order = np.lexsort((name, -score), axis=1)
    return np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)


class VPTree:
    def __init__(self, points: np.ndarray, names: np.ndarray, leaf: int = 256, seed: int = 5, unit: float = 1.0):
        """points: distinct, float64, of lengths near one; names: their numbers in the shard, which search gives back; unit: of scores."""
        self.unit = unit
        norm = np.einsum("ij,ij->i", points, points)
        self.top = float(np.sqrt(norm.max())) if len(points) else 0.0
        lifted = np.c_[points, np.sqrt(np.maximum(self.top**2 - norm, 0))]
        rng, order = np.random.default_rng(seed), np.arange(len(points))
        self.nodes: list[tuple] = []
        self.root = self._build(lifted, order, 0, len(order), leaf, rng) if len(order) else None
        self.raw, self.names = points[order], names[order]  # a leaf's points stand together

    def _build(self, x: np.ndarray, order: np.ndarray, lo: int, hi: int, leaf: int, rng: np.random.Generator) -> int:
        """A leaf is (lo, hi); an inner node (vantage, inside, outside, near and far distance of each)."""
        if hi - lo <= leaf:
            self.nodes.append((lo, hi))
            return len(self.nodes) - 1
        own = order[lo:hi]
        vantage = x[own[rng.integers(len(own))]]
        far = np.sqrt(np.maximum(((x[own] - vantage) ** 2).sum(axis=1), 0))
        half = len(own) // 2
        part = np.argpartition(far, half)
        order[lo:hi], far = own[part], far[part]
        bounds = (far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max())
        kids = self._build(x, order, lo, lo + half, leaf, rng), self._build(x, order, lo + half, hi, leaf, rng)
        self.nodes.append((vantage, *kids, *bounds))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, best: np.ndarray, score: np.ndarray, relax: float) -> int:
        """Improves best (rows; -1: none) and score (inner products), k columns each; gives the products it took."""
        self.best, self.score, self.visited, self.relax, self.q = best, score, 0, relax, queries
        if self.root is not None:
            self.scale = self.top / np.sqrt(np.einsum("ij,ij->i", queries, queries))
            self.lift = np.c_[queries * self.scale[:, None], np.zeros(len(queries))]
            who = np.arange(len(queries))
            # no inner product exceeds the product of the lengths
            self._visit(self.root, who[self.top**2 / self.scale * (1 + 1e-9) >= self.score[:, -1] / self.unit])
        return self.visited

    def _reach(self, who: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, with room for rounding."""
        return np.sqrt(np.maximum(2 * self.top**2 - 2 * self.scale[who] * (self.score[who, -1] / self.unit), 0)) + 1e-9 * self.top

    def _visit(self, node: int, who: np.ndarray) -> None:
        if not len(who):
            return
        at = self.nodes[node]
        if len(at) == 2:
            raw, names = self.raw[at[0] : at[1]], self.names[at[0] : at[1]]
            self.visited += len(raw) * len(who)
            got = np.c_[self.score[who], self.q[who] @ raw.T * self.unit]
            names = np.c_[self.best[who], np.broadcast_to(names, (len(who), len(names)))]
            self.score[who], self.best[who] = best_of(got, names, self.best.shape[1])
            return
        vantage, inside, outside, in_lo, in_hi, out_lo, out_hi = at
        d = np.sqrt(np.maximum(2 * self.top**2 - 2 * (self.lift[who] @ vantage), 0))
        least_in, least_out = np.maximum(np.maximum(in_lo - d, d - in_hi), 0), np.maximum(np.maximum(out_lo - d, d - out_hi), 0)
        first = np.where(least_in == least_out, d <= (in_hi + out_lo) / 2, least_in < least_out)
        self._visit(inside, who[first])
        self._visit(outside, who[~first])
        open_ = lambda side, least: side & (least * self.relax <= self._reach(who))
        self._visit(outside, who[open_(first, least_out)])
        self._visit(inside, who[open_(~first, least_in)])


class Bands:
    """A shard's trees, over bands of length; neighbours differ by a tenth. ids: of each point its ids, ascending, end to end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        order = np.argsort(ids, kind="stable")
        x = vectors[order]
        _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        turn = np.argsort(first)  # points are numbered by their smallest ids
        number = np.empty(len(turn), np.int64)
        number[turn] = np.arange(len(turn))
        which = number[which.ravel()]
        self.ids, self.starts = ids[order][np.argsort(which, kind="stable")], np.r_[0, np.cumsum(np.bincount(which, minlength=len(turn)))]
        self.points = x[first[turn]]
        most = np.abs(self.points).max(axis=1, initial=0)
        unit = self.points / most[:, None]
        long = np.log2(most) + np.log2(np.einsum("ij,ij->i", unit, unit)) / 2  # of the lengths, whose squares may not be numbers
        band = np.round(long / np.log2(1.1)).astype(np.int64)
        power = np.round(band * np.log2(1.1)).astype(np.int64)
        self.trees = []
        for b in np.unique(band)[::-1]:
            own = np.flatnonzero(band == b)
            self.trees.append(VPTree(np.ldexp(self.points[own], -power[own[0]]), own, leaf, unit=float(np.ldexp(1.0, power[own[0]] - power.max()))))

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64), np.full((len(queries), k), -np.inf)
        queries = np.ldexp(queries, -np.frexp(np.abs(queries).max(axis=1, keepdims=True, initial=0))[1])  # any factor keeps a query's order
        self.visited = sum(t.search(queries, best, score, relax) for t in self.trees)
        return best, score

    def hits(self, own: int, query: np.ndarray, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, scores and keys (the score by a power of two, of an order where scores have none) of the query's k best: its points' ids without its own."""
        best = best[best < len(self.points)]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = np.einsum("j,ij->i", query, self.points[best])
        key = np.einsum("j,ij->i", np.ldexp(query, -np.frexp(np.abs(query).max())[1]), np.ldexp(self.points[best], -len(query).bit_length()))
        each = [self.ids[self.starts[p] : min(self.starts[p] + k + 1, self.starts[p + 1])] for p in best]
        for i, p in enumerate(best):
            if (self.points[p] == query).all() and len(self_ := np.flatnonzero(each[i] == own)):
                each[i] = np.delete(each[i], self_[0])
        n = [len(o) for o in each]
        score, key, ids = np.repeat(exact, n), np.repeat(key, n), np.concatenate([np.zeros(0, np.int64), *each])
        pick = np.lexsort((ids, -key))[:k]
        return ids[pick], score[pick], key[pick]


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def _build(leaf: int):
    def run(key: tuple[pa.Scalar, ...], vectors: pa.Table) -> pa.Table:
        shard, dim = (x.as_py() for x in key)
        trees = pickle.dumps(Bands(vectors.column("id").to_numpy(), _matrix(vectors.column("v")), leaf), protocol=5)
        return pa.table([pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), pa.array([trees], pa.binary())], names=["shard", "dim", "trees"])

    return run


def _search(k: int, relax: float):
    def run(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = [(none, none, none, none.astype(float), none.astype(float))]
        if queries.num_rows and shard.num_rows:
            bands = pickle.loads(shard.column("trees")[0].as_py())  # noqa: S301  our own, from _build
            own, node, q = queries.column("id").to_numpy(), queries.column("node").to_numpy(), _matrix(queries.column("v"))
            for lo in range(0, len(own), 1024):
                best, _ = bands.search(q[lo : lo + 1024], k + 1, relax)
                for i, row in enumerate(best):
                    hits = bands.hits(own[lo + i], q[lo + i], row, k)
                    out.append((np.full(len(hits[0]), node[lo + i]), np.full(len(hits[0]), own[lo + i]), *hits))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "query_id", "vec_id", "score", "key"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>, dim) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _copies(df: DataFrame, col: str, n: int) -> DataFrame:
    """A row for each of the n values of col."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def build_index(vectors: DataFrame, shard_rows: int = 16384, leaf: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", path: str | None = None) -> DataFrame:
    """shard, dim, trees: a row a shard, written to path (a table kept for later searches), or to the shared folder."""
    x = usable(vectors, id_col, vec_col)
    shards = max(1, -(-vectors.count() // shard_rows))
    trees = x.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).groupBy("shard", "dim").applyInArrow(_build(leaf), TREES)
    if path is None:
        return materialise(trees, "vp-trees")
    trees.write.parquet(path)
    return open_index(vectors.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREES).parquet(path)


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, relax: float = 6.0, block_rows: int = 16384, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k nearest found, itself left out."""
    q = materialise(usable(queries, id_col, vec_col).withColumn("node", F.monotonically_increasing_id()), "queries")
    blocks, shards = max(1, -(-queries.count() // block_rows)), (index.agg(F.max("shard")).first()[0] or 0) + 1
    q = _copies(q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "shard", shards)
    at = ["shard", "block", "dim"]
    hits = q.groupBy(*at).cogroup(_copies(index, "block", blocks).groupBy(*at)).applyInArrow(_search(k, relax), HIT)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("key").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = 6.0, shard_rows: int = 16384, block_rows: int = 16384, leaf: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """build_index() and search_index() in one call."""
    return search_index(build_index(vectors, shard_rows, leaf, id_col, vec_col), queries, k, relax, block_rows, id_col, vec_col)
