"""Hard negatives by a vector-approximation file: cells of each dimension first, vectors only where the cells leave it open.

Vectors become integers, floor(scale * x). A shard's rows are stored with a second, coarse form: each dimension is cut
into 2^bits cells of equal width, a row is its cells' numbers. For an anchor a table gives, for each dimension and
cell, the least product there; a row's lower bound is the sum of 64 looked-up numbers, and the upper bound lies a constant above,
as cells have one width. Exactly scored are only

- for positives, rows of the anchor's label whose upper bound reaches the k-th lower bound;
- for negatives, rows of other labels whose bounds meet a positive's window and whose upper bound reaches the lower bound of
  the k-th row sure to be inside.

Shards are cut by row number and anchors into blocks; a (shard, block) pair is one task with bounded rows on both sides.
Each gives at most k rows an anchor or window, ranked again over the shards. Equal vectors of one label are one point
with many ids, so copies cost one bound. Scores are whole numbers, ties go to the smaller id, then the row's number.

No part take rows with a null id or label, a null vector, a null or non-finite component, or one so large that 100 times
a score would not fit into a long. Rows of other length than the anchor's are no candidates. Rows that repeat an id are rows
of their own, each a candidate and, if its id is, an anchor. An empty table gives no rows; only id, label and vector are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FILES = "shard long, dim int, file binary"
POSITIVE = "node long, anchor_id long, positive_id long, row long, score long"
NEGATIVE = "node long, anchor_id long, turn int, positive_id long, positive_score long, negative_id long, row long, negative_score long"
LEAST = np.iinfo(np.int64).min


class VAFile:
    """A shard's points (distinct label and vector), ordered by label, as cells and as vectors; ids and rows of each point, ascending."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bits: int = 6):
        order = np.lexsort((rows, ids))
        whole = np.c_[labels, vectors][order]
        points, which = np.unique(whole, axis=0, return_inverse=True)
        which = which.ravel()
        by = np.argsort(which, kind="stable")
        self.ids, self.rows, self.starts = ids[order][by], rows[order][by], np.r_[0, np.cumsum(np.bincount(which, minlength=len(points)))]
        self.labels, self.points = points[:, 0], np.ascontiguousarray(points[:, 1:])
        least = self.points.min(axis=0)
        self.width = (self.points.max(axis=0) - least) // (1 << bits) + 1
        self.codes = ((self.points - least) // self.width).T.astype(np.uint8 if bits <= 8 else np.uint16, order="C")
        self.edges = least[:, None] + self.width[:, None] * np.arange(1 << bits)  # the least value of each cell
        if max(abs(int(self.points.min(initial=0))), abs(int(self.points.max(initial=0)))) < 1 << 31:
            self.points = self.points.astype(np.int32)

    def bounds(self, anchor: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, int]:
        """Lower bounds of the points lo .. hi - 1, and how far the upper bounds lie above."""
        table = np.minimum(anchor[:, None] * self.edges, anchor[:, None] * (self.edges + self.width[:, None] - 1))
        low = np.zeros(hi - lo, np.int64)
        for own, cells in zip(table, self.codes[:, lo:hi], strict=True):
            low += own[cells]
        return low, int((np.abs(anchor) * (self.width - 1)).sum())

    def exact(self, anchor: np.ndarray, points: np.ndarray) -> np.ndarray:
        return self.points[points].astype(np.int64) @ anchor

    def members(self, points: np.ndarray, score: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, rows, scores of the k best of the points' members, the row `own` left out."""
        first = self.starts[points]
        n = np.minimum(self.starts[points + 1] - first, k + 1)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        ids, rows, score = self.ids[at], self.rows[at], np.repeat(score, n)
        ids, rows, score = ids[rows != own], rows[rows != own], score[rows != own]
        pick = np.lexsort((rows, ids, -score))[:k]
        return ids[pick], rows[pick], score[pick]

    def of_label(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.labels, [label, label + 1]))

    def positives(self, anchor: np.ndarray, label: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = self.of_label(label)
        low, slack = self.bounds(anchor, lo, hi)
        edge = np.partition(low, -(k + 1))[-(k + 1)] if len(low) > k else LEAST  # one more: the anchor's own point
        open_ = lo + np.flatnonzero(low + slack >= edge)
        self.scored = len(open_)
        return self.members(open_, self.exact(anchor, open_), k, own)

    def negatives(self, anchor: np.ndarray, label: int, windows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each (least, greatest) score the k best rows of other labels inside."""
        low, slack = self.bounds(anchor, 0, len(self.points))
        lo, hi = self.of_label(label)
        other = np.ones(len(low), bool)
        other[lo:hi] = False
        open_ = np.zeros(len(low), bool)
        for least, most in windows:
            inside = low[other & (low >= least) & (low + slack <= most)]
            edge = max(least, np.partition(inside, -k)[-k]) if len(inside) >= k else least
            open_ |= other & (low + slack >= edge) & (low <= most)
        at = np.flatnonzero(open_)
        score, self.scored = self.exact(anchor, at), len(at)
        fits = [(score >= least) & (score <= most) for least, most in windows]
        return [self.members(at[f], score[f], k, -1) for f in fits]


def window(score: np.ndarray, low: int, high: int) -> np.ndarray:
    """(least, greatest) whole number n with low * score <= 100 * n <= high * score."""
    return np.stack([-(-low * score // 100), high * score // 100], axis=-1)


def _whole(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = pa.concat_arrays([c.flatten() for c in flat.chunks]) if isinstance(flat, pa.ChunkedArray) else flat.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


def _file(bits: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, dim = (x.as_py() for x in key)
        ids, number, labels = (rows.column(c).to_numpy() for c in ("id", "row", "label"))
        file = pickle.dumps(VAFile(ids, number, labels, _whole(rows.column("v"), dim), bits), protocol=5)
        return pa.table([pa.array([shard], pa.int64()), pa.array([dim], pa.int32()), pa.array([file], pa.binary())], names=["shard", "dim", "file"])

    return run


def _loaded(anchors: pa.Table, shard: pa.Table) -> Iterator[tuple]:
    """The file, and number, id, label, vector, turn in the table of each anchor."""
    if anchors.num_rows and shard.num_rows:
        file = pickle.loads(shard.column("file")[0].as_py())  # noqa: S301  our own, from _file
        v = _whole(anchors.column("v"), shard.column("dim")[0].as_py())
        for i, own in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("row", "id", "label")), strict=True)):
            yield file, *own, v[i], i


def _table(schema: str, parts: list[tuple]) -> pa.Table:
    kinds = [x.split() for x in schema.split(", ")]
    kinds = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in kinds])
    none = [tuple(np.zeros(0, np.int64) for _ in kinds)]
    return pa.table([pa.array(np.concatenate(c)).cast(k.type) for c, k in zip(zip(*(none + parts), strict=True), kinds, strict=True)], schema=kinds)


def _positives(k: int):
    def run(key, anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out = []
        for file, own, name, label, vector, _ in _loaded(anchors, shard):
            ids, rows, score = file.positives(vector, label, own, k)
            out.append((np.full(len(ids), own), np.full(len(ids), name), ids, rows, score))
        return _table(POSITIVE, out)

    return run


def _negatives(k: int, low: int, high: int):
    def run(key, anchors: pa.Table, shard: pa.Table) -> pa.Table:
        out = []
        for file, own, name, label, vector, i in _loaded(anchors, shard):
            found = anchors.column("positives")[i].as_py()
            windows = window(np.array([p["score"] for p in found], np.int64), low, high)
            for turn, (p, (ids, rows, score)) in enumerate(zip(found, file.negatives(vector, label, windows, k), strict=True)):
                one = [np.full(len(ids), x, np.int64) for x in (own, name, turn, p["positive_id"], p["score"])]
                out.append((*one, ids, rows, score))
        return _table(NEGATIVE, out)

    return run


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(id, label, v array<bigint>, dim) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("d"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("d").isNotNull())
    rows = rows.where(~F.exists("d", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    most = F.sqrt(F.lit((2.0**63 - 1) / 101) / F.greatest(F.size("d"), F.lit(1)))
    rows = rows.where(~F.exists("d", lambda x: F.abs(x * scale) + 1 > most))
    return rows.select("id", "label", F.transform("d", lambda x: F.floor(x * scale)).alias("v"), F.size("d").alias("dim"))


def _copies(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.withColumn(col, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def _first(hits: DataFrame, by: list[str], order: list[Column | str], k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, bits: int = 6,
    shard_rows: int = 16384, block_rows: int = 4096, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (`anchor`: a condition on the
    column `id`) and each of its best rows of the same label, the best rows of other labels that score `low` to `high` per cent of it."""
    rows = materialise(whole_vectors(vectors, scale, id_col, label_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "whole-vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    files = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard", "dim").applyInArrow(_file(bits), FILES)
    files = materialise(files, "va-files")
    chosen = rows.where(anchor)
    blocks = max(1, -(-chosen.count() // block_rows))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    at, stored = ["shard", "block", "dim"], _copies(files, "block", blocks)

    def searched(asked: DataFrame, search, schema: str) -> DataFrame:
        return _copies(asked, "shard", shards).groupBy(*at).cogroup(stored.groupBy(*at)).applyInArrow(search, schema)

    found = _first(searched(chosen, _positives(positives), POSITIVE), ["node"], [F.col("score").desc(), "positive_id", "row"], positives)
    found = found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("positives"))
    asked = materialise(chosen.join(found.withColumnRenamed("node", "row"), "row"), "anchors")
    hits = searched(asked, _negatives(negatives, low, high), NEGATIVE)
    out = _first(hits, ["node", "turn"], [F.col("negative_score").desc(), "negative_id", "row"], negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
