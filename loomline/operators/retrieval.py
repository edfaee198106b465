"""Exact retrieval by inner product, the index as a table, and the prompt context made of the hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_else, strip, truncate
from ..functions.vectors import dot, doubles, unit

#: Queries whose scores are held at a time, each against a shard.
STRIP = 256
HITS = "query_id long, id long, score double"
HEAD = "Passages found for this text:"
LINE = re.compile(r'\[\d+\] \(.*?\): "(.*)"', re.DOTALL)


def top_k(corpus: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One query: the k largest inner products, ties to the smaller id."""
    q = F.array(*map(F.lit, map(float, query)))
    hits = corpus.withColumn("score", dot(vec_col, q)).orderBy(F.col("score").desc(), id_col).limit(k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), id_col)))


def _blocks(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
    cut = F.pmod(F.xxhash64("id"), F.lit(n))
    return df.select("id", "v", cut.alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))


def best_rows(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k largest and their ids (of each row, or the same for all), largest first, ties to the smaller id."""
    k, ids = min(k, score.shape[1]), np.broadcast_to(ids, score.shape)
    if k < score.shape[1]:
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(score, top, 1).min(axis=1, initial=np.inf)
        for i in np.flatnonzero((score >= edge[:, None]).sum(axis=1) > k):  # a tie at the edge is settled among all it holds
            top[i] = np.lexsort((ids[i], -score[i]))[:k]
        score, ids = np.take_along_axis(score, top, 1), np.take_along_axis(ids, top, 1)
    order = np.lexsort((ids, -score), axis=1)
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _matrix(col: pa.Array, rows: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _streamed(x: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Few queries: they are broadcast, and the corpus is read where it lies, each task with the k best so far."""
    asked = q.collect()  # at most a block
    names, held = np.array([r.id for r in asked], np.int64), x.sparkSession.sparkContext.broadcast(np.array([r.v for r in asked], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        score, ids = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                v, own = _matrix(part.column("v"), part.num_rows), part.column("id").to_numpy()
                new = [best_rows(np.c_[score[at : at + STRIP], q[at : at + STRIP] @ v.T], np.c_[ids[at : at + STRIP], np.broadcast_to(own, (len(q[at : at + STRIP]), len(own)))], k) for at in range(0, len(q), STRIP)]
                score, ids = (np.concatenate(c) for c in zip(*new, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, ids.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel())], names=["query_id", "id", "score"])

    return x.mapInArrow(run, HITS)


def _blocked(x: DataFrame, q: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """Many: both sides are cut into blocks, and a pair of blocks is one matrix product."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        rows = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and vectors.num_rows:
            own, ids = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
            q, x = (_matrix(t.column("v").combine_chunks(), t.num_rows) for t in (queries, vectors))
            for lo in range(0, len(own), STRIP):
                score, found = best_rows(q[lo : lo + STRIP] @ x.T, ids, k)
                rows.append((np.repeat(own[lo : lo + STRIP], found.shape[1]), found.ravel(), score.ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=["query_id", "id", "score"])

    x, q = _blocks(x, "shard", n, "block", m), _blocks(q, "block", m, "shard", n)
    return q.groupBy("shard", "block").cogroup(x.groupBy("shard", "block")).applyInArrow(run, HITS)


def top_k_join(
    corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "vec_id", query_vec: str = "embedding", shard_rows: int = 16384, block_rows: int = 4096,
) -> DataFrame:
    """Many queries against the corpus: query_id, rank, id, score. Up to `block_rows` queries are broadcast, and the corpus isn't
    moved; more are cut into blocks, as the corpus is. A task gives k rows a query. Null ids and vectors take no part."""
    side = lambda df, i, v: df.select(F.col(i).cast("long").alias("id"), doubles(v).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    x, q = side(corpus, id_col, vec_col), side(queries, query_id, query_vec)
    asked = q.count()
    if not asked:
        hits = x.sparkSession.createDataFrame([], HITS)
    else:
        hits = _streamed(x, q, k) if asked <= block_rows else _blocked(x, q, max(1, -(-x.count() // shard_rows)), -(-asked // block_rows), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


class Index:
    """Records with their embeddings in one table, and the encoder's name and dimension in another beside it."""

    def __init__(self, records: DataFrame, model: str, dim: int, k: int = 5):
        self.records, self.model, self.dim, self.k = records, model, dim, k

    @classmethod
    def build(cls, records: DataFrame, encode, model: str, path: str, k: int = 5) -> Index:
        """encode: (DataFrame, text column) -> the rows with `embedding`. No records give an empty index."""
        spark = records.sparkSession
        vectors = encode(records, "text").withColumn("embedding", unit("embedding").cast("array<float>"))
        vectors.write.mode("overwrite").parquet(f"{path}/records")
        found = spark.read.parquet(f"{path}/records").agg(F.max(F.size("embedding"))).first()[0]
        spark.createDataFrame([(model, found or 0)], "embedding_model string, dim int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
        return cls.load(spark, path, k)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: int = 5) -> Index:
        meta = spark.read.schema("embedding_model string, dim int").json(f"{path}/meta").first()
        records = spark.read.parquet(f"{path}/records")
        if not records.where(F.col("embedding").isNull() | (F.size("embedding") != meta.dim)).isEmpty():
            raise ValueError("a record lacks its embedding, or has one of another dimension")
        return cls(records, meta.embedding_model, meta.dim, k)

    def __len__(self) -> int:
        return self.records.count()

    def retrieve(self, queries: DataFrame, k: int | None = None, query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
        """query_id, rank, text, source, citation, score, metadata; k None: the index's own."""
        own = self.records.withColumn("_row", F.xxhash64("id", "text"))
        hits = top_k_join(own, queries, k or self.k, "_row", "embedding", query_id, query_vec)
        none = lambda c: F.coalesce(c, F.lit(""))
        return hits.join(own.dropDuplicates(["_row"]), "_row").select(
            "query_id", "rank", "text", none("source").alias("source"), none("citation").alias("citation"), "score",
            F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        )


def context_line(rank: Column, citation: Column, source: Column, text: Column, most: int = 600) -> Column:
    snippet = truncate(F.replace(strip(text), F.lit("\n"), F.lit(" ")), most)
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] ("), or_else(citation, source, F.lit("source")), F.lit('): "'), snippet, F.lit('"'))


def context_blocks(hits: DataFrame, key: str = "query_id", most: int = 600) -> DataFrame:
    """key, context: the numbered hits of each query under a heading; a query has few hits, so they meet in one row."""
    line = F.struct("rank", context_line(F.col("rank"), F.col("citation"), F.col("source"), F.col("text"), most).alias("line"))
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(key, F.concat_ws("\n", F.lit(HEAD), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("context"))


def passages(context: str) -> list[str]:
    """The texts in a context's lines, as far as the lines have them."""
    return [m[1] for m in map(LINE.fullmatch, context.split("\n")) if m]
