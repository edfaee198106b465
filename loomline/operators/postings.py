"""Full-text search: an index of postings with positions, boolean queries with phrases, BM25 for "score desc".

A query is clauses between OR; a clause's words and "quoted phrases" all have to be there. Words are runs of letters and digits in
lower case. Documents are indexed in blocks of `DOCS`. The index is four tables: postings (block, term, of the block's documents
that have it the places in the block, tf and the words' positions, end to end), blocks (block, ids, lengths), terms (term, df)
and totals. It is built without a shuffle of postings: a task sorts its own by term, so a scan for a query's terms leaves most
row groups out. No row grows with the number of documents, whatever share of them has a word.

A search takes queries some at a time, up to `FEW` words. The postings of their words meet by block, where documents are
matched and scored as arrays, and a block gives each query its k best, ranked again over the blocks.

Ids are unique whole numbers; rows without one are not indexed. A null text has no words; a query without a word finds nothing."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of the queries that are searched for at a time; documents of a block.
FEW, DOCS = 20_000, 1024
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
PART = "block long, ids array<long>, n array<int>, term string, docs array<int>, tf array<int>, positions array<int>"
HIT = "query long, id long, score double"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def clauses(query: str | None) -> list[list[list[str]]]:
    """A query's clauses, each a list of phrases, each a list of words; empty ones are left out."""
    found: list[list[tuple[str, ...]]] = [[]]
    for quoted, loose in re.findall(r'"([^"]*)"|([^\s"]+)', query or ""):
        own = words(quoted or loose)
        if loose == "OR":
            found.append([])
        else:
            found[-1] += [tuple(own)] if quoted and own else [(w,) for w in own]
    return [[list(p) for p in dict.fromkeys(c)] for c in found if c]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values, kind))


def inverted(ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
    """PART of a block: a row without a term that has the documents, and one for each term."""
    number: dict[str, int] = defaultdict(count().__next__)
    term, length = [], []
    for text in texts:
        own = words(text)
        length.append(len(own))
        term.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
    length, term = np.array(length, np.int32), np.concatenate([*term, np.zeros(0, np.int32)])
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), length)
    at = (np.arange(len(term)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    order = np.argsort(term, kind="stable")  # by term, then document, then place
    term, doc, at = term[order], doc[order], at[order]
    new = np.r_[True, term[1:] != term[:-1]][: len(term)]
    pair = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]][: len(term)])
    tf = np.diff(np.append(pair, len(term))).astype(np.int32)
    first = np.flatnonzero(new)
    each = np.searchsorted(pair, first)
    block = int.from_bytes(hashlib.blake2b(np.array(ids, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
    none, n = np.zeros(0, np.int32), len(first)
    cols = [
        pa.array(np.full(n + 1, block)), _lists(np.array(ids, np.int64), np.r_[0, np.full(n, len(ids))], pa.int64()), _lists(length, np.r_[0, np.full(n, len(ids))], pa.int32()),
        pa.array([None, *number], pa.string()), *(_lists(v if len(v) else none, np.r_[0, s], pa.int32()) for v, s in ((doc[pair], each), (tf, each), (at, first))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PART.split(", ")])


class Block:
    """A block's documents and what it has of the words asked for."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, mean: float):
        self.ids, self.norm = ids, K1 * (1 - B + B * n / (mean or 1.0))
        self.docs: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def has(self, phrase: list[str]) -> np.ndarray:
        out = np.zeros(len(self.ids), bool)
        if all(w in self.docs for w in phrase):
            if len(phrase) == 1:
                out[self.docs[phrase[0]][0]] = True
            else:
                starts = None  # document and place where the phrase would begin, by each of its words
                for i, w in enumerate(phrase):
                    docs, tf, at = self.docs[w]
                    own = (np.repeat(docs, tf).astype(np.int64) << 32) + at - i
                    starts = own if starts is None else np.intersect1d(starts, own)
                out[starts >> 32] = True
        return out

    def search(self, query: list[list[list[str]]], weights: dict[str, float], k: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the documents that hold a clause; the k best."""
        found = np.zeros(len(self.ids), bool)
        for clause in query:
            found |= np.logical_and.reduce([self.has(p) for p in clause])
        score = np.zeros(len(self.ids))
        for w in dict.fromkeys(w for clause in query for p in clause for w in p):
            if w in self.docs:
                docs, tf, _ = self.docs[w]
                score[docs] += weights[w] * tf * (K1 + 1) / (tf + self.norm[docs])
        at = np.flatnonzero(found)
        if k is not None and len(at) > k:
            at = at[np.lexsort((self.ids[at], -np.round(score[at], 9)))[:k]]
        return self.ids[at], score[at]


class Postings:
    def __init__(self, postings: DataFrame, blocks: DataFrame, terms: DataFrame, docs: int, mean: float):
        self.postings, self.blocks, self.terms, self.docs, self.mean = postings, blocks, terms, docs, mean

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> Postings:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts = [], []
            for b in batches:
                at = 0
                while at < b.num_rows:
                    part = b.slice(at, DOCS - len(ids))
                    ids, texts, at = ids + part.column("id").to_pylist(), texts + part.column("text").to_pylist(), at + part.num_rows
                    if len(ids) == DOCS:
                        yield inverted(ids, texts)
                        ids, texts = [], []
            if ids:
                yield inverted(ids, texts)

        spark = rows.sparkSession
        each = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
        parts = each.mapInArrow(run, PART).withColumn("kind", F.when(F.col("term").isNull(), "blocks").otherwise("postings"))
        parts.sortWithinPartitions("kind", "term").write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
        postings, blocks = cls._parts(spark, path)
        postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        totals = blocks.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"))
        totals.select(F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.coalesce(F.col("words") / F.col("docs"), F.lit(0.0)).alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")
        return cls.load(spark, path)

    @staticmethod
    def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        parts = lambda: spark.read.schema(f"{PART}, kind string").parquet(f"{path}/parts")  # noqa: E731  two scans, as they meet by block
        return parts().where("kind = 'postings'").select("block", "term", "docs", "tf", "positions"), parts().where("kind = 'blocks'").select("block", "ids", "n")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Postings:
        return cls(*cls._parts(spark, path), spark.read.parquet(f"{path}/terms"), *spark.read.parquet(f"{path}/totals").first())

    def _search(self, asked: list[tuple[int, list[list[list[str]]]]], k: int | None) -> DataFrame:
        spark, mean = self.blocks.sparkSession, self.mean
        names = sorted({w for _, q in asked for clause in q for p in clause for w in p})
        own = F.broadcast(spark.createDataFrame([(w,) for w in names], "term string"))  # at most FEW and a query's more
        df = {r.term: r.df for r in self.terms.join(own, "term").collect()}
        weights = {w: math.log1p((self.docs - n + 0.5) / (n + 0.5)) for w, n in df.items()}

        def run(key, postings: pa.Table, block: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if postings.num_rows and block.num_rows:
                ids, n = (block.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "n"))
                here = Block(ids, n, mean)
                values = {c: postings.column(c).combine_chunks() for c in ("docs", "tf", "positions")}
                for i, w in enumerate(postings.column("term").to_pylist()):
                    here.docs[w] = tuple(values[c][i].values.to_numpy() for c in ("docs", "tf", "positions"))
                for number, query in asked:
                    ids, score = here.search(query, weights, k)
                    out.append((np.full(len(ids), number), ids, score))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query", "id", "score"])

        return self.postings.join(own, "term").groupBy("block").cogroup(self.blocks.groupBy("block")).applyInArrow(run, HIT)

    def search(self, queries: DataFrame, k: int | None = None, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """query_id, id, score, and with k rank: the k best of each query, ties to the smaller id. Query ids are whole numbers."""
        spark = queries.sparkSession
        parts = queries.select(F.col(query_id).cast("long").alias("i"), F.col(query).alias("q")).where("i is not null and q is not null")
        size = F.size(F.split("q", r"\s+"))
        rounds = -(-(parts.agg(F.sum(size)).first()[0] or 0) // FEW)
        found = spark.createDataFrame([], HIT)
        for r in range(rounds):
            some = parts.where(F.pmod(F.xxhash64("i", "q"), F.lit(rounds)) == r).collect()  # about FEW words
            asked = [(x.i, c) for x in some if (c := clauses(x.q))]
            found = found.unionByName(self._search(asked, k)) if asked else found
        found = found.withColumnRenamed("query", "query_id")
        if k is None:
            return found
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
