"""What has to hold as tables grow or rows are odd: indexes that split, bounded partitions, any size of vectors, no cap on markup."""

import hashlib
import pickle
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import common, exact_dedup, language_id, mixing, vptree


def entries(spark, lo, hi):
    n = spark.range(lo, hi).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(1).cast("long").alias("n"), F.lit(5).cast("long").alias("chars"), F.col("id").alias("keep"))
    return common.materialise(n.withColumn("keep_null", F.lit(False)).withColumn("row", F.col("keep")), "entries")


def test_an_index_splits_as_it_grows(spark):
    index = common.materialise(exact_dedup.update_index(None, entries(spark, 0, 50)), "index")
    assert index.count() == 1
    index = common.materialise(exact_dedup.update_index(index, entries(spark, 40, 4050), bucket_digests=600), "index")
    rows = index.collect()
    assert len(rows) == 8 and {r.bits for r in rows} == {3} and sum(r.live for r in rows) == 4050 and max(r.live for r in rows) < 700
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    for r in rows:
        own = pickle.loads(r.bucket)
        assert len(own.kept) == r.live and all(k in own.filter and k[0] >> 5 == r.slot for k in own.kept)
    gone = spark.createDataFrame([(bytearray(digest(7)),), (bytearray(digest(10**6)),)], "digest binary")
    after = common.materialise(exact_dedup.update_index(index, None, gone, bucket_digests=600), "index")
    assert {bytes(r.digest): r.n for r in exact_dedup.live_entries(after).collect()} == {digest(i): 2 if 40 <= i < 50 else 1 for i in range(4050) if i != 7}
    asked = spark.createDataFrame([(bytearray(digest(i)),) for i in (7, 8, 4049, 4050)], "digest binary")
    assert {r.keep for r in exact_dedup.probe_index(after, asked).collect()} == {8, 4049}
    before, kept = {r.slot: r.bucket for r in rows}, {r.slot: r.bucket for r in after.collect()}
    assert {s for s in before if before[s] != kept[s]} == {digest(7)[0] >> 5, digest(10**6)[0] >> 5} - {s for s in before if before[s] == kept[s]}


def test_a_tree_over_many_sources(spark):
    counts = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), (F.col("id") % 7).alias("n"))
    rows = mixing.split_quotas(counts, 16, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r.source] += r.n
        by_shard[r.shard] += r.n
    assert by_source == {f"s{i}": i % 7 for i in range(20_000) if i % 7}
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 4
    six = [Counter({r.shard: r.n for r in rows if r.source == f"s{i}"}) for i in range(6, 4000, 7)]
    assert 2.5 < np.mean([len(c) for c in six]) and 1.7 < np.var([sum(c[s] for s in range(8)) for c in six]) * 4 / 3 < 2.3  # binomial, near enough: 1.5


def test_partitions_are_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed_rows(docs, slice_rows=1, most=32)
    assert out.rdd.getNumPartitions() <= 32
    rows = [(r["__shard"], r["__turn"]) for r in out.collect()]
    assert rows == sorted(set(rows)) and len(rows) == mixing.mixed_rows(docs).count()


def nearest(rows, queries, k):
    """Brute force over rows (id, vector); a query leaves out one row of its own id and vector."""
    out = Counter()
    for q, v in queries:
        left, mine = [], False
        for i, w in rows:
            if not mine and i == q and w == v:
                mine = True
            elif len(w) == len(v):
                left.append((-sum(Fraction(x) * Fraction(y) for x, y in zip(v, w, strict=True)), i))
        for rank, (_, i) in enumerate(sorted(left)[:k], 1):
            out[q, rank, i] += 1
    return out


@pytest.mark.parametrize("size", [1.0, 1e200, 1e-200, 4e307])
def test_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v * size / 4]) for i, v in enumerate(rng.normal(size=(60, 6)).clip(-3, 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vptree.nearest(df, df.where("vec_id % 20 = 0"), 5, 1.0, leaf=4)
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == nearest(rows, rows[::20], 5)


def test_vectors_of_many_sizes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v * 10.0 ** (i % 40 - 20)]) for i, v in enumerate(rng.normal(size=(200, 4)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vptree.nearest(df, df.where("vec_id % 20 = 0"), 7, 1.0, leaf=4)
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == nearest(rows, rows[::20], 7)


@pytest.mark.parametrize("shard_rows", [16384, 10])
def test_rows_that_repeat_an_id_are_candidates(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in [*range(40), 20, 20, 5, 5, 0, 0, 0]]
    rows = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in rows]
    rows += [rows[20], rows[20], rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vptree.nearest(df, df.where("vec_id % 20 = 0"), 30, 1.0, shard_rows=shard_rows, leaf=4)
    assert Counter((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == nearest(rows, [r for r in rows if r[0] % 20 == 0], 30)


def test_declared_language_behind_long_attributes(spark):
    text = f"<html class='{'x' * 5000}' lang=\"de\"><p>a</p>"
    rows = spark.createDataFrame([(1, text, "s"), (2, "<html><p lang='fr'>", "s"), (3, "<html " * 50_000, "s")], "doc_id long, text string, source string")
    assert {r.id: r.declared for r in language_id.document_evidence(rows).collect()} == {1: "de", 2: None, 3: None}


def test_recall_of_the_default(spark, sf):
    """Against brute force, on more rows than a leaf holds."""
    rows = spark.read.parquet(sf.replace("0.001", "0.1") + "/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    bands, asked = vptree.Bands(ids, x, 64), np.flatnonzero(ids % 20 == 0)
    best, _ = bands.search(x[asked], 21, vptree.nearest.__defaults__[1])
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    found = [len({*bands.hits(ids[q], x[q], row, 20)[0]} & {*ids[w]}) for q, row, w in zip(asked, best, want, strict=True)]
    assert np.mean(found) > 0.9 * 20 and bands.visited < 0.97 * len(asked) * len(ids)
