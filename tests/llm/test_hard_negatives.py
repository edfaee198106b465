"""Hard negatives against brute force in whole numbers, the bounds, and the SQL."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import hard_negatives, queries

COLS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, vector), as they are asked."""
    fit = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and fit(v)]
    out = Counter()
    for a, (i, y, v) in enumerate(rows):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, b, z) for b, (j, z, w) in enumerate(rows) if b != a and len(w) == len(v)]
        for score, j, *_ in sorted(x for x in scored if x[3] == y)[:positives]:
            window = sorted(x for x in scored if x[3] != y and low * -score <= 100 * -x[0] <= high * -score)[:negatives]
            for rank, (n, k, *_) in enumerate(window, 1):
                out[i, j, rank, k, -score, -n] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


def test_query_against_brute_force_and_sql(spark, sf):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and got(queries.op13_hard_negatives(spark, sf)) == want
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        assert Counter(db.sql(f"SELECT {', '.join(COLS)} FROM ({queries.OP13_SQL})").fetchall()) == want


@pytest.mark.parametrize("shard_rows, block_rows, bits", [(16384, 4096, 6), (50, 7, 3), (50, 7, 1), (400, 100, 10)])
def test_odd_rows(spark, shard_rows, block_rows, bits):
    """Nulls, non-finite and huge components, copies by the hundred, ids twice, lengths that differ, ties, clashing names."""
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(size=5) / 3] for _ in range(300)]
    rows = [(i, int(rng.integers(3)), x) for i, x in enumerate(v)]
    rows += [(1000 + i, i % 2, v[10]) for i in range(200)] + [(50, 1, v[4]), (50, 1, v[4]), (100, 2, v[7][:3]), (101, 2, v[8][:3]), (102, 1, v[9][:3])]
    rows += [(None, 1, v[3]), (150, None, v[3]), (200, 1, None), (250, 1, [1.0, None, 0.0, 0.0, 0.0]), (350, 1, [float("nan")] * 5), (450, 1, [float("inf")] * 5), (500, 1, []), (501, 1, []), (502, 0, [])]
    huge = [(550, 1, [1e300] * 5), (551, 0, [1e9] * 5)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + huge], "vec_id long, label int, embedding array<double>, row int, shard string, dim int")
    found = got(hard_negatives.hard_negatives(df, F.col("id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows, bits=bits))
    assert found == brute(rows) and {50, 100, 500} <= {k[0] for k in found}


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(df, F.col("id") % 50 == 0).collect() == []


def test_bounds_hold_and_leave_little_to_score():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    labels = rng.integers(10, size=4000)
    file = hard_negatives.VAFile(np.arange(4000), np.arange(4000), labels, x)
    for i in range(20):
        low, slack = file.bounds(x[i], 0, 4000)
        score = file.exact(x[i], np.arange(4000))
        assert (low <= score).all() and (score <= low + slack).all()
        _, _, best = file.positives(x[i], labels[i], i, 5)
        assert file.scored < 200
        file.negatives(x[i], labels[i], hard_negatives.window(best, 50, 95), 3)
        assert file.scored < 800
