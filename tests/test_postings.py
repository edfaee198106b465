"""Search by postings against brute force: boolean clauses, phrases, BM25, both ways of the join."""

import math
import random
import re
from collections import Counter

import pytest
from loomline.operators import postings

WORDS = "the car van Straße été 42 stolen was in london".split()


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, query):
    """id -> score of the documents that hold a clause; clauses as lists of phrases."""
    docs = {i: tokens(t) for i, t in docs if i is not None}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    has = lambda d, p: any(d[i : i + len(p)] == p for i in range(len(d)))
    terms = {w for c in query for p in c for w in p}
    out = {}
    for i, d in docs.items():
        if any(all(has(d, p) for p in c) for c in query):
            tf = Counter(d)
            out[i] = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in terms if tf[w])
    return out


def test_clauses():
    assert postings.clauses('bank robbery OR "the  Fraud, act" theft OR') == [[["bank"], ["robbery"]], [["the", "fraud", "act"], ["theft"]]]
    assert postings.clauses('a a OR "b" OR x-y ORs "open') == [[["a"]], [["b"]], [["x"], ["y"], ["ors"], ["open"]]]
    assert postings.clauses(None) == postings.clauses(' OR "" OR --') == []


@pytest.mark.parametrize("few, docs_", [(20_000, 1024), (6, 7)])
def test_search(spark, tmp_path, monkeypatch, few, docs_):
    monkeypatch.setattr(postings, "FEW", few)
    monkeypatch.setattr(postings, "DOCS", docs_)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))) for i in range(150)] + [(200, None), (201, ""), (202, "the " * 500), (None, "stolen car")]
    asked = {1: "car van", 2: '"stolen car" OR 42', 3: '"was in london" été OR "the the"', 4: "nowhere OR STRASSE", 5: "straße", 6: "", 7: '"the car" "car the" van', 8: None}
    index = postings.Postings.build(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "i"))
    index = postings.Postings.load(spark, str(tmp_path / "i"))
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    got = {(r.query_id, r.id): r.score for r in index.search(queries).collect()}
    want = {(q, i): s for q, text in asked.items() for i, s in brute(docs, postings.clauses(text)).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    assert {q for q, _ in got} == {1, 2, 3, 5, 7}
    best = index.search(queries, 3).where("query_id = 1").orderBy("rank").collect()
    order = sorted((k for k in want if k[0] == 1), key=lambda k: (-round(want[k], 9), k[1]))[:3]
    assert [(r.query_id, r.id, r.rank) for r in best] == [(*k, n) for n, k in enumerate(order, 1)]


def test_empty_index(spark, tmp_path):
    index = postings.Postings.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert index.search(spark.createDataFrame([(1, "a")], "query_id int, query string"), 5).collect() == []


def test_best_rows_and_both_ways_of_the_join(spark):
    """Ties at the edge, repeated vectors, few rows; queries broadcast or in blocks give the same."""
    import numpy as np
    from loomline.operators import retrieval

    rng = np.random.default_rng(5)
    score, ids = rng.integers(0, 4, (50, 30)).astype(float), rng.permutation(30)
    got, own = retrieval.best_rows(score, ids, 6)
    for i in range(50):
        want = sorted(zip(-score[i], ids, strict=True))[:6]
        assert [(-a, b) for a, b in zip(got[i], own[i], strict=True)] == want
    x = spark.createDataFrame([(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(300)] + [(None, [1.0] * 4), (900, None)], "vec_id long, embedding array<double>")
    rows = {r.vec_id: np.array(r.embedding) for r in x.collect() if r.vec_id is not None and r.embedding}
    want = {(q, n, i) for q in range(0, 300, 7) for n, (_, i) in enumerate(sorted((-float(rows[q] @ v), i) for i, v in rows.items())[:9], 1)}
    for block in (4096, 10):
        found = retrieval.top_k_join(x, x.where("vec_id % 7 = 0 AND vec_id < 300"), 9, shard_rows=70, block_rows=block)
        assert {(r.query_id, r["rank"], r.vec_id) for r in found.collect()} == want
    assert retrieval.top_k_join(x.where("false"), x, 3).count() == retrieval.top_k_join(x, x.where("false"), 3).count() == 0
