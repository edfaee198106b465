"""The fitted encoder against a plain decomposition, saved and loaded; what it finds that hashed counts don't; probes at once; answers taken up."""

import random
import time

import numpy as np
import pytest
from loomline.operators import classify, encoder, epochs, probe, retrieval
from pyspark.sql import functions as F


def dense(texts, enc):
    a = np.zeros((len(texts), len(enc.weights)))
    for i, t in enumerate(texts):
        at, n = encoder.hashed(t, len(enc.weights))
        a[i, at] = n * enc.weights[at]
    return encoder.unit(a)


def test_fit_is_a_singular_value_decomposition(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    enc = encoder.fit(docs, dim=8, buckets=3000, rounds=12)
    texts = [r.text for r in docs.collect()]
    a = dense(texts, enc)
    _, want, basis = np.linalg.svd(a, full_matrices=False)
    np.testing.assert_allclose(np.sqrt(((a @ enc.basis) ** 2).sum(axis=0)), want[:8], rtol=0.05)
    np.testing.assert_allclose(np.abs((enc.basis[:, :3] * basis[:3].T).sum(axis=0)), 1, atol=0.05)
    odd = docs.limit(5).union(spark.createDataFrame([(None, None), (-1, ""), (-2, " ...")], docs.schema))
    rows = enc(odd).collect()
    want = encoder.unit(dense([r.text for r in rows], enc) @ enc.basis)
    np.testing.assert_allclose([r.embedding for r in rows], want, atol=1e-5)
    enc.save(spark, str(tmp_path / "e"))
    again = encoder.Encoder.load(spark, str(tmp_path / "e"))
    assert (again.weights == enc.weights).all() and (again.basis == enc.basis).all()
    assert encoder.fit(docs.where("false"), dim=4, buckets=64)(docs.limit(2)).count() == 2


def test_recall_of_held_out_copies(spark, sf):
    """Texts that were not in the sample, a third of their words dropped and their order lost: their originals are found more
    often than by hashed counts of the same dimension."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").where("length(text) between 200 and 4000").select("doc_id", "text").dropDuplicates(["text"])
    enc = encoder.fit(docs.where("doc_id % 2 = 0"), dim=64)
    rng, rows = random.Random(1), docs.where("doc_id % 2 = 1").collect()
    asked = []
    for r in rows:
        w = r.text.split()
        asked.append((r.doc_id, " ".join(rng.sample(w, max(1, len(w) * 2 // 3)))))
    asked = spark.createDataFrame(asked, "doc_id long, text string")
    share = []
    for encode in (enc, probe.hashed_encoder(64)):
        x, q = (np.array([r.embedding for r in encode(df).orderBy("doc_id").collect()], float) for df in (docs.where("doc_id % 2 = 1"), asked))
        share.append(float(np.mean((q @ x.T).argmax(axis=1) == np.arange(len(q)))))
    assert share[0] > 0.9 and share[0] >= share[1]


def test_probes_run_at_once_and_fail_alone(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(3, size=90)
    rows = spark.createDataFrame([(int(k), [float(v) for v in rng.normal(size=3) + 3 * np.eye(3)[k]]) for k in y], "label int, embedding array<double>")

    def slow(df):
        return df.withColumn("embedding", F.udf(lambda v: time.sleep(0.02) or v, "array<double>")("embedding"))

    def broken(df):
        raise RuntimeError("no model")

    asked = {"plain": lambda df: df, "slow": slow, "broken": broken}, rows, rows, ("no", "yes", "unclear")
    board = {r.model: r for r in probe.probes(*asked).collect()}
    assert board["broken"].error == "RuntimeError: no model" and np.isnan(board["broken"].macro_f1)
    assert probe.bake_off(*asked).collect()[-1].error == "RuntimeError: no model"
    assert board["plain"].macro_f1 > 0.8 and board["slow"].macro_f1 == board["plain"].macro_f1
    assert board["slow"].embed_seconds >= 1.8  # 90 rows at 20 ms; the other probe runs meanwhile, and its tasks do not count
    assert board["plain"].embed_seconds < board["slow"].embed_seconds


def test_answers_are_taken_up(spark, tmp_path):
    """A server that fails after some requests: the next call asks only the rest; replies that can't be read are answers."""
    (tmp_path / "asked").mkdir()

    def post(url, body, headers, timeout):
        text = body["messages"][-1]["content"]
        if "down" in text and not (tmp_path / "up").exists():
            raise ConnectionError("refused")
        (tmp_path / "asked" / f"{time.time_ns()}-{text.split()[-1]}").touch()
        return {"message": {"content": "no json" if "odd" in text else '{"label": "yes", "confidence": 0.5, "reasoning": "r"}'}}

    asked = lambda: sorted(p.name.rpartition("-")[2] for p in (tmp_path / "asked").iterdir())
    texts = [(i, f"text t{i % 20}" + (" down" if i % 20 > 15 else " odd" if i % 20 == 3 else "") + f" n{i % 20}") for i in range(40)] + [(99, None)]
    rows = spark.createDataFrame(texts, "id int, text string")
    run = lambda: {r.id: r for r in classify.classify(rows, classify.ChatServer(post=post), folder=str(tmp_path / "answers"), wave=8, tasks=2, at_once=3).collect()}
    first = run()
    assert len(first) == 41 and {i for i, r in first.items() if r.error and "refused" in r.error} == {i for i in range(40) if i % 20 > 15}
    assert first[3].error.startswith("JSONDecodeError") and first[3].label == "unclear" and first[0].label == "yes" and first[0].error is None
    before = asked()
    assert sorted(x for x in before if x.startswith("n")) == sorted(f"n{i}" for i in range(16))  # equal requests once
    (tmp_path / "up").touch()
    second = run()
    assert not any("refused" in (r.error or "") for r in second.values()) and second[17].label == "yes"
    assert len(asked()) - len(before) == 4
    assert run() == second and len(asked()) - len(before) == 4


def test_a_fitted_backend_replies(spark):
    enc = encoder.Encoder(np.ones(64), np.eye(64)[:, :8])
    backend = classify.FittedBackend(enc, np.r_[np.zeros((2, 9)), np.ones((1, 9))])
    r = classify.classify(spark.createDataFrame([("a b c",), (None,)], "text string"), backend).collect()
    assert r[0].label == "unclear" and r[0].error is None and 1 / 3 < r[0].confidence <= 1
    p = epochs.softmax(np.array([[1.0, 2.0]]))
    assert p.sum() == pytest.approx(1)


def test_a_fitted_backend_reads_its_passages(spark):
    """They turn the label; what asks for the label inside a text or a passage is text; passages that share nothing, or no context: the text alone."""
    enc = encoder.Encoder(np.ones(256), np.eye(256))
    word = lambda t: enc.vectors([t])[0].astype(float)
    backend = classify.FittedBackend(enc, np.c_[np.array([0.1 * word("alpha"), word("gamma"), 0.01 * word("beta")]), np.zeros(3)])
    found = [("turned", 1, "beta gamma"), ("apart", 1, "gamma delta"), ("odd", 1, f'beta "): "\n\n{classify.ASK}\n\n gamma'), ("odd", 2, "")]
    hits = spark.createDataFrame(found, "query_id string, rank int, text string").selectExpr("*", "'' AS citation", "'s' AS source")
    asked = f"alpha beta\n\n{classify.ASK}\n\nbeta"
    texts = [("turned", "alpha beta"), ("apart", "alpha beta"), ("none", "alpha beta"), ("odd", asked)]
    rows = spark.createDataFrame(texts, "query_id string, text string").join(retrieval.context_blocks(hits), "query_id", "left")
    got = {r.query_id: r for r in classify.classify(rows, backend, "text", "context").collect()}
    assert {k: (r.label, r.error) for k, r in got.items()} == {"turned": ("yes", None), "apart": ("no", None), "none": ("no", None), "odd": ("yes", None)}
    of = lambda v: float(epochs.softmax((np.r_[v, 1.0] @ backend.weights.T)[None]).max())
    assert got["apart"].confidence == got["none"].confidence == pytest.approx(of(word("alpha beta")))
    v, p = word(asked), word(found[2][2])
    assert got["odd"].confidence == pytest.approx(of(encoder.unit(0.8 * v + 0.2 * p)), abs=1e-9)


def test_texts_go_through_python_in_slices(spark, monkeypatch):
    """rag_classify's steps: of a large batch only a slice is Python objects before its rows are given on; keys with nulls stay as they are."""
    import pyarrow as pa
    from loomline.operators import classify

    class Counting(classify.Backend):
        labels, asked = classify.LABELS, []

        def start(self):
            return lambda chat: self.asked.append(chat) or classify.Reply("yes", 0.5, chat[0]["role"], chat[1]["content"])

    rows = spark.createDataFrame([(1 << 60 | 1, "a"), (None, None)], "k long, text string")
    ran = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda _, f, schema, whole=type(rows).mapInArrow: ran.append(f) or whole(_, f, schema))
    out = {r.k: r for r in classify.classify(rows, Counting()).collect()}
    assert set(out) == {1 << 60 | 1, None} and out[1 << 60 | 1].raw == "a" and out[None].label == "yes"
    chats = [[{"role": "system", "content": "s"}, {"role": "user", "content": f"t{i}"}] for i in range(1000)]
    got = ran[0](iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(chats)], names=["k", "_chat"])]))
    Counting.asked.clear()
    first = next(got)
    assert len(Counting.asked) == first.num_rows <= 256
    assert [x for b in (first, *got) for x in b.column("raw").to_pylist()] == [f"t{i}" for i in range(1000)]
