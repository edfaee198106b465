"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math
import re
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest
from loomline.functions import text as tx
from loomline.functions import vectors as vx
from loomline.operators import classify, encoder, epochs, probe
from loomline.plans import catalogue
from pyspark.sql import functions as F

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(name, spark, sf, con):
    df = catalogue.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr([plain(list(r[i]) if isinstance(r[i], tuple) else r[i]) for i in at]) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark, sf):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_rag_classify_takes_every_row(spark, sf, tmp_path, monkeypatch):
    """All turns and roles, repeated rows and null keys too, against brute force: labels, and the five best hits in the prompt."""
    said = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(None, 1, "user", "he stole a car"), (1, None, "user", "he stole a car"), (7, 3, "user", None), (7, 4, "user", "")], said.schema)
    said.union(said.limit(3)).union(odd).write.parquet(f"{tmp_path}/conversations.parquet")
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path)
    backend = catalogue.fitted_backend(spark, sf)
    monkeypatch.setattr(catalogue, "fitted_backend", lambda *_: backend)
    encode = backend.encoder
    rows = encode(spark.read.parquet(f"{tmp_path}/conversations.parquet")).collect()

    def label(r):
        return classify.LABELS[int(np.argmax(backend.weights @ np.r_[np.array(r.embedding, float), 1.0]))]

    out = catalogue.queries()["rag_classify"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows) == said.count() + 7
    known = [r for r in out if r.error is None]
    assert Counter((r.conv_id, r.turn, r.label) for r in known) == Counter((r.conv_id, r.turn, label(r)) for r in rows if r.text is not None)
    assert len({r.label for r in known}) > 1

    items = encode(spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()
    line = lambda t: (lambda s: s if len(s) <= 600 else s[:599].rstrip() + "…")(t.strip().replace("\n", " "))
    vectors = np.array([r.embedding for r in items], float)
    at = {line(r.text): i for i, r in enumerate(items)}
    asked = catalogue.conversation_prompts(spark, str(tmp_path), encode).collect()
    assert Counter((r.conv_id, r.turn, r.text) for r in asked) == Counter((r.conv_id, r.turn, r.text) for r in rows)
    scores = {(r.conv_id, r.turn, r.text): vectors @ np.array(r.embedding, float) for r in rows}
    for r in asked:
        own = scores[r.conv_id, r.turn, r.text]
        hits = [m[1] for m in re.finditer(r'^\[\d\] \(benchmark\): "(.*)"$', r.context, re.M)]
        assert len(hits) == 5
        np.testing.assert_allclose([own[at[h]] for h in hits], np.sort(own)[::-1][:5], atol=1e-6)


def test_rag_classify_reads_the_passages(spark, sf, monkeypatch):
    """Labels and confidences against brute force over text and retrieved passages; without these some labels are others."""
    rng = np.random.default_rng(3)
    encode = encoder.Encoder(np.ones(512), np.linalg.qr(rng.normal(size=(512, 16)))[0])
    backend = classify.FittedBackend(encode, rng.normal(size=(3, 17)))
    monkeypatch.setattr(catalogue, "fitted_backend", lambda *_: backend)
    own = lambda name: encode(spark.read.parquet(f"{sf}/{name}.parquet")).collect()
    said = lambda v: (lambda p: (classify.LABELS[int(p.argmax())], p.max()))(epochs.softmax((np.r_[v, 1.0] @ backend.weights.T)[None])[0])
    items, want, turned = np.array([r.embedding for r in own("benchmark")], float), {}, 0
    for r in own("conversations"):
        v = np.array(r.embedding, float)
        best = items[np.argsort(-(items @ v), kind="stable")[:5]]
        score = np.maximum(best @ v, 0)
        want[r.conv_id, r.turn] = said(encoder.unit(0.8 * v + 0.2 * (score @ best) / score.sum()))
        turned += want[r.conv_id, r.turn][0] != said(v)[0]
    out = {(r.conv_id, r.turn): r for r in catalogue.queries()["rag_classify"](spark, sf).collect()}
    assert out.keys() == want.keys() and turned > 0
    assert {k: r.label for k, r in out.items()} == {k: w[0] for k, w in want.items()}
    np.testing.assert_allclose([out[k].confidence for k in want], [w[1] for w in want.values()], atol=1e-6)


def test_linear_probe_is_at_the_minimum(spark, sf):
    """The gradient of the weighted, penalised loss vanishes at the fitted coefficients, and predictions are the model's argmax."""
    rows = probe.stratified_split(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id").persist()
    train, c = rows.where("split = 'train'"), 1.0
    model = probe.fit(train, c=c)
    got = train.select("embedding", "label").collect()
    x, y = np.array([r.embedding for r in got], float), np.array([r.label for r in got])
    k = model.numClasses
    n = np.bincount(y, minlength=k)
    w = (len(y) / ((n > 0).sum() * np.maximum(n, 1)))[y]
    b, a = model.coefficientMatrix.toArray(), np.array(model.interceptVector)
    z = x @ b.T + a
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    off = (p - np.eye(k)[y]) * w[:, None]
    assert np.abs(off.T @ x + b / c).max() < 1e-4 * len(y) and np.abs(off.sum(axis=0)).max() < 1e-4 * len(y)
    out = catalogue.queries()["linear_probe"](spark, sf).collect()
    test = {r.vec_id: np.array(r.embedding, float) for r in rows.where("split = 'test'").collect()}
    assert {r.vec_id for r in out} == set(test) and all(int(np.argmax(test[r.vec_id] @ b.T + a)) == r.prediction for r in out)


def test_html_sections_of_pages(spark, sf):
    """Headings and paragraphs of the pages by regular expressions over their source."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in catalogue.queries()["html_sections"](spark, sf).collect():
        html = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", "", pages[r.id])
        heads = "".join(re.sub(r"<[^>]*>", "", m) for m in re.findall(r"(?is)<h1\b[^>]*>(.*?)</h1>", html))
        assert r.heading == " ".join(unescape(heads).split())
        depth, head, inside = 0, False, []
        for part in re.split(r"(<[^>]*>)", html):
            tag = re.match(r"<(/?)(\w+)", part)
            name, closing = (tag[2].lower(), bool(tag[1])) if tag else ("", False)
            head = not closing if name == "h1" else head
            depth += (-1 if depth else 0) if name == "p" and closing else name == "p"
            inside += [unescape(part)] * (not part.startswith("<") and depth > 0 and not head)
        assert "".join(r.body.split()) == "".join("".join(inside).split())


def test_boolean_text_query_of_odd_texts(spark, tmp_path):
    """Words beside letters that are not ASCII, other white space, letters with a third case, null: as the SQL has it."""
    texts = ["éthe", "the\u0301", "theé", "xthe", "THE", "dé des", "deſ x", "deſx", "DEſy", "nicht\x0bsch", "NICHT\f\n SCH", "nicht\u00a0sch", "nıcht sch", "nicht ſCH", "_des", "des_", "1des", "para—", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.hit for r in catalogue.queries()["boolean_text_query"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(catalogue.oracle_sql()["boolean_text_query"]).fetchall())
    for query, sql in (('"tax—é" OR kilo', "tax—é|kilo"), ('"a (b)"', r"a\s+\(b\)"), ("ſo OR Éa", "ſo|Éa")):
        body = ["TAX—É", "tax—éa", "\u212aILO", "x\u212aILO", "a (b)", "A (b)c", "SO", "so.", "éa", "bÉA", "É A"]
        rows = spark.createDataFrame(list(enumerate(body)), "i int, s string")
        got = [r.x for r in rows.select("i", tx.any_word("s", query).alias("x")).orderBy("i").collect()]
        assert got == [duckdb.execute("SELECT regexp_matches(?, ?)", [s, rf"(?i)\b({sql})\b"]).fetchone()[0] for s in body], query


def test_l2_normalize_of_odd_vectors(spark, tmp_path):
    """What rounds to zero keeps its sign, zero vectors, halves, no vector, none of its components, no numbers: bit by bit as the SQL has it."""
    vectors = [[1.0, -1e-8], [1e-8, 1.0], [-1.0, -5e-7], [0.0, 0.0], [-0.0, 0.0], [3.0, 4.0], [], None, [math.nan, 1.0], [math.inf, 1.0], [1e-40, -1e-40], [0.1234565, 0.9923495]]
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = lambda rows: {i: v and [repr(x) for x in v] for i, v in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = bits(con.sql(catalogue.oracle_sql()["l2_normalize"]).fetchall())
    assert want[0] == ["1.0", "-0.0"]
    assert bits((r.vec_id, r.unit) for r in catalogue.queries()["l2_normalize"](spark, str(tmp_path)).collect()) == want


def test_rounded_is_the_rounding_of_sql(spark):
    values = [0.5e-6, -0.5e-6, 1.5e-6, -2.5e-6, 0.1234565, -0.1234575, 1e-9, -1e-9, 0.0, -0.0, 123.4567895, -7.0000005, math.nan, math.inf, -math.inf]
    got = [r.x for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", vx.rounded(F.col("v"), 6).alias("x")).orderBy("i").collect()]
    assert list(map(repr, got)) == [repr(duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0]) for v in values]
