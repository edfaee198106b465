"""Text, vector, parser, metric and reply functions against hand-derived cases."""

import json
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loomline.functions import text as tx
from loomline.functions import vectors as vx
from loomline.operators import classify, metrics, probe, records, retrieval
from loomline.sources import parsers
from pyspark.sql import functions as F


def one(spark, col, **values):
    kinds = {str: "string", float: "double", list: "array<double>", int: "int", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first()[0]


def test_white_space_is_python_s(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, s string")
    assert {r.c for r in rows.where(tx.squash("s") == "a b").collect()} == {c for c in points if chr(c).isspace()}
    assert one(spark, tx.squash("s"), s=None) == "" and one(spark, tx.squash("s"), s=" a \nb ") == "a b"


def test_text(spark):
    assert one(spark, tx.truncate("s", 600), s="x" * 600) == "x" * 600
    assert one(spark, tx.truncate("s", 600), s="x" * 601) == "x" * 599 + "…"
    assert one(spark, tx.truncate("s", 5), s="ab \U0001f600 cde") == "ab \U0001f600…"
    assert one(spark, tx.section_suffix("s"), s="USCODE-2023-title18-partI-chap51-sec1111") == "1111"
    assert one(spark, tx.section_suffix("s"), s="sec1030-1") == "sec1030-1"
    assert one(spark, tx.or_else("a", "b"), a="", b="z") == "z"
    assert one(spark, tx.prefixed("u:", "s"), s="") == "" and one(spark, tx.prefixed("u:", "s"), s="p") == "u:p"
    assert one(spark, tx.first_digits("s"), s="Title 18 of 20") == "18" and one(spark, tx.first_digits("s"), s="none") is None
    assert one(spark, tx.trim_chars("s", "§", "."), s="§§12..") == "12"
    assert one(spark, tx.unfenced("s"), s='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, tx.few_newlines("s"), s="a\n\n\n\nb") == "a\n\nb"
    assert one(spark, tx.folder_name("s"), s="a/b") == "a__b"
    assert [one(spark, tx.confidence("s"), s=s) for s in ("0.9", "1.7", "-2", "NaN", "high")] == [0.9, 1.0, 0.0, 1.0, 0.0]
    assert one(spark, tx.path_parts("s"), s="ukpga/2006/35").asDict() == {"act_type": "ukpga", "year": 2006, "number": 35}


def test_vectors(spark):
    assert one(spark, vx.unit("v"), v=[3.0, 4.0]) == [0.6, 0.8] and one(spark, vx.unit("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vx.argmax("v"), v=[1.0, 3.0, 3.0]) == 1
    assert one(spark, vx.softmax("v"), v=[1000.0, 1000.0]) == [0.5, 0.5]


CASES = [
    ('{"label":"YES ","confidence":0.9,"reasoning":" x "}', "yes", 0.9, "x"), ('```json\n{"label":"yes"}\n```', "yes", 0.0, ""), ('{"label":"yes"} {"label":"no"}', "yes", 0.0, ""),
    ('Sure: {"label":"no"} ok', "no", 0.0, ""), ('{"label":"maybe","confidence":0.4}', "unclear", 0.4, ""), ('{"label":null,"reasoning":null}', "unclear", 0.0, "None"),
    ('{"label":"no","confidence":"0.9"}', "no", 0.9, ""), ('{"label":"no","confidence":"high"}', "no", 0.0, ""), ('{"label":"no","confidence":null}', "no", 0.0, ""),
    ('{"label":"no","confidence":1.7}', "no", 1.0, ""), ('{"label":"no","confidence":-2}', "no", 0.0, ""), ('{"label":"no","confidence":NaN}', "no", 1.0, ""),
    ('{"label":"no","confidence":true}', "no", 1.0, ""), ('{"label":"no","label":"yes"}', "yes", 0.0, ""),
]


def test_replies(spark):
    bad = ['x {bad} {"label":"yes"}', "no json", None]
    df = spark.createDataFrame([(i, c[0] if isinstance(c, tuple) else c) for i, c in enumerate([*CASES, *bad])], "i int, s string")
    out = [r.r for r in df.select("i", classify.parse_column(F.col("s")).alias("r")).orderBy("i").collect()]
    for r, (_, label, sure, why) in zip(out, CASES, strict=False):
        assert (r.label, r.confidence, r.reasoning, r.error) == (label, sure, why, None)
    assert out[2].raw == '{"label":"yes"}'
    assert all(r.label == "unclear" and r.confidence == 0 and r.reasoning == "" and r.error for r in out[len(CASES) :])
    native = [r.r for r in df.where("i in (0, 1, 3, 4, 6, 9, 10)").select("i", classify.parse_native(F.col("s")).alias("r")).orderBy("i").collect()]
    assert [(r.label, r.confidence, r.reasoning) for r in native] == [CASES[i][1:] for i in (0, 1, 3, 4, 6, 9, 10)]


def test_tool_replies():
    blocks = [{"type": "text"}, {"type": "tool_use", "name": "other", "input": {}}, {"type": "tool_use", "name": "t", "input": {"label": "no", "confidence": 0.2}}]
    assert classify.parse_tool_input(classify.first_tool_input(blocks, "t")).label == "no"
    with pytest.raises(ValueError):
        classify.parse_tool_input({"label": "no", "confidence": "high"})
    with pytest.raises(RuntimeError):
        classify.parse_tool_input(classify.first_tool_input(blocks, "u"))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["label", "confidence", "reasoning"]), st.one_of(st.none(), st.booleans(), st.floats(), st.text(max_size=5))), st.text(alphabet="ab \n", max_size=5))
def test_replies_are_clamped(data, around):
    r = classify.parse_reply(around + json.dumps(data) + around)
    assert r.label in classify.LABELS and 0.0 <= r.confidence <= 1.0 and json.loads(r.raw).keys() == data.keys()


def test_backends(spark):
    rows = spark.createDataFrame([(1, "he stole a bike", None), (2, "a walk", "ctx"), (3, "boom", "")], "id int, text string, context string")
    def post(url, body, headers, timeout):
        text = body["messages"][-1]["content"]
        if text == "boom":
            raise OSError("down")
        reply = {"label": "yes", "confidence": 1, "reasoning": text}
        return {"message": {"content": json.dumps(reply)}} if url.endswith("/api/chat") else {"content": [{"type": "tool_use", "name": "record_classification", "input": reply}]}

    for backend in (classify.ChatServer(post=post), classify.ToolServer("m", "http://x", "k", post=post)):
        out = {r.id: r for r in classify.classify(rows, backend, "text", "context").collect()}
        assert out[2].reasoning == f"ctx\n\n{classify.ASK}\n\na walk" and out[1].reasoning == "he stole a bike"
        assert out[3].label == "unclear" and out[3].error == "OSError: down" and out[3].raw == ""
    broken = classify.LocalGenerator(lambda: lambda prompt: "no braces")
    assert classify.classify(rows, broken).first().raw == "no braces"


def test_metrics(spark):
    df = spark.createDataFrame([(y, 0) for y, n in ((0, 70), (1, 25), (2, 5)) for _ in range(n)], "y int, p int")
    assert metrics.accuracy(df).first()[0] == pytest.approx(0.7) and metrics.macro_f1(df).first()[0] == pytest.approx(0.274510, abs=1e-6)
    two = df.where("y < 2").withColumn("p", F.col("y"))
    assert metrics.macro_f1(two).first()[0] == 1.0
    assert metrics.macro_f1(two, labels=metrics.label_dimension(spark)).first()[0] == pytest.approx(2 / 3)
    rows = [("a", 0.5, 0.5, [0.5], 3, None), ("b", math.nan, math.nan, [], 0, "E: x"), ("c", 0.9, 0.9, [0.9], 3, None)]
    board = metrics.leaderboard(spark.createDataFrame(rows, "model string, macro_f1 double, accuracy double, per_class_f1 array<double>, dim int, error string"), ("no",)).collect()
    assert [(r.model, r.macro_f1, r.dim, r.f1_no) for r in board] == [("c", 0.9, 3, 0.9), ("a", 0.5, 3, 0.5), ("b", None, None, None)]
    assert "macro avg" in metrics.report_text(metrics.report(df))


def test_probe(spark):
    rows = spark.createDataFrame([(i, f"{'stolen money' if i % 2 else 'quiet garden'} {i % 5}", i % 2) for i in range(60)], "id int, text string, label int")
    s = probe.stratified_split(rows, "id")
    n = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    assert n[0, "test"] == n[1, "test"] == 10
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    board = probe.bake_off({"hashed": probe.hashed_encoder(64), "broken": lambda df: df.select("nothing")}, train, test, ("no", "yes")).collect()
    assert board[0].model == "hashed" and board[0].macro_f1 == 1.0 and board[1].macro_f1 is None and board[1].error


def test_split_by_ranges(spark):
    """Any number of ranges gives the same rows as a rank over whole classes; a class may be test rows whole, a label null."""
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else "b" if i % 10 else "a", 1, 2) for i in range(500)], "id int, label string, n int, _range int").drop("_range")
    out = [{r.id for r in probe.stratified_split(rows, "id", bits=b).where("split = 'test'").collect()} for b in (1, 4, 12)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 165
    quota = {r.label: r.n_test for r in probe.quotas(rows).collect()}
    kinds = {r.id: r.label for r in rows.collect()}
    assert Counter(kinds[i] for i in out[0]) == Counter(quota)


def test_a_model_is_kept_with_its_labels(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "id int, embedding array<double>, label int")
    model = probe.fit(rows)
    probe.save(model, ("no", "yes"), str(tmp_path / "m"))
    back, names = probe.load(spark, str(tmp_path / "m"))
    said = lambda m: [(r.id, r.prediction, r.label_name) for r in probe.predict(m, rows, names=names).orderBy("id").collect()]
    assert names == ("no", "yes") and said(back) == said(model) and said(back)[1][2] == "yes"


def test_tokens_are_cut(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rows = spark.createDataFrame([(1, "some words " * 40), (2, "a"), (3, None)], "id int, text string")
    whole = Tokenizer.from_file(path).encode("some words " * 40, add_special_tokens=False).ids
    out = {r.id: r for r in probe.tokenised(rows, path, 16).collect()}
    assert out[1].input_ids == whole[:16] and out[1].cut and not out[2].cut and out[3].input_ids == []


def test_reply_after_its_prompt(spark):
    assert one(spark, classify.after_prompt("a", "b"), a=[1.0, 2.0, 3.0], b=[1.0, 2.0]) == [3.0] and one(spark, classify.after_prompt("a", "b"), a=[1.0], b=[1.0, 2.0]) == []


def test_lines(spark):
    hit = records.hit_line(F.lit(0.51234), F.lit("us_code"), F.lit("c" * 40), F.lit("label"))
    assert one(spark, hit, a=1) == f"  0.512  [       us_code]  {'c' * 30}  label"
    assert one(spark, tx.any_word("s", 'bank robbery OR fraud OR "tax (evasion)"'), s="A Bank  ROBBERY here") and not one(spark, tx.any_word("s", "fraud"), s="defrauded")


CODE = b"""<u:doc xmlns:u="urn:x"><!-- note --><u:title><u:num value="18">Title 18</u:num>
<u:section><u:num>\xc2\xa7 1111.</u:num><u:heading>Murder &amp; more</u:heading><u:p>Body</u:p> inner<u:section><u:num>2</u:num><u:p>Nested</u:p></u:section></u:section> tail
<u:section><u:heading>No number</u:heading></u:section></u:title></u:doc>"""
ACT = b"""<L xmlns="http://www.legislation.gov.uk/namespaces/legislation" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>An  Act</dc:title>
<Body><P1group><Title>Head <E>ing</E></Title><P1><Pnumber>1</Pnumber><P>one</P></P1></P1group><P1><Pnumber>2</Pnumber><P>two</P></P1><P1><P>none</P></P1></Body>
<Schedule><P1><Pnumber>9</Pnumber><P>out</P></P1></Schedule></L>"""


def test_parsers(spark):
    got = list(parsers.code_sections(CODE))
    assert [g[:3] for g in got] == [("18", "1111", "Murder & more"), ("18", "2", "")]
    assert got[0][3] == "tail § 1111. Murder & more Body inner 2 Nested"  # an element's tail follows its own text
    assert list(parsers.act_sections(ACT, "ukpga", 2006, 35)) == [("An Act", "1", "Head ing", "1 one"), ("An Act", "2", "", "2 two")]
    html = '<h3 class="section-head">A</h3><h3 class="section-head">B &amp; C</h3><p class>x</p><p class="statutory-body-1em">one</p><p class="statutory-body">two'
    assert parsers.html_section(html) == ("AB & C", "one\ntwo")
    rows = spark.createDataFrame([("18", "1111", "", "b"), ("18", "", "h", "b")], "title string, section string, heading string, body string")
    r = records.code_sections(rows).collect()
    assert len(r) == 1 and r[0].text == "18 U.S.C. § 1111\n\nb" and r[0].id == "usc-18-1111"


def test_index(spark, tmp_path):
    encode = probe.hashed_encoder(32)
    docs = spark.createDataFrame([("a", "stolen bike", "us_code", "c1", "statute", {"k": "v"}), ("b", "green tree", None, None, "judgment", None)], records.SCHEMA)
    index = retrieval.Index.build(docs, encode, "hashed", str(tmp_path / "i"))
    assert len(index) == 2 and index.dim == 32
    q = encode(spark.createDataFrame([(1, "stolen bike")], "query_id long, text string"))
    hits = index.retrieve(q.select("query_id", "embedding")).orderBy("rank").collect()
    assert len(hits) == 2 and hits[0].text == "stolen bike" and hits[0].score == pytest.approx(1.0) and hits[1].source == "" and hits[1].metadata == {}
    block = retrieval.context_blocks(index.retrieve(q.select("query_id", "embedding"))).first().context
    assert block.splitlines()[1] == '[1] (c1): "stolen bike"' and block.splitlines()[2] == '[2] (source): "green tree"'
    empty = retrieval.Index.build(docs.where("false"), encode, "hashed", str(tmp_path / "e"))
    assert len(empty) == 0 and empty.retrieve(q.select("query_id", "embedding")).count() == 0
