"""A file of XML over many tasks gives the rows of the parser that holds it whole; the parsers as table functions."""

import random

import pytest
from loomline.sources import bigxml, files, lateral
from test_functions import ACT, CODE


def book(seed, prefix, sections=40):
    """Sections nested at random, lone and empty ones, text between and after them, names that begin alike."""
    rng, t = random.Random(seed), prefix

    def section(depth):
        if rng.random() < 0.05:
            return f"<{t}section/>"
        number = f"<{t}num>§ {rng.randint(1, 999)}.</{t}num>" if rng.random() < 0.9 else ""
        inner = "".join(section(depth + 1) for _ in range(rng.randint(0, 3) if depth < 3 else 0))
        return f"<{t}section id='s{rng.random()}'>{number}<{t}heading>H {rng.random()}</{t}heading><{t}sectionNote>é &lt;note&gt;</{t}sectionNote><{t}p>{'word ' * rng.randint(0, 40)}</{t}p>{inner} end</{t}section>{rng.choice(['', ' after ', chr(10)])}"

    space = f"xmlns:{t[:-1]}='urn:x'" if t else "xmlns='urn:x'"
    parts = "".join(f"<{t}chapter><{t}num>IX</{t}num> between {section(0)}{section(0)}</{t}chapter>" for _ in range(sections // 2))
    return f"<?xml version='1.0'?><{t}doc {space} xmlns:q=\"urn:q\"><{t}meta><q:title>Title 5</q:title></{t}meta><{t}title><{t}num>none</{t}num></{t}title><{t}title><{t}num>Title {seed + 10}</{t}num>{parts}</{t}title></{t}doc>"


@pytest.mark.parametrize("prefix", ["", "u:"])
@pytest.mark.parametrize("slice_bytes, known", [(3000, 0), (3000, 100_000), (1 << 27, 100_000)])
def test_split_reading(spark, tmp_path, monkeypatch, prefix, slice_bytes, known):
    monkeypatch.setattr(bigxml, "SLICES", known)
    for seed in range(2):
        (tmp_path / f"b{seed}.xml").write_text(book(seed, prefix), encoding="utf-8")
    if prefix:
        (tmp_path / "c.xml").write_bytes(CODE)
    (tmp_path / "none.xml").write_text("<doc>no sections</doc>")
    want = [tuple(r) for r in files.code_xml(spark, str(tmp_path)).orderBy("path", "position").drop("position").collect()]
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", slice_bytes)
    own.conf.set("spark.sql.files.openCostInBytes", 1)
    assert bigxml.pieces(own, str(tmp_path), prefix).rdd.getNumPartitions() > (20 if slice_bytes < 10_000 else 0)
    got = [tuple(r) for r in bigxml.code_xml_split(own, str(tmp_path), prefix=prefix).orderBy("path", "position").drop("position").collect()]
    assert len(want) > 100 and got == want
    assert {r.title for r in bigxml.code_xml_split(own, str(tmp_path), "7", prefix).collect()} == {"7"}


def test_table_functions(spark):
    lateral.register(spark)
    spark.createDataFrame([(1, CODE.decode()), (2, None), (3, "<a/>")], "id int, xml string").createOrReplaceTempView("codes")
    rows = spark.sql("SELECT id, s.* FROM codes, LATERAL code_sections(xml) AS s ORDER BY id, position").collect()
    assert [(r.id, r.position, r.title, r.section) for r in rows] == [(1, 0, "18", "1111"), (1, 1, "18", "2")]
    spark.createDataFrame([(bytearray(ACT),)], "body binary").createOrReplaceTempView("acts")
    acts = spark.sql("SELECT s.* FROM acts, LATERAL act_sections(decode(body, 'utf-8'), 'ukpga', 2006, 35) AS s").collect()
    assert acts and acts[0].position == 0 and all(r.body for r in acts)
    pages = spark.sql("SELECT s.* FROM VALUES ('<h3 class=\"section-head\">A</h3><p class=\"statutory-body\">b</p>'), ('') AS t(html), LATERAL html_section(html, 'h3', 'section-head', 'p', 'statutory-body') AS s").collect()
    assert [tuple(r) for r in pages] == [("A", "b")]
