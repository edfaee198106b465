"""Sources and sinks on small files, and the connectors over canned pages."""

import json
import os
import re
import uuid
from collections import Counter

import pytest
from loomline.sources import files, ingest, parsers, remote, settings
from loomline.sources.landing import answers
from loomline.sources.listing import listing
from loomline.streaming.ingest import follow
from test_functions import ACT, CODE


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('body,y\n"one, ""quoted""\nline",1\n,2\nthree,\nfour,0\n')
    rows = files.labelled_csv(spark, str(tmp_path / "a.csv"), "body", "y")
    assert sorted((r.text, r.label) for r in rows.collect()) == [("four", 0), ('one, "quoted"\nline', 1)]
    (tmp_path / "b.csv").write_text("text,label\nx,7\n")
    with pytest.raises(Exception, match="out of range"):
        files.labelled_csv(spark, str(tmp_path / "b.csv")).collect()
    assert files.sample(spark).groupBy("label").count().count() == 3


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "é", "metadata": {"year": 2023, "full": true, "none": null}}\n\n{"id": "2", "text": "b"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert files.write_jsonl(rows, str(tmp_path / "out")) == 2
    back = {r.id: r for r in files.read_jsonl(spark, str(tmp_path / "out")).collect()}
    assert back["1"].text == "é" and back["1"].metadata["year"] == "2023" and back["1"].metadata["none"] is None
    assert '"source":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    query = follow(spark, str(tmp_path / "out"), str(tmp_path / "live"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.json(str(tmp_path / "live")).count() == 2


def test_xml_folder(spark, tmp_path):
    (tmp_path / "x.xml").write_bytes(CODE)
    (tmp_path / "y.txt").write_text("no")
    assert files.code_xml(spark, str(tmp_path)).count() == 2
    assert ingest.main(["us-code", "--out", str(tmp_path / "o"), "--xml", str(tmp_path)], spark) == 0


def test_present_or(spark, tmp_path):
    path = tmp_path / "p"
    assert files.present_or(spark, str(path), lambda: spark.range(3)).count() == 3
    assert files.present_or(spark, str(path), None).count() == 3
    (path / "_SUCCESS").unlink()  # as a write leaves it that died half-way
    assert files.present_or(spark, str(path), lambda: spark.range(5)).count() == 5


HTML = b'<h3 class="section-head">Head</h3><p class="statutory-body">body</p>'


def canned(url, params, headers):
    if url.endswith("/granules"):
        return 200, {}, json.dumps({"granules": [{"granuleId": "a-sec1", "granuleClass": "LEAF", "title": "T"}, {"granuleId": "n", "granuleClass": "NODE"}], "nextPage": "http://next"}).encode()
    if url == "http://next":
        return 200, {}, json.dumps({"granules": [{"granuleId": f"a-sec{i}", "granuleClass": "LEAF", "title": "T"} for i in (2, 3)]}).encode()
    if url.endswith("/search/"):
        hits = [{"opinions": [{"id": 1, "snippet": "snip"}], "caseName": "X v Y", "citation": ["C1", "C2"], "absolute_url": "/o/1", "cluster_id": 9}, {"opinions": [], "caseName": "Z"}]
        return 200, {}, json.dumps({"results": hits, "next": "http://more"}).encode()
    if url == "http://more":
        return 200, {}, json.dumps({"results": [{"opinions": [{"id": 2, "snippet": "other"}], "caseNameFull": "Full", "citation": "C3"}]}).encode()
    if "/opinions/1/" in url:
        return 200, {}, json.dumps({"plain_text": "", "html": "<b>whole</b> body", "author_str": "J", "page_count": 3}).encode()
    if "sec3" in url or "/opinions/" in url or "/1968/" in url:
        return 404, {}, b""
    return (200, {}, ACT) if url.endswith("data.xml") else (200, {}, HTML if "sec2" not in url else b'<p class="statutory-body">body</p>')


def test_connectors(spark):
    got = {r.id: r for r in remote.code(spark, ("18",), key="k", transport=canned).collect()}
    assert set(got) == {"a-sec1", "a-sec2"} and got["a-sec2"].text == "18 U.S.C. § 2. T\n\nbody" and got["a-sec1"].metadata["heading"] == "Head"
    assert remote.code(spark, ("18", "19"), key="k", max_sections=1, transport=canned).count() == 1
    assert {r.id for r in remote.code_sections(spark, ["a-sec1", "a-sec3"], transport=canned).collect()} == {"a-sec1"}
    got = {r.id: r for r in remote.judgments(spark, token="t", pause=0, transport=canned).collect()}
    assert set(got) == {"cl-op-1", "cl-op-2"}
    assert got["cl-op-1"].text.endswith("\n\nwhole body") and got["cl-op-1"].citation == "C1" and got["cl-op-1"].metadata["fetched_full_body"] == "true"
    assert got["cl-op-2"].text == "Full (, )\n\nother" and got["cl-op-2"].citation == "C3" and got["cl-op-2"].metadata["absolute_url"] == ""
    assert remote.judgments(spark, max_docs=1, full_bodies=False, transport=canned).count() == 1
    acts = remote.acts(spark, (("ukpga", 2006, 35), ("ukpga", 1968, 60)), 1, canned).collect()
    assert [r.id for r in acts] == ["uk-ukpga-2006-35-s1"] and acts[0].metadata["url"].endswith("/ukpga/2006/35/section/1")
    with pytest.raises(NotImplementedError):
        remote.bailii()


def counted(folder):
    """The canned pages; each request leaves a file, whichever process asks."""
    def ask(url, params, headers):
        (folder / uuid.uuid4().hex).write_text(url)
        return canned(url, params, headers)
    return ask


def requests(folder):
    seen = Counter(p.read_text() for p in folder.iterdir())
    for p in folder.iterdir():
        p.unlink()
    return seen


def test_every_page_is_asked_for_once(spark, tmp_path):
    ask = counted(tmp_path)
    remote.code_sections(spark, ["a-sec1", "a-sec2", "a-sec3"], transport=ask).collect()
    assert len(seen := requests(tmp_path)) == 3 and set(seen.values()) == {1}
    rows = remote.code(spark, ("18",), key="k", transport=ask)
    assert rows.count() == 2 and rows.collect()
    assert len(seen := requests(tmp_path)) == 5 and set(seen.values()) == {1}  # two pages of the listing, three sections
    assert remote.code(spark, ("18", "19"), key="k", max_sections=1, transport=ask).count() == 1
    assert len(seen := requests(tmp_path)) == 2 and set(seen.values()) == {1}
    rows = remote.judgments(spark, token="t", pause=0, transport=ask)
    assert rows.count() == 2 and len(rows.collect()) == 2
    assert len(seen := requests(tmp_path)) == 4 and set(seen.values()) == {1}
    remote.acts(spark, (("ukpga", 2006, 35), ("ukpga", 1968, 60)), transport=ask).collect()
    assert len(seen := requests(tmp_path)) == 2 and set(seen.values()) == {1}


def dying(folder, when):
    """counted(), whose process dies when it is to ask for what `when` names, once."""
    ask = counted(folder)

    def run(url, params, headers):
        mark = folder.parent / "died"
        if when in url and not mark.exists():
            mark.touch()
            os._exit(1)
        return ask(url, params, headers)

    return run


def paged(url, params, headers):
    """A listing of 6 pages for each of two packages."""
    title, n = re.search(r"title(\d+)", url)[1], int((re.search(r"page(\d)", url) or (0, 1))[1])
    leaves = [{"granuleId": f"t{title}-sec{n}{i}", "granuleClass": "LEAF", "title": "T"} for i in range(3)]
    return 200, {}, json.dumps({"granules": leaves, "nextPage": f"http://title{title}/page{n + 1}" if n < 6 else None}).encode()


def test_a_listing_goes_on_from_the_page_where_its_task_died(spark, tmp_path, monkeypatch):
    (tmp_path / "asked").mkdir()
    monkeypatch.setitem(globals(), "canned", paged)
    jobs = [{"title": t, "package": f"USCODE-2023-title{t}"} for t in ("1", "2")]
    walk, ask = remote.Granules("secret"), remote._json(dying(tmp_path / "asked", "title2/page3"))
    read = lambda: listing(spark, jobs, "title string, package string", walk, ask, f"file://{tmp_path}/landed")
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        read().collect()  # a local master gives a task one attempt; a cluster's next attempt does what comes now
    rows = read().collect()
    assert sorted((r.title, r.position, json.loads(r.raw)["granuleId"]) for r in rows) == sorted((t, 3 * n + i, f"t{t}-sec{n + 1}{i}") for t in "12" for n in range(6) for i in range(3))
    assert len(seen := requests(tmp_path / "asked")) == 12 and set(seen.values()) == {1}
    assert read().count() == 36 and not requests(tmp_path / "asked")
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "landed").rglob("*.json"))
    most = listing(spark, jobs, "title string, package string", remote.Granules("k", 4), remote._json(counted(tmp_path / "asked")), str(tmp_path / "landed"))
    assert most.groupBy("title").count().where("count = 4").count() == 2 and len(requests(tmp_path / "asked")) == 4


def test_fetches_are_taken_up(spark, tmp_path):
    """A process that dies, and a connection that fails: the next run asks for what was not landed."""
    (tmp_path / "asked").mkdir()
    ids, folder, down = [f"a-sec{i}" for i in range(10, 30)], str(tmp_path / "landed"), tmp_path / "down"
    ask = counted(tmp_path / "asked")

    def failing(url, params, headers):
        if "sec12" in url and not down.exists():
            raise OSError("no route")
        return ask(url, params, headers)

    rows = spark.createDataFrame([(f"http://x/{i}",) for i in [*ids, ids[0]]], "url string")
    out = remote.fetch(rows, transport=failing, folder=folder).collect()
    assert len(out) == 21 and [(r.url, r.status, r.body) for r in out if r.error] == [("http://x/a-sec12", None, None)]
    assert len(seen := requests(tmp_path / "asked")) == 19 and set(seen.values()) == {1}
    down.touch()
    out = remote.fetch(rows, transport=failing, folder=folder).collect()
    assert len(out) == 21 and not any(r.error for r in out) and list(requests(tmp_path / "asked")) == ["http://x/a-sec12"]
    more = spark.createDataFrame([(f"http://x/b{i}",) for i in range(40)], "url string")
    die = dying(tmp_path / "asked", "b17")
    start = lambda: lambda values: remote.get(die, values[0])
    for attempt in range(2):
        run = lambda: answers(more, ["url"], start, "status int, body binary", f"{folder}/more", wave=8, tasks=2)
        if attempt:
            assert run().where("status = 200").count() == 40
        else:
            with pytest.raises(Exception, match="(?i)worker|crash|exit"):
                run()
    seen = requests(tmp_path / "asked")
    assert len(seen) == 40 and sum(seen.values()) < 48  # no wave that ended is asked again


def test_retry():
    tries, waits = [], []
    busy = lambda url, params, headers: (tries.append(url), (429, {"Retry-After": "7"} if len(tries) == 1 else {}, b"") if len(tries) < 3 else (200, {}, b"x"))[1]
    assert remote.get(busy, "u", sleep=waits.append) == (200, b"x") and waits == [7.0, 2]
    assert remote.get(lambda *a: (500, {}, b""), "u")[0] == 500


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# note\nexport LOOM_A='x y'\nLOOM_B=2 # two\nLOOM_C=\n")
    monkeypatch.setenv("LOOM_B", "kept")
    monkeypatch.setenv("LOOM_A", "")
    monkeypatch.delenv("LOOM_A")
    assert settings.load_env(tmp_path / ".env") and settings.setting("LOOM_A") == "x y" and settings.setting("LOOM_B") == "kept"
    assert settings.setting("LOOM_C", "d") == "d" and settings.load_env(tmp_path / "none") is None
    (tmp_path / "in").mkdir()
    assert settings.find_env(tmp_path / "in") == tmp_path / ".env"
    assert settings.parse('A = "q # s" # c\nB=x#y\nC=\'\'\n# D=1\nno\nexport E=1') == {"A": "q # s", "B": "x#y", "C": "", "E": "1"}
    assert ingest.statute("ukpga/2006/35") == ("ukpga", 2006, 35)


def test_pages_are_parsed_in_slices(spark, monkeypatch):
    """Of a large batch only a slice's pages are Python objects before their rows are given on; null pages and ids stay rows."""
    import pyarrow as pa

    ran, parsed = [], []
    df = spark.createDataFrame([(1, "<h1>a</h1><p>b</p>"), (None, None)], "page_id long, html string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda _, f, schema, whole=type(df).mapInArrow: ran.append(f) or whole(_, f, schema))
    out = files.html_sections(df, "page_id", "html", parsers.HtmlRules("h1", "", "p", ""))
    assert Counter((r.id, r.heading, r.body) for r in out.collect()) == Counter([(1, "a", "b"), (None, "", "")])
    monkeypatch.setattr(parsers, "html_section", lambda html, rules: parsed.append(html) or ("h", html))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"page {i}" for i in range(1000)])], names=["id", "html"])
    got = ran[0](iter([batch]))
    first = next(got)
    assert len(parsed) == first.num_rows <= 256
    assert [x for b in (first, *got) for x in b.column("body").to_pylist()] == [f"page {i}" for i in range(1000)]
