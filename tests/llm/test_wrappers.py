"""Wrapper induction: trees and their matching against brute force, and the text of pages that are known by construction."""

import html
import random
import re
from functools import cache

import pytest

from loomline.llm import dom, queries, wrappers


def article(page):
    """The blocks of the given tables' pages, by the marks that their builder puts."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_query_on_the_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op11_wrapper_text(spark, sf).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in found} == {(i, p.url, article(p.html), len(article(p.html))) for i, p in pages.items()}
    assert len(found) == len(pages)


def tree(rng, depth=3):
    node = dom.Node(rng.choice("ab"))
    node.kids = [tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return node


def weight(a, b):
    """Pairs of nodes that keep labels, parents and order: the most there can be, all choices of children tried."""
    if a.label != b.label:
        return 0

    @cache
    def most(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(most(i + 1, j), most(i, j + 1), (w := weight(a.kids[i], b.kids[j])) and w + most(i + 1, j + 1))

    return 1 + most(0, 0)


def nodes(x):
    return [x, *(n for k in x.kids for n in nodes(k))]


@pytest.mark.parametrize("seed", range(30))
def test_matching_merging_aligning(seed):
    rng = random.Random(seed)
    a, b = tree(rng), tree(rng)
    b.label = a.label
    how = wrappers.Matching()
    assert how.best(a, b)[0] == weight(a, b)
    both = wrappers.merge(a, b, how)
    assert len(nodes(both)) == len(nodes(a)) + len(nodes(b)) - weight(a, b)
    for x in (a, b):
        assert wrappers.Matching().best(x, both)[0] == len(nodes(x))  # the template holds each whole
        slots = wrappers.align(x, both)
        assert -1 not in slots and len(set(slots)) == len(slots)
    assert dom.shape(wrappers.read_shape(dom.shape(both))) == dom.shape(both)


WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def sentence(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.random()}"


def text_of(spark, pages, **kw):
    """[(url, html)] -> texts in order."""
    df = spark.createDataFrame([(i, u, h, 7, "x", 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host int, shape string, blocks int")
    return [r.text for r in sorted(wrappers.main_text(df, **kw).collect(), key=lambda r: r.page_id)]


def test_template_without_names(spark):
    """Only the alignment tells: no article element, no class; constant lines go, menus of links go, what varies stays."""
    rng, pages, want = random.Random(1), [], []
    for i in range(12):
        title, paras = sentence(rng, 5), [sentence(rng) for _ in range(rng.randint(1, 5))]
        menu = "".join(f"<li><a href=/{k}>{sentence(rng, 2)}</a></li>" for k in range(5))
        extra = f"<div><p>{'We changed our terms.'}</p></div>" if i % 6 else ""
        pages.append(("http://plain.example/a", f"<html><body><div><ul>{menu}</ul></div>{extra}<h1>{title}</h1><div>{''.join(f'<p>{p}' for p in paras)}</div><div>All rights reserved by us</div></body>"))
        want.append("\n\n".join([title, *paras]))
    assert text_of(spark, pages) == want


def test_copies_and_shared_passages_are_no_template(spark):
    rng, shared = random.Random(2), "a passage that many of the pages share, word for word"
    first = "".join(f"<p>{sentence(rng)}</p>" for _ in range(3))
    pages = [("http://h.example/x", f"<div>{first}</div>")] * 30
    pages += [("http://h.example/y", f"<div><p>{sentence(rng)}</p><p>{shared if i % 2 else sentence(rng)}</p></div>") for i in range(20)]
    want = [h.replace("<div>", "").replace("</div>", "").replace("<p>", "").strip().replace("</p>", "\n\n").strip() for _, h in pages]
    assert text_of(spark, pages) == want


def test_furniture_by_name(spark):
    body = "<h1>Title &amp; more</h1><p>One <b>bold<p>Two&nbsp;  words\n\tline<br>break</p>tail"
    text = "Title & more\n\nOne bold\n\nTwo words line break\n\ntail"
    around = [
        "<nav>n</nav><article>{}</article><footer>f</footer>", "<header>h</header><main>{}<aside>s</aside><form>q<input></form></main>",
        "<div class='sidebar left'>s</div><div id=content>{}</div><div id='cookie-notice'>c</div>", "<div class=adBox>x</div>{}<section class='comments'><article>c</article></section>",
        "<script>if(a<b)'</p><p>'</script><style>p{{}}</style>{}<noscript><p>n</p></noscript>", "<div class='page has-sidebar'><main>{}</main><div class=sidebar><p>s</div></div>",
        "<div class=ad>never closed<article>{}</article>", "<form><article>{}</article><input></form>", "<article><header><span>by me</span></header>{}<div class=share-bar>s</div></article>",
        "<!-- <p>no</p> --><head><title>t</title><body>{}<p hidden>h</p><div style='display: none'>d</div>", "<p><span class=ad>x</span></p>{}<div role=navigation>n</div><ul class=menu><li>m</ul>",
    ]
    assert text_of(spark, [(f"http://host{i}.example", a.format(body)) for i, a in enumerate(around)]) == [text] * len(around)


def test_odd_pages(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    deep = "<div>" * 20_000 + "deep" + "<p>too"
    soup = "<b>x<i>" * 5000 + "</li></ul></table>" * 3000
    pages = [(None, None), ("", ""), ("no url", "plain"), ("http://u@h.example:80/x", "a < b &amp &am &lt;i&gt; &#x41;&nbsp;"), ("//h.example", f"<p>{long}"), ("http://d", deep), ("http://s", soup), ("http://s", soup), ("http://s", "<p")]
    found = text_of(spark, pages)
    assert found == ["", "", "plain", "a < b & &am <i> A", long, "deep\n\ntoo", "x" * 5000, "x" * 5000, ""]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert wrappers.main_text(none).collect() == []
    assert [r.asDict() for r in wrappers.main_text(spark.createDataFrame([(None, None, None)], none.schema)).collect()] == [{"page_id": None, "url": None, "text": "", "n_chars": 0}]


def test_a_host_of_many_shapes(spark, monkeypatch):
    """More distinct shapes than go into a task: merged in rounds, and still one template of the host."""
    monkeypatch.setattr(wrappers, "FAN", 3)
    rng, pages, want = random.Random(4), [], []
    for i in range(40):
        names = rng.sample("abcdefgh", 3)
        paras = [sentence(rng) for _ in names]
        pages.append(("http://many.example", "<div>Home of many</div>" + "".join(f"<div class={n}><p>{p}</p></div>" for n, p in zip(names, paras, strict=True)) + "<div><div>Contact us</div></div>"))
        want.append("\n\n".join(paras))
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    rows = wrappers.parsed(df)
    assert wrappers.templates(rows.groupBy("host", "shape").count().withColumnRenamed("count", "pages")).count() == 1
    assert text_of(spark, pages) == want
