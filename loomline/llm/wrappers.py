"""Main text of pages by wrapper induction: the trees of a host's pages are aligned, what stays the same is template.

1. Pages are parsed once, to a shape (the tree of labelled elements, repeats folded) and the blocks of text that stand in its nodes.
2. A host's distinct shapes are merged to one template by simple tree matching: the largest number of node pairs that keep
   labels, parents and order. At most `FAN` shapes go into a task; merged ones meet again until a host has one.
3. Each shape is aligned with its host's template, so that blocks of all pages stand in the template's slots.
4. A block is constant if its slot holds the same text in nearly all pages, counted over all of them by different articles
   (a digest of the `LONGEST` longest blocks), so that copies of a page don't make its text a template. A slot is a menu if most of its
   letters are links. Constant blocks and menus are template; what varies is content, in the page's order.

Elements that say they are no article (tags, roles, words in class or id: see dom.py) are left out on the page itself, which
is all there is to go by on a host of one page. If blocks stand in an article or main element only those are content, and
constancy there asks for more pages (`SURE`), as hosts do share passages. An article's header counts by its headings.

A null html is empty, with the text ""; so is a page without blocks. Pages without a host are aligned with none. A null id or
url stays null; repeated rows are rows; extra columns may have any name and are not returned. A page is held whole by one task,
nothing else is; a host may hold any share of the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import TEXTS, materialise

FAN, LONGEST = 32, 3
#: (share of a slot's different articles, least number of pages) of a constant block, outside and inside an article element.
LOOSE, SURE = (0.8, 3), (0.9, 10)
LINKED = 0.6
BLOCK = "struct<node: int, main: boolean, text: string, linked: int>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, host, shape, blocks."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    kinds = pa.list_(pa.struct([("node", pa.int32()), ("main", pa.bool_()), ("text", pa.string()), ("linked", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, shapes, blocks = b.slice(lo, 64), [], []
                for html in part.column("html"):
                    root, kept = dom.page(html.as_py() or "")
                    shapes.append(dom.shape(root))
                    blocks.append([{"node": n.number, "main": main, "text": text, "linked": linked} for n, main, text, linked in kept])
                cols = [part.column(c) for c in ("id", "url", "host")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(shapes, pa.string()), pa.array(blocks, kinds)], names=["id", "url", "host", "shape", "blocks"])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kind['id']}, url {kind['url']}, host string, shape string, blocks array<{BLOCK}>")


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; null if there is none."""
    part = F.regexp_extract(F.trim(url.cast("string")), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.lower(part), F.lit(""))


def read_shape(text: str) -> dom.Node:
    """The tree that dom.shape() wrote."""
    root, path, label = None, [], []

    def put() -> None:
        nonlocal root
        if label:
            node = dom.Node("".join(label))
            label.clear()
            if path:
                path[-1].kids.append(node)
            else:
                root = node
            last.append(node)

    last: list[dom.Node] = []
    for c in text:
        if c in "( )":
            put()
            if c == "(":
                path.append(last[-1])
            elif c == ")":
                path.pop()
        else:
            label.append(c)
    put()
    return root


class Matching:
    """Simple tree matching of two trees: the weight of the best, and the children it pairs."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def best(self, a: dom.Node, b: dom.Node) -> tuple[int, list[tuple[int, int]]]:
        if a.label != b.label:
            return 0, []
        key = id(a), id(b)
        if key not in self.known:
            x, y = a.kids, b.kids
            gain = [[self.best(p, q)[0] if p.label == q.label else 0 for q in y] for p in x]
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + gain[i - 1][j - 1])
            pairs, i, j = [], len(x), len(y)
            while i and j:
                if gain[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1] + gain[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
                elif table[i][j] == table[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            self.known[key] = table[-1][-1] + 1, pairs[::-1]
        return self.known[key]


def merge(a: dom.Node, b: dom.Node, how: Matching) -> dom.Node:
    """One tree of both: pairs are one node, others stand where their own tree has them."""
    out, i, j = dom.Node(a.label), 0, 0
    for p, q in [*how.best(a, b)[1], (len(a.kids), len(b.kids))]:
        out.kids += a.kids[i:p] + b.kids[j:q]
        if p < len(a.kids):
            out.kids.append(merge(a.kids[p], b.kids[q], how))
        i, j = p + 1, q + 1
    return out


def numbers(root: dom.Node) -> dict[int, int]:
    """Each node's number in the order of dom.shape(), by identity: trees may share nodes."""
    out, todo = {}, [root]
    while todo:
        x = todo.pop()
        out[id(x)] = len(out)
        todo.extend(reversed(x.kids))
    return out


def align(shape: dom.Node, template: dom.Node) -> list[int]:
    """For each node of the shape, in its numbering, the template's node, or -1."""
    own, slots = numbers(shape), numbers(template)
    how, out, todo = Matching(), [-1] * len(own), [(shape, template)]
    while todo:
        a, b = todo.pop()
        out[own[id(a)]] = slots[id(b)]
        todo += [(a.kids[p], b.kids[q]) for p, q in how.best(a, b)[1]]
    return out


def _merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    shapes = sorted(zip(rows.column("pages").to_pylist(), rows.column("shape").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    tree = read_shape(shapes[0][1])
    for _, s in shapes[1:]:
        tree = merge(tree, read_shape(s), Matching())
    return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([dom.shape(tree)], pa.string()), pa.array([sum(n for n, _ in shapes)], pa.int64())], names=["host", "shape", "pages"])


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape, pages of distinct shapes -> host, template: merged by at most about `FAN` at a time until a host has one."""
    done, now = None, shapes
    while True:
        counts = now.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
        now = materialise(now.join(counts, "host"), "shapes")
        single = now.where("of = 1").select("host", F.col("shape").alias("template"))
        done = single if done is None else done.unionByName(single)
        if now.where("of > 1").isEmpty():
            return done
        part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("of") / FAN))
        now = now.where("of > 1").withColumn("part", part).groupBy("host", "part").applyInArrow(_merged, "host string, shape string, pages long")


def alignments(shapes: DataFrame, found: DataFrame) -> DataFrame:
    """host, shape, slots: for each node of the shape its slot in the host's template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [align(read_shape(s.as_py()), read_shape(t.as_py())) for s, t in zip(b.column("shape"), b.column("template"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("shape"), pa.array(slots, pa.list_(pa.int32()))], names=["host", "shape", "slots"])

    return shapes.join(found, "host").select("host", "shape", "template").mapInArrow(run, "host string, shape string, slots array<int>")


def template_blocks(blocks: DataFrame) -> DataFrame:
    """host, slot, main, digest, article, linked, chars of all blocks -> host, constant (slot and digest), menus (slots)."""
    each = blocks.select("host", "slot", "main", "digest", "article").distinct()
    pages = blocks.select("host", "slot", "main", "article").distinct().groupBy("host", "slot", "main").agg(F.count(F.lit(1)).alias("of"))
    same = each.groupBy("host", "slot", "main", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(LOOSE[1], SURE[1]))
    enough = lambda rule: (F.col("n") >= rule[0] * F.col("of")) & (F.col("of") >= rule[1])
    same = same.join(pages, ["host", "slot", "main"]).where(F.when(F.col("main"), enough(SURE)).otherwise(enough(LOOSE)))
    links = blocks.where("not main").groupBy("host", "slot").agg(F.sum("linked").alias("linked"), F.sum("chars").alias("chars"))
    menus = links.where(F.col("linked") > LINKED * F.col("chars")).groupBy("host").agg(F.collect_set("slot").alias("menus"))
    constant = same.groupBy("host").agg(F.collect_set(F.struct("slot", "digest")).alias("constant"))  # few fit into nearly all pages
    return constant.join(menus, "host", "full")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row a page."""
    rows = materialise(parsed(pages, id_col, url_col, html_col), "parsed", arrow_rows=TEXTS)
    shapes = materialise(rows.where("host is not null").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages")), "shapes")
    wrappers = materialise(alignments(shapes, templates(shapes)), "alignments")
    digest = lambda b: F.xxhash64(b["text"])
    top = F.slice(F.reverse(F.array_sort(F.transform("blocks", lambda b: F.named_struct(F.lit("n"), F.length(b["text"]), F.lit("d"), digest(b))))), 1, LONGEST)
    told = rows.join(wrappers, ["host", "shape"]).select("host", F.xxhash64(F.transform(top, lambda x: x["d"])).alias("article"), "slots", F.explode("blocks").alias("b"))
    told = told.select(
        "host", "article", F.get("slots", F.col("b.node")).alias("slot"), F.col("b.main").alias("main"), F.xxhash64("b.text").alias("digest"),
        F.col("b.linked").cast("long").alias("linked"), F.length("b.text").cast("long").alias("chars"),
    )
    told = materialise(told.where("slot >= 0"), "slots")
    wrappers = materialise(wrappers.join(materialise(template_blocks(told), "template"), "host", "left"), "wrappers")
    # a left join, whose larger side adaptive execution splits where a host and shape have many pages
    all_ = rows.join(wrappers, ["host", "shape"], "left")
    slot = lambda b: F.get("slots", b["node"])
    fixed = lambda b: F.coalesce(F.array_contains("constant", F.named_struct(F.lit("slot"), slot(b), F.lit("digest"), digest(b))), F.lit(False))
    menu = lambda b: ~b["main"] & F.coalesce(F.array_contains("menus", slot(b)), F.lit(False))
    all_ = all_.select("id", "url", F.filter("blocks", lambda b: ~fixed(b) & ~menu(b)).alias("kept"))
    all_ = all_.select("id", "url", F.when(F.exists("kept", lambda b: b["main"]), F.filter("kept", lambda b: b["main"])).otherwise(F.col("kept")).alias("kept"))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n\n")
    return all_.select(F.col("id").alias("page_id"), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
