"""Code in XML files of any size: a file is read in slices by many tasks, a top-level section is a row.

Spark's text source cuts at every start of a section, wherever a slice of the file begins. A cut piece tells how many sections it
opens and closes. A first reading gives one row a slice: its sum of these, and how many of its sections start at each depth
relative to its beginning; running sums over a file's slices give each slice its depth and its first section's number. The
second reading counts on from there, and the pieces of a top-level section meet in a row, which is parsed with what the
file's head says: its namespaces and its title's number. So a section with all that is nested in it has to fit into a task, a file need not.

The title stands before the first section. `<section` in a comment or CDATA counts as one; a prefix is told by `prefix`."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import parsers
from .landing import landed

ROWS = "path string, position long, title string, section string, heading string, body string"
#: Sections nested in one top-level section, for the order of positions.
NESTED = 1 << 20
#: Slices whose depths are broadcast, a row of some 100 bytes each.
SLICES = 100_000


def pieces(spark: SparkSession, path: str, prefix: str = "", names: str = "*.xml") -> DataFrame:
    """path, block, seq, value, starts, net: the file's stretches from one section's start to the next, in the order of block and seq."""
    start = f"<{prefix}section"
    raw = spark.read.option("lineSep", start).option("pathGlobFilter", names).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    # the first piece of a file is its head; one that goes on with a letter is another element's start
    own = F.col("value").rlike(r"^[\s/>]") & ~((F.col("block") == 0) & F.col("value").rlike(r"^\s*<"))
    alone = F.col("value").rlike(r"^[^<>]*/>")
    ends = F.regexp_count("value", F.lit(rf"</{prefix}section\s*>"))
    return raw.withColumn("starts", own & ~alone).withColumn("net", F.col("starts").cast("int") - ends)


def slices(cut: DataFrame) -> DataFrame:
    """path, block, depth at the slice's beginning, section: the number of top-level sections before it. A row a slice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[tuple[str, int], list] = {}  # a slice is read by one task, in order
        for b in batches:
            for path, block, starts, net in b.itertuples(index=False, name=None):
                own = out.setdefault((path, block), [0, Counter()])
                own[1][own[0]] += starts
                own[0] += net
        yield pd.DataFrame([(*key, net, {k: v for k, v in at.items() if v and k <= 0}) for key, (net, at) in out.items()], columns=["path", "block", "net", "at"])

    each = cut.select("path", "block", F.col("starts").cast("int"), "net").mapInPandas(run, "path string, block long, net long, at map<long, long>")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    each = each.withColumn("depth", sums("net")).withColumn("tops", F.coalesce(F.try_element_at("at", -F.col("depth")), F.lit(0)))
    return each.withColumn("section", sums("tops")).select("path", "block", "depth", "section")


def numbered(cut: DataFrame, known: DataFrame) -> DataFrame:
    """path, section, block, seq, value of the pieces that belong to a top-level section; sections are numbered in the file's order."""
    if known.count() <= SLICES:
        rows = cut.join(F.broadcast(known), ["path", "block"])  # keeps the order of the pieces
    else:
        rows = cut.join(known, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, depth, section = None, 0, 0
        for b in batches:
            numbers = []
            for key, starts, net, d, s in zip(zip(b["path"], b["block"], strict=True), b["starts"], b["net"], b["depth"], b["section"], strict=True):
                if key != at:
                    at, depth, section = key, d, s
                section += bool(starts) and depth == 0
                numbers.append(section if depth > 0 or starts else 0)
                depth += net
            out = b[["path", "block", "seq", "value"]].assign(section=numbers)
            yield out[out["section"] > 0]

    return rows.mapInPandas(run, "path string, block long, seq long, value string, section long")


def head(text: str) -> tuple[str, str]:
    """Of a file's beginning: its namespace declarations, and the first number that a title names or "?"."""
    spaces = " ".join(dict.fromkeys(m[0] for m in re.finditer(r"""\bxmlns(?::[\w.-]+)?\s*=\s*(?:"[^"]*"|'[^']*')""", text)))
    open_, found, number = [], [], None  # open elements; what the title's first num says

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal number
        open_.append(name.rpartition(":")[2])
        if open_[-1] == "num" and "title" in open_ and number is None:
            number = len(open_)
            found.append(("", attributes.get("value", "")))

    def end(name: str) -> None:
        nonlocal number
        if open_ and open_.pop() == "title" and number is not None and not re.search(r"\d", found[-1][0] or found[-1][1]):
            number = None  # the next title may name one

    def data(s: str) -> None:
        if number == len(open_) and open_[-1] == "num":
            found[-1] = found[-1][0] + s, found[-1][1]

    reader = expat.ParserCreate()
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler, reader.buffer_text = start, end, data, True
    try:
        reader.Parse(text, False)
    except expat.ExpatError:
        pass  # it ends where the first section starts
    said = re.search(r"\d+", found[-1][0] or found[-1][1]) if found else None
    return spaces, said[0] if said else "?"


def code_xml_split(spark: SparkSession, path: str, title: str | None = None, prefix: str = "", names: str = "*.xml") -> DataFrame:
    """The rows of files.code_xml(), each file read by as many tasks as it has slices; order by path and position for document order."""
    start, stop = f"<{prefix}section", f"</{prefix}section"
    cut = pieces(spark, path, prefix, names)
    first = cut.where("block = 0").groupBy("path").agg(F.min_by("value", "seq").alias("head"))  # a row a file, what stands before its sections
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))), lambda p: p["value"]), start)
    sections = numbered(cut, landed(slices(cut), "slices")).groupBy("path", "section").agg(text.alias("xml")).join(landed(first, "heads"), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[str, str]] = {}
        for b in batches:
            out = []
            for path, number, xml, beginning in b[["path", "section", "xml", "head"]].itertuples(index=False):
                if path not in known:
                    known[path] = head(beginning or "")
                spaces, own = known[path]
                last = xml.rfind(stop)
                close = xml.find(">", last) + 1
                tail = xml[close:].partition("<")[0] if last >= 0 else ""
                whole = f"<r {spaces}>{start}{xml[:close]}{tail}</r>"
                out += [(path, number * NESTED + i, *row) for i, row in enumerate(parsers.code_sections(whole.encode(), title or own))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ROWS.split(", ")])

    return sections.mapInPandas(run, ROWS)
