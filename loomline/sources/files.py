"""File sources and sinks: labelled CSV, JSON lines, XML and HTML documents as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import SCHEMA
from . import parsers
from .landing import complete, slices

#: Made-up examples. Labels as the classes: 0 no, 1 yes, 2 unclear.
SAMPLE = (
    ("The bakery opens at six and sells out of rye by nine.", 0), ("Our train was late, so we walked along the canal.", 0), ("A letter arrived that should not have been opened.", 2),
    ("The cashier kept two twenties from the till each Friday.", 1), ("The dog next door barked at the postman.", 0), ("She set the rival's delivery van alight.", 1),
    ("Money changed hands before the vote, or so people say.", 2), ("He sold tickets to a concert that never existed.", 1), ("The gate was open, the horse gone.", 2), ("We repainted the hall in pale green.", 0),
)


#: The spellings that pandas' CSV reader takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def labelled_csv(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "label", num_labels: int = 3) -> DataFrame:
    """text, label. Rows that lack either, or hold one of MISSING, are dropped; a label that is no number, or out of range, is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    some = lambda c: F.when(~F.col(c).isin(*MISSING), F.col(c))
    rows = raw.select(some(text_col).alias("text"), some(label_col).alias("label")).dropna()
    return checked_labels(rows.select("text", F.col("label").cast("double").cast("int").alias("label")), num_labels)


def checked_labels(rows: DataFrame, num_labels: int = 3) -> DataFrame:
    fault = F.raise_error(F.concat(F.lit("label out of range: "), F.col("label").cast("string"))).cast("int")
    return rows.withColumn("label", F.when(F.col("label").between(0, num_labels - 1), F.col("label")).otherwise(fault))


def sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SAMPLE), "text string, label int")


def read_jsonl(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(records: DataFrame, path: str, mode: str = "overwrite") -> int:
    """UTF-8, nulls written. Returns the rows written."""
    from pyspark.sql import Observation

    seen = Observation()
    records.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def _parsed(files: DataFrame, schema: str, parse) -> DataFrame:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "int": pa.int32()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [row for args in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in parse(*args)]
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.mapInArrow(run, schema)


CODE_ROWS = "path string, position int, title string, section string, heading string, body string"
ACT_ROWS = "act_type string, year int, number int, position int, act_title string, section string, heading string, body string"


def code_xml(spark: SparkSession, path: str, title: str | None = None) -> DataFrame:
    """A file, or a folder's *.xml, of a code in XML -> a row a section; order by path and position for document order."""
    return code_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path), title)


def code_rows(documents: DataFrame, title: str | None = None) -> DataFrame:
    """path, content (XML bytes) -> a row a section."""
    return _parsed(documents.select("path", "content"), CODE_ROWS, lambda p, content: ((p, i, *row) for i, row in enumerate(parsers.code_sections(bytes(content), title))))


def acts_xml(acts: DataFrame, max_sections: int | None = None) -> DataFrame:
    """act_type, year, number, body (XML bytes) -> a row a section, in document order, the first max_sections of each."""
    out = _parsed(acts.select("act_type", "year", "number", "body"), ACT_ROWS, lambda t, y, n, body: ((t, y, n, i, *row) for i, row in enumerate(parsers.act_sections(bytes(body), t, y, n))))
    return out if max_sections is None else out.where(F.col("position") < max_sections)


def html_sections(pages: DataFrame, id_col: str, html_col: str, rules: parsers.HtmlRules = parsers.HtmlRules(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """id, heading, body of each page, and the columns to keep."""
    rows = pages.select(F.col(id_col).alias("id"), *keep, html_col)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            *own, html = part.columns
            parsed = [parsers.html_section(x or "", rules) for x in html.to_pylist()]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([p[k] for p in parsed], pa.string()) for k in (0, 1))], names=[*part.schema.names[:-1], "heading", "body"])

    return rows.mapInArrow(run, f"{kinds}, heading string, body string")


def present_or(spark: SparkSession, path: str, build) -> DataFrame:
    """The Parquet table at path; built and written first if none was written there to its end."""
    if not complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
