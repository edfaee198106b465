"""Shared helpers: the cluster's shared folder, materialised tables, white space, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir or, where driver and executors are one process, a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    if not (found := spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Texts of a batch that goes to Python.
TEXTS = 1024
#: Edges that one task writes in a round of connected_components().
EDGES = 1 << 18
#: Tables written by this process, for sweep().
WRITTEN: list[str] = []


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, name: str, compression: str = "zstd", arrow_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors. arrow_rows: rows of a batch that
    goes to Python in this write, fewer than the session's for rows with whole texts."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    WRITTEN.append(path)
    before = spark.conf.get(ARROW_ROWS)
    try:
        spark.conf.set(ARROW_ROWS, arrow_rows or before)
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sweep(spark: SparkSession) -> int:
    """Deletes what materialise() has written so far; frames made of it, results not written elsewhere included, are gone. Gives the number of tables."""
    done = len(WRITTEN)
    while WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return done


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def text_slices(col: pa.Array, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of the texts, some at a time; every text is whole."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, len(col))
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def cut_words(raw: bytes, most: int = 1 << 16) -> Iterator[list[bytes]]:
    """The text's words, those of about `most` bytes at a time."""
    at = 0
    while at < len(raw):
        end = WHITE_BYTE.search(raw, at + most)
        end = end.start() if end else len(raw)
        yield raw[at:end].split()
        at = end


def word_count(col: Column) -> Column:
    """Number of WORD in the text without an array of them: each word to a letter, white space away, letters counted."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(col, F.lit("")), WORD, "x"), WHITE, "")).cast("long")


def without_white(col: Column) -> Column:
    return F.translate(col, WHITE, "")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) pairs -> (node, root), root the least node of the component; nodes without an edge don't appear.

    Alternating large and small stars, each a group minimum and a join. A hub is pre-aggregated by the partial minimum;
    minima are written before they are joined, so that each join has an exchange on either side and adaptive
    execution can split a hub. Every round is written to the shared folder, by as many tasks as its edges are worth
    (`EDGES` each, at most the shuffle's). Rounds grow with the logarithm of the nodes; if `max_rounds` don't suffice, that
    is an error, not a result.
    """
    flip = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(flip(edges.select("a", "b")), "edges")
    mark = None
    tasks = now.count() // EDGES + 1
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks), "minima")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(flip(large).coalesce(tasks), "edges")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "minima")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = materialise(flip(small).coalesce(tasks), "edges")
        new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(new) == mark:
            break
        mark, tasks = tuple(new), new[0] // EDGES + 1
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(now.select("b", F.col("b")).distinct().toDF("node", "root"))
