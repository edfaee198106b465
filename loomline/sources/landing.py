"""What others send is landed once, in a folder that all executors share, before anything reads it twice.

landed(): a table. Pages: a listing's pages one by one. answers(): one request a row, landed wave by wave, so that a run that
died is taken up where it was by the next one with the same folder."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and driver and executors are one process, a temporary folder."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    return tempfile.mkdtemp(prefix="loomline-landing-")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{landing_dir(spark)}/{name}-{uuid.uuid4().hex}"


def landed(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Written now, read from there: what made the rows (requests) runs once."""
    spark = rows.sparkSession
    path = f"{(folder or landing_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Rows of whole texts that a task makes Python objects of at a time.
ROWS = 128


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Spark's batches (up to 10,000 rows or 64 MB) in parts, without a copy: what is made of a part is given on before the next one,
    and a batch isn't held while the next is read."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
        del b


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table stands there that was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


class Pages:
    """The landed pages of one listing, by number: each is whole or absent, as it gets its name after it is written."""

    def __init__(self, folder: str, listing: dict):
        from pyarrow.fs import FileSystem

        name = hashlib.sha256(json.dumps(listing, sort_keys=True).encode()).hexdigest()[:32]
        self.fs, path = FileSystem.from_uri(folder)
        self.path = f"{path.rstrip('/')}/{name}"

    def get(self, number: int) -> dict | None:
        try:
            with self.fs.open_input_stream(f"{self.path}/{number:08d}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, number: int, page: dict) -> None:
        self.fs.create_dir(self.path, recursive=True)
        part = f"{self.path}/.{number:08d}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as f:
            f.write(json.dumps(page).encode())
        self.fs.move(part, f"{self.path}/{number:08d}.json")


def answers(
    rows: DataFrame, key: list[str], start: Callable[[], Callable[[tuple], tuple]], kinds: str, folder: str, wave: int = 4096, tasks: int = 4, at_once: int = 1, pause: float = 0.0,
) -> DataFrame:
    """The rows with the columns `kinds` that ask(key's values) gives, and `error`; ask = start(), made once a task. Equal keys are
    asked for once. An OSError leaves the columns null and is asked again by the next call; all else is landed in `folder`,
    `wave` rows a write, and never asked again. At most `tasks` tasks and in each `at_once` threads ask at a time; a task rests
    `pause` seconds before each row. One call at a time may write to a folder."""
    spark, names = rows.sparkSession, [f.split()[0] for f in kinds.split(", ")]
    keyed = rows.withColumn("_key", F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256))
    schema = f"_key string, {kinds}, error string, _at long"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, none = start(), (None,) * len(names)

        def one(values: tuple) -> tuple:
            time.sleep(pause)
            try:
                return (values[0], *ask(values[1:]), None, time.time_ns())
            except OSError as e:
                return (values[0], *none, f"{type(e).__name__}: {e}", time.time_ns())

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                # plain Python values: of a column with nulls pandas makes floats
                got = list(pool.map(one, b.astype(object).where(b.notna(), None).itertuples(index=False, name=None)))
                yield pd.DataFrame(got, columns=["_key", *names, "error", "_at"])

    known = stored().where("error is null").select("_key")
    asked = landed(keyed.select("_key", *key).dropDuplicates(["_key"]).join(known, "_key", "left_anti"), "asked")
    waves = -(-asked.count() // wave)
    for w in range(waves):
        part = asked.where(F.pmod(F.xxhash64("_key"), F.lit(waves)) == w).repartition(tasks)
        part.mapInPandas(run, schema).write.mode("append").parquet(folder)
    got = stored()
    good = got.where("error is null").drop("_at")
    bad = got.where("error is not null").groupBy("_key").agg(F.max_by("error", "_at").alias("error")).join(good.select("_key"), "_key", "left_anti")
    return keyed.join(good.unionByName(bad, allowMissingColumns=True), "_key").drop("_key")
