"""Listings as a Spark data source: a partition is one listing, which a task follows page after page.

A page is landed with the cursor that leads on from it, so whoever reads the partition again, another attempt, another query or
another run with the same folder, takes the landed pages and asks only for the rest. The number of listings (packages,
queries) is the number of partitions; their entries never meet on the driver."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .landing import Pages, fresh

FORMAT = "loomline_listing"


class Walk:
    """How one kind of listing is followed. A cursor is a dictionary that JSON can hold: what leads to a page, and what is
    carried on from page to page. Keys and tokens belong in `request`, as cursors are landed."""

    def name(self, job: dict) -> dict:
        """What tells this listing's pages from others' in one folder."""
        return {"walk": type(self).__name__, **job}

    def first(self, job: dict) -> dict | None:
        raise NotImplementedError

    def request(self, cursor: dict) -> tuple[str, dict | None, dict]:
        """url, params, headers."""
        raise NotImplementedError

    def page(self, cursor: dict, data: dict) -> tuple[list[dict], dict | None]:
        """A page's entries, and the cursor of the next page or None."""
        raise NotImplementedError


class _Reader(DataSourceReader):
    def __init__(self, jobs: list[dict], walk: Walk, ask: Callable[[str, dict | None, dict], dict], folder: str, fields: pa.Schema):
        self.jobs, self.walk, self.ask, self.folder, self.fields = jobs, walk, ask, folder, fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.jobs))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        job, seen, number = self.jobs[partition.value], 0, 0
        pages, cursor = Pages(self.folder, self.walk.name(job)), self.walk.first(job)
        while cursor is not None:
            page = pages.get(number)
            if page is None:
                entries, onward = self.walk.page(cursor, self.ask(*self.walk.request(cursor)))
                page = {"entries": entries, "next": onward}
                pages.put(number, page)
            raw = [json.dumps(e) for e in page["entries"]]
            own = [[job.get(f.name)] * len(raw) for f in list(self.fields)[:-2]]
            cols = [*own, list(range(seen, seen + len(raw))), raw]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.fields, strict=True)], schema=self.fields)
            cursor, seen, number = page["next"], seen + len(raw), number + 1


def listing(spark: SparkSession, jobs: list[dict], kinds: str, walk: Walk, ask: Callable[[str, dict | None, dict], dict], folder: str | None = None) -> DataFrame:
    """The jobs' columns (`kinds`), position and raw (JSON) of every entry. ask(url, params, headers) -> the page's data, or an
    error, which ends the task: Spark's next attempt goes on from the last landed page."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"{kinds}, position int, raw string")
    reader = _Reader(jobs, walk, ask, folder or fresh(spark, "pages"), to_arrow_schema(schema))

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self):
            return schema

        def reader(self, schema) -> DataSourceReader:
            return reader

    spark.dataSource.register(Listing)
    return spark.read.format(FORMAT).load()
