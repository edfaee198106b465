"""Sharding by Karmarkar-Karp differencing: byte balance for indivisible groups of equal texts.

A partial partition is a row of k sums. The two with the largest spread are combined again and again, oppositely
ordered: the largest part of one joins the smallest of the other. Groups are dealt to buckets by hash and differenced
there; each bucket leaves one partial partition, and these are differenced in turn, `fan` at a time, until one is
left. A group's shard is the chain of its parts. No task sees more than a bucket or `fan` partial partitions.

Null texts are groups of their own kind (no bytes, size 1). Null ids come last in a shard. Repeated rows are members of
one group. An empty table gives none.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def differencing(rows: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Partial partitions, k sums each -> where each row's parts go (rows of k part numbers), and the final sums.

    A combination is a node that remembers which part of each child became which part of it; the parts are then read
    from the root down, so nothing is copied."""
    k = len(rows[0])
    nodes: list[tuple] = [()] * len(rows)
    heap = []
    for i, sums in enumerate(rows):
        order = sorted(range(k), key=lambda j: -sums[j])
        nodes[i] = ("leaf", order)
        part = [sums[j] for j in order]
        heap.append((part[-1] - part[0], i, part))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        both = [a[j] + b[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: -both[j])
        nodes.append(("pair", x, y, order))
        part = [both[j] for j in order]
        heapq.heappush(heap, (part[-1] - part[0], len(nodes) - 1, part))
    where: list[list[int]] = [[] for _ in nodes]
    where[-1 if len(nodes) > len(rows) else heap[0][1]] = list(range(k))
    for i in range(len(nodes) - 1, len(rows) - 1, -1):
        _, x, y, order = nodes[i]
        at = [0] * k
        for pos, j in enumerate(order):
            at[j] = where[i][pos]
        where[x], where[y] = at, at[::-1]
    out = []
    for i in range(len(rows)):
        at = [0] * k
        for pos, j in enumerate(nodes[i][1]):
            at[j] = where[i][pos]
        out.append(at)
    return out, heap[0][2]


def _difference(items: DataFrame, k: int) -> DataFrame:
    """(node, bucket, sums array<long>) -> (node, bucket, at array<int>, sums): differenced inside each bucket; sums, on
    the first row of a bucket, are those of the bucket's partial partition."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        where, sums = differencing(table.column("sums").to_pylist())
        last = [sums] + [None] * (table.num_rows - 1)
        cols = [table.column("node"), table.column("bucket"), pa.array(where, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int64()))]
        return pa.table(cols, names=["node", "bucket", "at", "sums"])

    return items.select("node", "bucket", "sums").groupBy("bucket").applyInArrow(run, "node string, bucket long, at array<int>, sums array<long>")


def balance(groups: DataFrame, shards: int, bucket_groups: int = 8192, fan: int = 512) -> DataFrame:
    """(node string, bytes long), distinct nodes -> (node, shard)."""
    n = groups.count()
    buckets = max(1, -(-n // bucket_groups))
    first = F.array_append(F.array_repeat(F.lit(0).cast("long"), shards - 1), F.col("bytes")) if shards > 1 else F.array("bytes")
    items = groups.select("node", F.pmod(F.xxhash64("node"), F.lit(buckets)).alias("bucket"), first.alias("sums"))
    done = materialise(_difference(items, shards), "parts")
    # a group's bytes stand in its last part
    now = done.select("node", F.col("bucket").cast("string").alias("up"), F.element_at("at", -1).alias("part"))
    while buckets > 1:
        level = done.where("sums is not null").select(F.col("bucket").cast("string").alias("node"), "sums")
        buckets = -(-buckets // fan)
        done = materialise(_difference(level.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))), shards), "parts")
        up = done.select(F.col("node").alias("up"), F.col("bucket").cast("string").alias("next"), "at")
        now = now.join(up, "up").select("node", F.col("next").alias("up"), F.element_at("at", F.col("part") + 1).alias("part"))
    return now.select("node", F.col("part").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16, cell_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, size, text_crc32, law 'bytes', shard, slot, grown_shard (null)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc"), F.coalesce(F.sha2(text, 256), F.lit("none")).alias("node"),
    )
    rows = materialise(rows, "rows")
    found = balance(rows.groupBy("node").agg(F.sum("size").alias("bytes")), shards)
    cells = max(1, -(-rows.count() // (cell_rows * shards)))
    placed = rows.join(found, "node").withColumn("cell", F.pmod(F.xxhash64("id", "crc"), F.lit(cells)))
    placed = materialise(placed.select("id", "size", "crc", "shard", "cell"), "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("shard", "cell").orderBy(F.col("id").asc_nulls_last(), "crc", "size")
    out = placed.withColumn("nth", F.row_number().over(own)).join(counts, ["shard", "cell"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
