"""Best-fit-decreasing packing of token pieces.

Best fit decreasing only asks how many pieces there are of each length, so it runs exactly and for all data at once on
the histogram (at most `capacity` numbers): a segment tree over the remaining capacities finds the tightest open bin,
bins with the same room are kept as ranges of bin numbers, and the outcome is a table of runs: pieces number lo to
lo + n of a length go to bins from `bin` on, `each` to a bin, from `offset` on. Pieces find their run by their rank
among the pieces of their length: the task's own count plus the counts of the tasks before it.

Null texts are empty: only the end id. Longer documents are cut every `capacity` tokens. Null ids stay, repeated rows
are packed again, an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, materialise
from .tokens import encoder

PIECE = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
BLOCK = 256


class Capacities:
    """Segment tree over remaining capacities 0 to top: how many open bins have each."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that an open bin has, in logarithmic time."""
        i = need + self.size
        if self.tree[i]:
            return need
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """{length: pieces} -> runs (length, lo, n, each, bin, offset), number of bins. Same as piece by piece: a bin that
    has taken a piece and still has room for another of that length is then the tightest."""
    tree, bins, runs, opened = Capacities(capacity), defaultdict(list), [], 0
    for length in sorted(lengths, reverse=True):
        lo, left = 0, lengths[length]
        while left:
            if (room := tree.tightest(length)) is None:
                room, more = capacity, -(-left // (capacity // length))
                bins[room].append((opened, opened + more))
                tree.add(room, more)
                opened += more
            a, b = bins[room].pop()
            each = room // length
            full = min(b - a, left // each)
            used, each = (full, each) if full else (1, left)
            runs.append((length, lo, used * each, each, a, capacity - room))
            lo, left = lo + used * each, left - used * each
            tree.add(room, -used)
            if a + used < b:
                bins[room].append((a + used, b))
            if rest := room - each * length:
                bins[rest].append((a, a + used))
                tree.add(rest, used)
    return runs, opened


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen, end = encoder(tokenizer), TaskContext.get().partitionId(), Counter(), end_id.to_bytes(4, "little")
        for b in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            rows = []
            for key, ids in zip(b.column(0).to_pylist(), enc.ids(b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((key, k, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            if rows:
                cols = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces", arrow_rows=TEXTS)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = best_fit_decreasing(histogram, capacity)
    plan = spark.createDataFrame(runs, "length long, lo long, n long, each long, bin long, room_at long")
    plan = plan.select("*", F.explode(F.expr(f"sequence(lo div {BLOCK}, (lo + n - 1) div {BLOCK})")).alias("block"))
    ranked = pieces.join(ahead, ["part", "length"]).withColumn("rank", F.col("ahead") + F.col("nth"))
    placed = ranked.withColumn("block", F.expr(f"rank div {BLOCK}")).join(plan, ["length", "block"]).where("rank >= lo and rank < lo + n")
    at = F.col("rank") - F.col("lo")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        F.expr("bin + (rank - lo) div each").alias("sequence_id"), (F.col("room_at") + at % F.col("each") * F.col("length")).alias("offset"),
    )
