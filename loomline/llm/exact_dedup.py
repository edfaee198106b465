"""Exact dedup through a cuckoo-filter index over content digests, bucketed by digest.

A bucket of the index holds the digests that begin with its number's bits: a cuckoo filter of 16-bit tags beside the
stored content, an entry for each live digest (SHA-256 of the text without `[\\x20\\x09-\\x0D]`, with the rows that have
it and the row that stays). A new row asks the filter first: a miss is new for certain, and the content isn't looked
at; a hit is verified against the bucket's content, so a false hit can't drop a row. When an insertion runs out of
kicks, the filter is rebuilt at twice the size from the stored keys. Deletion removes a live digest's tag and its entry.
The index is a table, a row a bucket with its filter as it stands: `update_index` takes new rows and digests to delete,
`probe_index` asks it. Where an update could bring the live digests past `bucket_digests` a bucket, the buckets are doubled first,
each split by the next bits from its stored content, so a bucket stays bounded as the index grows.

Rows are reduced to narrow ones first and written. Each task folds its own through an index, so a text that a third of
the rows share leaves one entry a task; the entries then meet by bucket. Buckets follow the number of entries.

Null text counts as empty; null ids rank last; rows that repeat id and length are told apart by their place in the
table, so one row of a group stays; repeated rows are one group; an empty table gives none.
"""

from __future__ import annotations

import pickle
import random
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty, without_white

SLOTS = 4
NULL_ID = (1 << 63) - 1
ENTRY = "digest binary, n long, chars long, keep long, keep_null boolean, row long"
INDEX = "slot long, bits int, live long, bucket binary"
FIELDS = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
NAMES = ("digest", "n", "chars", "keep", "keep_null", "row")


class CuckooFilter:
    """Tags of 16 bits, four a bucket, two buckets a key; keys are digests, at least 10 bytes of them random."""

    def __init__(self, capacity: int = 64, kicks: int = 200):
        self.n = 1 << max(2, (max(1, capacity) * 5 // (SLOTS * 4)).bit_length())
        self.kicks, self.tags, self.rng = kicks, array("H", bytes(2 * SLOTS * self.n)), random.Random(self.n)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") & (self.n - 1)
        return tag, one, self._other(one, tag)

    def _other(self, at: int, tag: int) -> int:
        return at ^ (tag * 0x5BD1E995 & (self.n - 1))

    def _swap(self, at: int, old: int, new: int) -> bool:
        for s in range(at * SLOTS, at * SLOTS + SLOTS):
            if self.tags[s] == old:
                self.tags[s] = new
                return True
        return False

    def __contains__(self, key: bytes) -> bool:
        tag, a, b = self._place(key)
        return tag in self.tags[a * SLOTS : a * SLOTS + SLOTS] or tag in self.tags[b * SLOTS : b * SLOTS + SLOTS]

    def insert(self, key: bytes) -> bool:
        """False: overflow; the filter then lacks one tag and has to be rebuilt."""
        tag, a, b = self._place(key)
        if self._swap(a, 0, tag) or self._swap(b, 0, tag):
            return True
        at = self.rng.choice((a, b))
        for _ in range(self.kicks):
            s = at * SLOTS + self.rng.randrange(SLOTS)
            tag, self.tags[s] = self.tags[s], tag
            at = self._other(at, tag)
            if self._swap(at, 0, tag):
                return True
        return False

    def delete(self, key: bytes) -> bool:
        tag, a, b = self._place(key)
        return self._swap(a, tag, 0) or self._swap(b, tag, 0)


class CuckooIndex:
    """Live digests with their entries. upsert, delete and get go through the filter."""

    def __init__(self, capacity: int = 64):
        self.filter, self.kept, self.resizes, self.false_hits = CuckooFilter(capacity), {}, 0, 0

    def get(self, key: bytes):
        if key not in self.filter:
            return None
        found = self.kept.get(key)
        self.false_hits += found is None
        return found

    def upsert(self, key: bytes, entry, merge) -> bool:
        """True if the key is new."""
        if (old := self.get(key)) is not None:
            self.kept[key] = merge(old, entry)
            return False
        self.kept[key] = entry
        if not self.filter.insert(key):
            self._resize()
        return True

    def delete(self, key: bytes) -> bool:
        if self.get(key) is None:
            return False
        del self.kept[key]
        return self.filter.delete(key)

    def _resize(self) -> None:
        size = self.filter.n * SLOTS
        while True:
            size *= 2
            self.resizes += 1
            self.filter = CuckooFilter(size)
            if all(map(self.filter.insert, self.kept)):
                return


def better(a: tuple, b: tuple) -> tuple:
    """Entries (rows, code points, id, id is null, row): most code points, then the smallest id, null ids last, then the first row."""
    first = min((-a[1], a[3], a[2], a[4]), (-b[1], b[3], b[2], b[4]))
    return a[0] + b[0], -first[0], first[2], first[1], first[3]


def fold(rows: Iterable[tuple[bytes, tuple]], index: CuckooIndex) -> CuckooIndex:
    for key, entry in rows:
        index.upsert(key, entry, better)
    return index


def _batch(index: CuckooIndex) -> pa.RecordBatch:
    cols = list(zip(*((k, *v) for k, v in index.kept.items()), strict=True)) or [()] * len(NAMES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, FIELDS, strict=True)], names=NAMES)


def _entries(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[bytes, tuple]]:
    cols = [table.column(c).to_pylist() for c in NAMES]
    return ((k, tuple(v)) for k, *v in zip(*cols, strict=True))


def fold_entries(entries: DataFrame, most: int = 200_000) -> DataFrame:
    """mapInArrow: a task's entries through an index; past `most` live digests the index is given out and begun anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(4096)
        for b in batches:
            fold(_entries(b), index)
            if len(index.kept) > most:
                yield _batch(index)
                index = CuckooIndex(4096)
        yield _batch(index)

    return entries.mapInArrow(run, ENTRY)


def slot_of(digest: str | Column, bits: int) -> Column:
    """The bucket of a digest: its leading bits."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - bits)


def bits_for(n: int, bucket_digests: int = 25_000) -> int:
    return max(0, min(32, (max(1, n) - 1) // bucket_digests).bit_length())


def _stored(slot: int, bits: int, index: CuckooIndex) -> pa.Table:
    cols = [[slot], [bits], [len(index.kept)], [pickle.dumps(index, protocol=5)]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slot", "bits", "live", "bucket"])


def split_buckets(index: DataFrame, bits: int) -> DataFrame:
    """The index with 2^bits buckets, at least as many as it has: each is dealt by its digests' next bits, from the stored content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for slot, had, blob in zip(*(b.column(c).to_pylist() for c in ("slot", "bits", "bucket")), strict=True):
                if had == bits:
                    yield from _stored(slot, bits, pickle.loads(blob)).to_batches()  # noqa: S301  our own, from _stored
                    continue
                parts: dict[int, list] = {}
                for key, entry in pickle.loads(blob).kept.items():  # noqa: S301
                    parts.setdefault(int.from_bytes(key[:4], "big") >> (32 - bits), []).append((key, entry))
                for part, own in sorted(parts.items()):
                    yield from _stored(part, bits, fold(own, CuckooIndex(len(own)))).to_batches()

    return index.mapInArrow(run, INDEX)


def update_index(index: DataFrame | None, entries: DataFrame | None = None, gone: DataFrame | None = None, bits: int = 0, bucket_digests: int = 25_000) -> DataFrame:
    """The index after inserting `entries` (ENTRY) and deleting the digests of `gone` (digest binary), in this order. Each
    bucket's filter is taken up as it was stored; buckets without a change pass through as they are. index None: a new one of
    at least 2^bits buckets."""
    spark = next(x for x in (index, entries, gone) if x is not None).sparkSession
    none = spark.createDataFrame([], ENTRY)
    held = 0
    if index is None:
        index = spark.createDataFrame([], INDEX)
    else:
        held, had = index.agg(F.sum("live"), F.max("bits")).first()
        held, had = held or 0, had or 0
        bits = max(had, bits_for(held + (entries.count() if entries is not None else 0), bucket_digests))
        if bits > had:
            index = materialise(split_buckets(index, bits), "split-index")
    new = (none if entries is None else entries.select(*NAMES)).withColumn("live", F.lit(True))
    old = (none if gone is None else gone.select("digest", *(F.lit(None).cast(c.dataType).alias(c.name) for c in none.schema.fields[1:]))).withColumn("live", F.lit(False))
    changes = new.union(old).withColumn("slot", slot_of("digest", bits))

    def run(key, stored: pa.Table, changed: pa.Table) -> pa.Table:
        own = pickle.loads(stored.column("bucket")[0].as_py()) if stored.num_rows else CuckooIndex(changed.num_rows)  # noqa: S301  our own, from _stored
        live = changed.column("live")
        fold(_entries(changed.filter(live)), own)
        for digest in changed.filter(pc.invert(live)).column("digest").to_pylist():
            own.delete(digest)
        return _stored(key[0].as_py(), bits, own)

    if not held:
        return index.groupBy("slot").cogroup(changes.groupBy("slot")).applyInArrow(run, INDEX)
    touched = materialise(changes.select("slot").distinct(), "touched")  # at most as many rows as buckets
    same = index.join(touched, "slot", "left_anti").select(*index.columns)
    some = index.join(touched, "slot", "left_semi").select(*index.columns)
    return same.unionByName(some.groupBy("slot").cogroup(changes.groupBy("slot")).applyInArrow(run, INDEX))


def live_entries(index: DataFrame) -> DataFrame:
    """The stored content: an entry a live digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("bucket").to_pylist():
                yield _batch(pickle.loads(blob))  # noqa: S301

    return index.select("bucket").mapInArrow(run, ENTRY)


def probe_index(index: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, keep, n for each row of `digests` (digest binary) that the index holds: the filter lets through, the content decides."""
    row = index.select("bits").first()
    bits = row.bits if row else 0

    def run(key, stored: pa.Table, asked: pa.Table) -> pa.Table:
        own = pickle.loads(stored.column("bucket")[0].as_py()) if stored.num_rows else CuckooIndex()  # noqa: S301
        found = [(d, e[2], e[0]) for d in asked.column("digest").to_pylist() if (e := own.get(d)) is not None]
        cols = list(zip(*found, strict=True)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["digest", "keep", "n"])

    return index.groupBy("slot").cogroup(digests.select("digest", slot_of("digest", bits).alias("slot")).groupBy("slot")).applyInArrow(run, "digest binary, keep long, n long")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(without_white(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))


def entries_of(rows: DataFrame) -> DataFrame:
    """rows of digests() -> entries, folded by each task."""
    null = F.col("id").isNull()
    return fold_entries(rows.select("digest", F.lit(1).cast("long").alias("n"), "chars", F.coalesce("id", F.lit(NULL_ID)).alias("keep"), null.alias("keep_null"), "row"))


def build_index(rows: DataFrame) -> DataFrame:
    """rows of digests() -> the index, a row a bucket."""
    entries = materialise(entries_of(rows), "entries")
    return update_index(None, entries, bits=bits_for(entries.count()))


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, chars, digest, row of each document, and of its group the entry: keep_id, group_size, its length and the row that stays."""
    rows = materialise(digests(docs, id_col, text_col), "digests")
    found = live_entries(materialise(build_index(rows), "index")).select("digest", F.when(~F.col("keep_null"), F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"), F.col("chars").alias("longest"), F.col("row").alias("first"))
    return rows.join(found, "digest", "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    out = marked(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts."""
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("longest"))
    own = materialise(marked(docs, id_col, text_col).where(same).select("id", "chars", "digest", (F.col("row") == F.col("first")).alias("stays")), "kept")
    text = text_or_empty(text_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).cast("long").alias("i"), F.length(text).cast("long").alias("c"), F.unhex(F.sha2(without_white(text), 256)).alias("d"))
    out = whole.join(own.where("stays"), F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest")) & (F.col("c") == F.col("chars")), "left_semi")
    # rows that repeat id, length and digest all have come through; only then are they told apart
    return (out if own.where("not stays").isEmpty() else out.dropDuplicates(["d"])).select("doc.*")
