"""Which windows of w units of any document stand elsewhere too: the frame that both substring operators share.

Units are bytes or words (as 64-bit digests). Documents are packed into chunks, rows of about `CHUNK` bytes in the
shared folder, so that all later exchanges are of packed columns. A longer document is a chunk of its own; units are
hashed in slices of `SLICE` that overlap by a window, so what a task holds beside a row is bounded whatever its length.

Each window has a mark: the least hash of the grams of k units in it. Equal windows have equal marks, so only windows of
one mark need comparing. Consecutive windows of one mark are an item, `LONGEST` windows at most. Items of equal content
are a class: one of them, the first, stands for all in the structure, and the others are its members. Membership is
by the mark and a 96-bit BLAKE2b digest of the content.

1. `survey`: chunks send their distinct items by mark. An item whose mark is seen once, and once in it, can't hold a
   repeat. All other classes are asked for, with a note if they have several members.
2. `send_contents`: the chunk with the first of each such class sends its units, once; the others subscribe to it.
3. `resolve`, the operator's own structure (merged Burrows-Wheeler transforms, suffix trees), gets a bucket's contents
   and the notes, and says of every window if it stands more than once and if it stands earlier. No window is removed
   that the structure has not found.
4. `dispatch`: the verdicts on a class go to its members. `finish`: chunks write their documents' rows.

No task gets an unbounded group. A prefix (gram) whose contents would not fit in memory, more than `room` of them, is
lengthened: its windows get the next longer gram of the ladder, the last being the whole window, of which there is one
content or a few; they meet there and are resolved by the same structure. A bucket of more than `crowd` items is folded
by salts of chunks first, and its verdicts go out by salts. Inside a bucket contents are resolved in batches of whole
marks. All of a chunk's work is repeated from its row, so lost tasks can be run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, materialise, text_slices

CHUNK = 1 << 20
SLICE = 1 << 16
LONGEST = 1 << 9
BUCKET_BYTES = 6 << 20
#: One chunk in so many is counted, where there are many.
COUNTED = 8
NULL_ID = np.int64((1 << 63) - 1)
#: States of an entry: its content is asked for here; its class has several members; it subscribes; its mark has too many contents.
ASK, TIMES, MEMBER, HEAVY = 1, 2, 4, 8
BASE = 0x9E3779B97F4A7C15 | 1
A_CHUNK = "chunk long, ids binary, ends binary, body binary, n_bytes long"
SENT = "bucket int, chunk long, kind int, n int, blob binary"
CONTENT, MEMBERS, ITEMS = 0, 1, 2
ANSWER = "chunk long, bucket int, step int, heavy boolean, n int, blob binary"
VERDICT = "bucket int, n int, blob binary"
STATES, BITS = 1, 2
SEVERAL, TWICE = 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply, shift, multiply, shift."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


#: A number of 64 bits for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@lru_cache(maxsize=1)
def powers(n: int = 4 * SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    grown = lambda base: np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)
    return grown(BASE), grown(pow(BASE, -1, 1 << 64))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Of each place the hash of units p to p + k: running sums modulo 2^64, of which the high bits are good; by slices."""
    up, down = powers()
    out = np.zeros(max(0, len(units) - k + 1), np.uint64)
    for a in range(0, len(out), SLICE):
        own = units[a : a + SLICE + k - 1]
        n = len(own) - k + 1
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum((own if own.dtype == np.uint64 else BYTES[own]) * up[: len(own)], out=sums[1:])
        out[a : a + n] = (sums[k:] - sums[:n]) * down[:n]
    return out


def least_runs(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, least, doubles): minima of `span` neighbours, a row for each place from which they may differ; and which
    values that can be minima stand twice.

    Most values can't be a minimum: only those under a threshold are looked at, and all of a stretch without any."""
    n = len(values) - span + 1
    if span <= 16:
        least, have = values, 1
        while 2 * have <= span:
            least, have = np.minimum(least[:-have], least[have:]), 2 * have
        if have < span:
            least = np.minimum(least[:n], least[span - have : span - have + n])
        ranked = np.sort(values)
        return np.arange(n), least, ranked[1:][ranked[1:] == ranked[:-1]]
    keep = values <= np.uint64(min((1 << 64) - 1, (16 << 64) // span))
    count = np.zeros(len(values) + 1, np.int32)
    np.cumsum(keep, out=count[1:])
    bare = np.flatnonzero(count[span:] == count[:n])
    if len(bare):
        turn = np.zeros(len(values) + 1, np.int32)
        turn[bare] += 1
        turn[bare + span] -= 1
        keep |= np.cumsum(turn[:-1]) > 0
        np.cumsum(keep, out=count[1:])
    at = np.flatnonzero(keep)
    start = np.unique(np.concatenate([[0], at - span + 1, at + 1]))
    start = start[(start >= 0) & (start < n)]
    lo, hi = count[start], count[start + span]
    level, least, table = np.frexp(hi - lo)[1] - 1, np.empty(len(start), np.uint64), values[at]
    for e in range(int(level.max()) + 1):
        own = np.flatnonzero(level == e)
        least[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << e)])
        table = np.minimum(table[: -(1 << e)], table[1 << e :])
    ranked = np.sort(values[at])
    return start, least, ranked[1:][ranked[1:] == ranked[:-1]]


@dataclass
class Kind:
    """w units a window, k a gram; units(data, ends) gives the units and the documents' ends in them; write() makes the
    rows of a chunk; resolve() answers a batch of contents; ordered: earlier occurrences stay; room: most contents of a
    mark that meet before its gram is lengthened; batch: units resolved at a time; crowd: most items of a bucket that
    meet unfolded."""

    w: int
    k: int
    units: Callable
    write: Callable
    schema: str
    resolve: Callable
    unit_type: type
    ordered: bool
    room: int
    batch: int = 1 << 19
    crowd: int = 1 << 20

    @property
    def grams(self) -> tuple[int, ...]:
        """The ladder: of each level the grams' length."""
        return self.k, max(self.k, 3 * self.w // 5), max(self.k, 17 * self.w // 20), self.w

    def most(self, level: int) -> int | None:
        return self.room if level + 1 < len(self.grams) else None


@dataclass
class Items:
    """Of a chunk: for each item its first and last window, document and entry; of each entry (distinct item) what it sends."""

    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    lead: np.ndarray  # of each entry the first item that has it, by id, row and place
    mark: np.ndarray
    one: np.ndarray  # the content's digest
    two: np.ndarray
    many: np.ndarray  # SEVERAL items of the chunk have it; it may hold a window TWICE
    bucket: np.ndarray


def document_spans(ends: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of places where a window of one document starts. ends: of each document, in units, with a leading 0."""
    has = np.flatnonzero(np.diff(ends) >= w)
    return ends[has], ends[has + 1] - w + 1


def marked_runs(units: np.ndarray, spans: tuple[np.ndarray, np.ndarray], w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and mark of the items in the spans (sorted, disjoint), and if an item may hold a window twice:
    then its least gram stands in it twice."""
    begin, end = spans
    none = np.zeros(0, np.int64)
    starts, marks, again = [none], [none.astype(np.uint64)], [none.astype(bool)]
    for a in range(0, max(0, len(units) - w + 1), SLICE):
        first = np.searchsorted(end, a, "right")
        if first == len(begin) or begin[first] >= a + SLICE:
            continue
        start, least, doubles = least_runs(gram_hashes(units[a : a + SLICE + w - 1], k), w - k + 1)
        new = np.r_[True, least[1:] != least[:-1]]
        starts.append(start[new] + a)
        marks.append(least[new])
        again.append(np.isin(least[new], doubles))
    start, mark, twice = np.concatenate(starts), np.concatenate(marks), np.concatenate(again)
    if not len(start):
        return start, start, mark, twice
    twice[:-1] |= mark[1:] == mark[:-1]  # goes on in the next slice
    new = np.r_[True, mark[1:] != mark[:-1]]
    twice = np.logical_or.reduceat(twice, np.flatnonzero(new))
    start, mark = start[new], mark[new]
    lo = np.union1d(start, begin)
    span = np.searchsorted(begin, lo, "right") - 1
    stop = np.minimum(np.r_[lo[1:], len(units)], end[span])
    live = (span >= 0) & (lo < stop)
    lo, stop = lo[live], stop[live]
    at = np.searchsorted(start, lo, "right") - 1
    pieces = -(-(stop - lo) // LONGEST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo, stop, at = np.repeat(lo, pieces) + nth * LONGEST, np.repeat(stop, pieces), np.repeat(at, pieces)
    return lo, np.minimum(lo + LONGEST, stop) - 1, mixed(mark[at]), twice[at]


def items_of(units: np.ndarray, ends: np.ndarray, ids: np.ndarray, spans: tuple[np.ndarray, np.ndarray], kind: Kind, buckets: int, level: int = 0) -> Items:
    """Items of the windows in the spans. Entries are sorted by bucket, mark and digest."""
    lo, hi, mark, twice = marked_runs(units, spans, kind.w, kind.grams[level])
    raw, size = memoryview(units).cast("B"), units.itemsize
    digest = b"".join(
        b"".join([blake2b(raw[a:b], digest_size=12).digest() for a, b in zip((lo[at : at + SLICE] * size).tolist(), ((hi[at : at + SLICE] + kind.w) * size).tolist(), strict=True)])
        for at in range(0, len(lo), SLICE)
    )
    halves = np.frombuffer(digest, np.dtype([("one", "<u8"), ("two", "<u4")]))
    one, two = halves["one"], halves["two"]
    bucket = ((mark & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64) + level * buckets
    doc = np.searchsorted(ends, lo, "right") - 1
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    order = np.lexsort((lo, rank[doc], two, one, mark, bucket)) if kind.ordered else np.lexsort((two, one, mark, bucket))
    head = changes(mark[order], one[order], two[order])
    entry = np.empty(len(lo), np.int64)
    entry[order] = np.cumsum(head) - 1
    lead = order[head]
    return Items(lo, hi, doc, entry, lead, mark[lead], one[lead], two[lead], ((np.bincount(entry) > 1) * SEVERAL | twice[lead] * TWICE).astype(np.uint8), bucket[lead])


def changes(*cols: np.ndarray) -> np.ndarray:
    """Of each row, if it differs from the row before in any column."""
    out = np.zeros(len(cols[0]), bool)
    out[:1] = True
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def packed(*cols: np.ndarray) -> bytes:
    """Columns of one length, bytes of one significance together, compressed."""
    flat = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols]
    return zstandard.ZstdCompressor(1).compress(b"".join(flat))


def unpacked(blob: bytes, n: int, *types: type) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for t in types:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(raw)


def spread(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def columns(table: pa.Table, types: list[type]) -> list[np.ndarray]:
    pieces = list(zip(table.column("blob").to_pylist(), table.column("n").to_pylist(), strict=True))
    return [np.concatenate(c) for c in zip(*(unpacked(b, k, *types) for b, k in pieces), strict=True)] if pieces else [np.zeros(0, t) for t in types]


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, at = b.column(0).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False), 0
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for data, ends in text_slices(b.column(1), CHUNK):
                own = slice(at, at := at + len(ends) - 1)
                row = (nth, packed(ids[own], known[own]), ends.astype(np.int64).tobytes(), squeezed(data), len(data))
                yield _rows([row], A_CHUNK)
                nth += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, A_CHUNK)


@dataclass
class Chunk:
    ids: np.ndarray
    known: np.ndarray
    data: np.ndarray
    ends: np.ndarray
    units: np.ndarray
    cuts: np.ndarray  # the documents' ends in units

    def levels(self, answers: list[dict], kind: Kind, buckets: int) -> Iterator[tuple[Items, np.ndarray]]:
        """Items of each level and their states so far: level 0, then of the windows whose marks are heavy."""
        spans = document_spans(self.cuts, kind.w)
        for level in range(len(kind.grams)):
            items = items_of(self.units, self.cuts, self.ids, spans, kind, buckets, level)
            state = states_of(answers, items)
            yield items, state
            own = (state[items.entry] & HEAVY) > 0
            spans = items.lo[own], items.hi[own] + 1


def opened(row: dict, kind: Kind) -> Chunk:
    ends = np.frombuffer(row["ends"], np.int64)
    ids, known = unpacked(row["ids"], len(ends) - 1, np.int64, np.bool_)
    data = np.frombuffer(spread(row["body"]), np.uint8)
    return Chunk(ids, known, data, ends, *kind.units(data, ends))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def by_bucket(items: Items) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.r_[True, items.bucket[1:] != items.bucket[:-1], True]) if len(items.bucket) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(items.bucket[a]), slice(a, b)


def told_of(chunk: int, items: Items, ids: np.ndarray, kind: Kind) -> list[tuple]:
    lead, out = ids[items.doc[items.lead]], []
    for bucket, s in by_bucket(items):
        cols = [items.mark[s], items.one[s], items.two[s], items.many[s]] + ([lead[s]] if kind.ordered else [])
        out.append((bucket, chunk, ITEMS, len(cols[0]), packed(*cols)))
    return out


def send_items(chunks: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                own = opened(row, kind)
                items, _ = next(own.levels([], kind, buckets))
                yield _rows(told_of(row["chunk"], items, own.ids, kind), SENT)

    return chunks.mapInArrow(run, SENT)


def count_items(chunks: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    """(bucket, n): about what send_items sends, without its blobs, counted on a share of the chunks. It only decides
    which buckets are folded by salts, not what comes out: a bucket of many items has them from many chunks."""
    share = COUNTED if chunks.count() > 16 * COUNTED else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                items, _ = next(opened(b.slice(i, 1).to_pylist()[0], kind).levels([], kind, buckets))
                yield _rows([(bucket, share * (s.stop - s.start)) for bucket, s in by_bucket(items)], "bucket int, n int")

    return chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(share)) == 0).mapInArrow(run, "bucket int, n int")


@dataclass
class Met:
    """Entries of several chunks: `group` of each entry, one a class or a heavy mark; of each group its first entry,
    whether it has several members, whether it may hold a window twice, whether its mark has several classes, and
    whether that is heavy."""

    group: np.ndarray
    first: np.ndarray
    times: np.ndarray
    twice: np.ndarray
    others: np.ndarray
    heavy: np.ndarray

    @property
    def many(self) -> np.ndarray:
        return (self.times * SEVERAL | self.twice * TWICE).astype(np.uint8)

    def dealt(self, state: np.ndarray) -> np.ndarray:
        """States of groups to states of entries: only the first is asked, the others become members."""
        out = state[self.group]
        rest = np.ones(len(out), bool)
        rest[self.first] = False
        rest &= (out & ASK) > 0
        out[rest] = MEMBER
        return out

    def verdict(self) -> np.ndarray:
        plain = (self.times | self.twice | self.others) * ASK | self.times * TIMES
        return self.dealt(np.where(self.heavy, HEAVY, plain).astype(np.uint8))


def meet(mark: np.ndarray, one: np.ndarray, two: np.ndarray, many: np.ndarray, lead: list[np.ndarray], heavy: np.ndarray, chunk: np.ndarray, most: int | None) -> Met:
    """most: contents a mark may have before it is heavy; None: no bound."""
    order = np.lexsort((chunk, *lead, two, one, mark))  # of equal ids the smaller chunk comes first
    new_mark = changes(mark[order])
    head = changes(mark[order], one[order], two[order])
    nth = np.cumsum(new_mark) - 1
    contents = np.bincount(nth[head])
    crowd = np.zeros(len(contents), bool) if most is None else (contents > most) | (np.bincount(nth, heavy[order]) > 0)
    head = np.where(crowd[nth], new_mark, head)
    group = np.empty(len(mark), np.int64)
    group[order] = np.cumsum(head) - 1
    times, twice = np.bincount(group, 1 + (many & SEVERAL)) > 1, np.bincount(group, many & TWICE) > 0
    return Met(group, order[head], times, twice, contents[nth[head]] > 1, crowd[nth[head]])


def crowded(sizes: DataFrame, kind: Kind) -> DataFrame | None:
    """sizes: (bucket, n) of what is sent -> (bucket, all) of buckets of more than `crowd` items; None if there are none."""
    crowds = materialise(sizes.groupBy("bucket").agg(F.sum("n").alias("all")).where(F.col("all") > kind.crowd), "crowds")
    return None if crowds.isEmpty() else crowds


def salt_of(kind: Kind) -> Column:
    """Which of a bucket's salts a chunk is in; buckets without a row in the crowds have one."""
    return F.coalesce(F.pmod(F.xxhash64("chunk"), F.ceil(F.col("all") / kind.crowd)), F.lit(0)).cast("long")


def survey(sent: DataFrame, crowds: DataFrame | None, kind: Kind, level: int = 0) -> DataFrame:
    """Of every entry sent its state: of each class with several members, or whose mark has other classes, one entry is
    asked and the others are members; HEAVY alone if the mark has too many."""
    types, most = [np.uint64, np.uint64, np.uint32, np.uint8] + [np.int64] * kind.ordered, kind.most(level)

    def entries(table: pa.Table) -> tuple:
        mark, one, two, many, *lead = columns(table, types)
        return mark, one, two, many, lead, np.zeros(len(mark), bool), np.repeat(table.column("chunk").to_numpy(), table.column("n").to_numpy())

    def answers(table: pa.Table, state: np.ndarray, key: str) -> pa.Table:
        to, bucket, cut, rows = table.column(key).to_pylist(), table.column("bucket")[0].as_py(), np.r_[0, np.cumsum(table.column("n").to_numpy())].tolist(), []
        for i in range(len(to)):
            if (own := state[cut[i] : cut[i + 1]]).any():
                rows.append((to[i], bucket, STATES, bool((own & HEAVY).any()), len(own), squeezed(own.tobytes())))
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    def decide(table: pa.Table) -> pa.Table:
        return answers(table, meet(*entries(table), most).verdict(), "chunk")

    def fold(table: pa.Table) -> pa.Table:  # of one salt, which stands in the place of the chunk
        got = entries(table)
        met, (mark, one, two, _, lead, _, chunk) = meet(*got, most), got
        f = met.first
        blob = packed(mark[f], one[f], two[f], met.many, *(x[f] for x in lead), met.heavy, chunk[f])
        return pa.Table.from_batches([_rows([(table.column("bucket")[0].as_py(), table.column("salt")[0].as_py(), ITEMS, len(f), blob)], SENT)])

    def settle(table: pa.Table) -> pa.Table:
        mark, one, two, many, *lead, heavy, chunk = columns(table, [*types, np.bool_, np.int64])
        return answers(table, meet(mark, one, two, many, lead, heavy, chunk, most).verdict(), "chunk")

    def pass_on(table: pa.Table, told: pa.Table) -> pa.Table:
        if not (table.num_rows and told.num_rows):
            return pa.Table.from_batches([_rows([], ANSWER)])
        state = np.frombuffer(spread(told.column("blob")[0].as_py()), np.uint8)
        return answers(table, meet(*entries(table), most).dealt(state), "chunk")

    if crowds is None:
        return sent.groupBy("bucket").applyInArrow(decide, ANSWER)
    sent = sent if level else materialise(sent, "items", "none")  # read three times
    salted = sent.join(crowds, "bucket").select("bucket", salt_of(kind).alias("salt"), "chunk", "n", "blob")
    told = materialise(salted.groupBy("bucket", "salt").applyInArrow(fold, SENT), "folded").groupBy("bucket").applyInArrow(settle, ANSWER)
    told = told.withColumnRenamed("chunk", "salt")
    split = salted.groupBy("bucket", "salt").cogroup(told.groupBy("bucket", "salt")).applyInArrow(pass_on, ANSWER)
    return sent.join(crowds, "bucket", "left_anti").groupBy("bucket").applyInArrow(decide, ANSWER).union(split)


def states_of(answers: list[dict], items: Items) -> np.ndarray:
    state, found = np.zeros(len(items.lead), np.uint8), {a["bucket"]: a["blob"] for a in answers if a["step"] == STATES}
    for bucket, s in by_bucket(items):
        if bucket in found:
            state[s] = np.frombuffer(spread(found[bucket]), np.uint8)
    return state


def stretches(values: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[lo : lo + size] of each, end to end."""
    return values[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def send_contents(chunks: DataFrame, answers: DataFrame, kind: Kind, buckets: int, level: int) -> DataFrame:
    """Of the level's entries the contents asked for and the members' digests; and the next level's items."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        out, answers = [], told.to_pylist()
        for row in own.to_pylist() if answers else []:  # one
            chunk = opened(row, kind)
            for at, (items, state) in enumerate(chunk.levels(answers, kind, buckets)):
                if at > level:
                    out += told_of(row["chunk"], items, chunk.ids, kind)
                    break
                if at < level:
                    continue
                for bucket, s in by_bucket(items):
                    known = np.flatnonzero(state[s] & (ASK | MEMBER)) + s.start
                    if len(known):
                        out.append((bucket, row["chunk"], MEMBERS, len(known), packed(items.one[known], items.two[known], (state[known] & ASK) > 0)))
                    e = known[(state[known] & ASK) > 0]
                    if not len(e):
                        continue
                    lead = items.lead[e]
                    lo, windows, doc = items.lo[lead], (items.hi - items.lo)[lead] + 1, items.doc[lead]
                    head = packed(items.mark[e], items.one[e], items.two[e], (state[e] & TIMES) > 0, windows.astype(np.int32), chunk.ids[doc], doc.astype(np.int32), lo - chunk.cuts[doc])
                    body = squeezed(stretches(chunk.units, lo, windows + kind.w - 1).tobytes())
                    out.append((bucket, row["chunk"], CONTENT, len(e), len(head).to_bytes(8, "little") + head + body))
        return pa.Table.from_batches([_rows(out, SENT)])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SENT)


def judge(kind: Kind) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's classes: digest, windows, and of each window if it stands more than once, and if it stands earlier."""
    head_types = (np.uint64, np.uint64, np.uint32, np.bool_, np.int32, np.int64, np.int32, np.int64)

    def run(table: pa.Table) -> pa.Table:
        chunk, n = table.column("chunk").to_numpy(), table.column("n").to_numpy()
        heads, bodies = [], []
        for blob, k in zip(table.column("blob").to_pylist(), n.tolist(), strict=True):
            size = int.from_bytes(blob[:8], "little")
            heads.append(unpacked(blob[8 : 8 + size], k, *head_types))
            bodies.append(np.frombuffer(spread(blob[8 + size :]), kind.unit_type))
        mark, one, two, times, windows, ids, doc, lo = (np.concatenate(c) for c in zip(*heads, strict=True))
        units, windows = np.concatenate(bodies), windows.astype(np.int64)
        size = windows + kind.w - 1
        begin = np.cumsum(size) - size
        turn = np.empty(len(size), np.int64)
        turn[np.lexsort((lo, doc, np.repeat(chunk, n), ids))] = np.arange(len(turn))
        order = np.argsort(mark, kind="stable")
        total, cut, nth = np.cumsum(size[order]), [0], np.flatnonzero(np.r_[changes(mark[order]), True])
        for a, b in zip(nth[:-1].tolist(), nth[1:].tolist(), strict=True):  # batches of whole marks
            if a > cut[-1] and total[b - 1] - (total[cut[-1] - 1] if cut[-1] else 0) > kind.batch:
                cut.append(a)
        again, later = [], []
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            own = order[a:b]
            got = kind.resolve(stretches(units, begin[own], size[own]), np.cumsum(size[own]) - size[own], size[own], windows[own], turn[own], times[own])
            again.append(got[0])
            later.append(got[1])
        head = packed(one[order], two[order], windows[order].astype(np.int32))
        bits = b"".join(np.packbits(np.concatenate(x)).tobytes() for x in ([again, later] if kind.ordered else [again]))
        return pa.Table.from_batches([_rows([(table.column("bucket")[0].as_py(), len(order), len(head).to_bytes(8, "little") + head + squeezed(bits))], VERDICT)])

    return run


def deliver(kind: Kind) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a bucket's members and verdicts: to each chunk the verdicts on its entries asked for or members, in their order."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if own.num_rows and told.num_rows:
            blob, n = told.column("blob")[0].as_py(), told.column("n")[0].as_py()
            size = int.from_bytes(blob[:8], "little")
            one, two, windows = unpacked(blob[8 : 8 + size], n, np.uint64, np.uint32, np.int32)
            windows, bits = windows.astype(np.int64), np.frombuffer(spread(blob[8 + size :]), np.uint8)
            first, total = np.cumsum(windows) - windows, int(windows.sum())
            again, later = (np.unpackbits(x, count=total).astype(bool) for x in np.split(bits, 2)) if kind.ordered else (np.unpackbits(bits, count=total).astype(bool), None)
            mine, yours, asked = columns(own, [np.uint64, np.uint32, np.bool_])
            one, two = np.concatenate([one, mine]), np.concatenate([two, yours])
            order = np.lexsort((np.arange(len(one)), two, one))  # of equal digests the verdict comes first
            at = np.empty(len(one), np.int64)
            at[order] = order[np.maximum.accumulate(np.where(changes(one[order], two[order]), np.arange(len(one)), 0))]
            at, ends = at[n:], np.cumsum(own.column("n").to_numpy()).tolist()
            for i, chunk in enumerate(own.column("chunk").to_pylist()):
                s = slice(ends[i - 1] if i else 0, ends[i])
                own_at, out = at[s], stretches(again, first[at[s]], windows[at[s]])
                if kind.ordered:
                    own_at = own_at[asked[s]]
                    out = np.concatenate([out, stretches(later, first[own_at], windows[own_at])])
                if out.any():
                    rows.append((chunk, own.column("bucket")[0].as_py(), BITS, False, len(out), squeezed(np.packbits(out).tobytes())))
        return pa.Table.from_batches([_rows(rows, ANSWER)])

    return run


def settled(sent: DataFrame, kind: Kind) -> DataFrame:
    """Judged and delivered in one task a bucket; of contents and members of buckets without salts."""
    judged, delivered = judge(kind), deliver(kind)

    def run(table: pa.Table) -> pa.Table:
        contents, members = (table.filter(pc.equal(table.column("kind"), x)) for x in (CONTENT, MEMBERS))
        return delivered(members, judged(contents)) if contents.num_rows else pa.Table.from_batches([_rows([], ANSWER)])

    return sent.groupBy("bucket").applyInArrow(run, ANSWER)


def dispatch(members: DataFrame, judged: DataFrame, crowds: DataFrame | None, kind: Kind) -> DataFrame:
    """deliver(), with the verdicts on crowded buckets to each of their salts."""
    judged = judged.withColumn("salt", F.lit(0).cast("long"))
    if crowds is None:
        members = members.withColumn("salt", F.lit(0).cast("long"))
    else:
        members = members.join(crowds, "bucket", "left").withColumn("salt", salt_of(kind))
        salts = F.coalesce(F.ceil(F.col("all") / kind.crowd), F.lit(1)).cast("long")
        judged = judged.drop("salt").join(crowds, "bucket", "left").select("bucket", "n", "blob", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    return members.select("bucket", "salt", "chunk", "n", "blob").groupBy("bucket", "salt").cogroup(judged.groupBy("bucket", "salt")).applyInArrow(deliver(kind), ANSWER)


def runs_of(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of several owners, `size` each, end to end -> of each run of ones its owner, and first and last place in it."""
    begin = np.cumsum(size) - size
    edge = np.zeros(len(bits) + 1, bool)
    edge[begin] = edge[-1] = True
    lo = np.flatnonzero(bits & (edge[:-1] | ~np.r_[False, bits[:-1]]))
    hi = np.flatnonzero(bits & (edge[1:] | ~np.r_[bits[1:], False]))
    owner = np.searchsorted(begin, lo, "right") - 1
    return owner, lo - begin[owner], hi - begin[owner]


def found_spans(items: Items, state: np.ndarray, found: dict[int, bytes], kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of units of the windows to go: in the leads of entries asked for by `later` if ordered, in all other items by `again`."""
    by_entry = np.argsort(items.entry, kind="stable")
    held = np.bincount(items.entry, minlength=len(items.lead))
    first = np.cumsum(held) - held
    for bucket, s in by_bucket(items):
        if bucket not in found:
            continue
        known = np.flatnonzero(state[s] & (ASK | MEMBER)) + s.start
        asked = (state[known] & ASK) > 0
        lead = items.lead[known]
        windows = (items.hi - items.lo)[lead] + 1
        total, extra = int(windows.sum()), int(windows[asked].sum()) if kind.ordered else 0
        bits = np.unpackbits(np.frombuffer(spread(found[bucket]), np.uint8), count=total + extra).astype(bool)
        mine = stretches(by_entry, first[known], held[known])
        owner = np.repeat(np.arange(len(known)), held[known])
        parts = [(bits[:total], windows, mine, owner)]
        if kind.ordered:
            rest = ~(asked[owner] & (mine == lead[owner]))
            parts = [(bits[:total], windows, mine[rest], owner[rest]), (bits[total:], windows[asked], lead[asked], np.arange(int(asked.sum())))]
        for own_bits, size, item, of in parts:
            run, lo, hi = runs_of(own_bits, size)
            count = np.bincount(run, minlength=len(size))
            each = stretches(np.arange(len(run)), (np.cumsum(count) - count)[of], count[of])
            base = np.repeat(items.lo[item], count[of])
            yield base + lo[each], base + hi[each] + kind.w


def united(spans: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches' union as sorted, disjoint ones that don't touch but at a document's end."""
    lo, hi = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*spans, strict=True) if spans else ([], [])))
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order]) if len(lo) else hi
    new = np.r_[True, (lo[1:] > hi[:-1]) | ((lo[1:] == hi[:-1]) & np.isin(lo[1:], ends))][: len(lo)]
    return lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(lo) - 1]] if len(lo) else hi


def finish(chunks: DataFrame, answers: DataFrame, kind: Kind, buckets: int) -> DataFrame:
    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        tables = [kind.write(None, None)]
        for row in own.to_pylist():  # one
            chunk, answers = opened(row, kind), told.to_pylist()
            found, spans = {a["bucket"]: a["blob"] for a in answers if a["step"] == BITS}, []
            if found:
                for items, state in chunk.levels(answers, kind, buckets):
                    spans += found_spans(items, state, found, kind)
            tables.append(kind.write(chunk, united(spans, chunk.cuts)))
        return pa.concat_tables(tables)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, kind.schema)


def repeated_windows(docs: DataFrame, kind: Kind, id_col: str, text_col: str) -> DataFrame:
    chunks = materialise(chunked(docs, id_col, text_col), "chunks", "none", TEXTS)
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets = max(12, -(-total // BUCKET_BYTES))
    sent, sizes, known, found = send_items(chunks, kind, buckets), count_items(chunks, kind, buckets), None, []
    for level in range(len(kind.grams)):
        crowds = crowded(sizes, kind)
        told = materialise(survey(sent, crowds, kind, level), "survey")
        known = told if known is None else known.union(told)
        heavy = not told.where("heavy").isEmpty()
        more = send_contents(chunks, known, kind, buckets, level)
        if crowds is None and not heavy:  # read once, so it needs no table, and finish() meets the chunks of the same exchange
            found.append(settled(more, kind))
            break
        more = materialise(more, "contents", "none")
        judged = more.where(F.col("kind") == CONTENT).groupBy("bucket").applyInArrow(judge(kind), VERDICT)
        found.append(dispatch(more.where(F.col("kind") == MEMBERS), judged, crowds, kind))
        if not heavy:
            break
        sent = sizes = more.where(F.col("kind") == ITEMS)
    return finish(chunks, reduce(DataFrame.union, found, known), kind, buckets)
