"""SimHash near-dedup: pigeonhole block joins, Hamming verification, connected components.

Fingerprints are cut into blocks so that two that differ in few bits agree on some `clean` blocks whichever bits these
are (n blocks, b bits: n - b of them). Each choice of `clean` blocks is a table; fingerprints meet where all chosen
blocks agree. Documents with one fingerprint are one node from the start. In a meeting the links are found by a search
that drops each reached fingerprint, and only a star of each part found is given out, so a group of thousands of near
copies costs and yields about its size, not its pairs. Meetings above `hot` fingerprints are dealt to tiles: the
fingerprints are cut into chunks, and every two chunks meet in a tile of their own.

Null and empty texts have no words: fingerprint zero, linked like any other. Null ids are linked but name no
component. Repeated rows share one. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, connected_components, cut_words, materialise


def fingerprint(text: str | bytes | None, width: int = 4) -> bytes:
    """8 bytes, most significant first: a bit is 1 if set in over half the hashes of the shingles (XXH64, seed 42). The
    words are taken some at a time, with the last of those before."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode() if isinstance(text, str) or text is None else text
    ones, total, kept = np.zeros(64, np.int64), 0, []

    def add(words: list[bytes], k: int) -> int:
        norm, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts, ends = (ends - size).tolist(), ends.tolist()
        hashes = np.array([xxh64_intdigest(norm[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], np.uint64)
        ones[:] += np.unpackbits(hashes.byteswap().view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        return len(hashes)

    for words in cut_words(raw.lower()):  # of bytes: A-Z only, and the six ASCII white-space characters
        kept += words
        if len(kept) >= width:
            total += add(kept, width)
            kept = kept[len(kept) - width + 1 :]
    if kept and not total:
        total = add(kept, len(kept))
    return np.packbits(ones * 2 > total).tobytes() if total else bytes(8)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): key a hash of the text, to tell rows without an id apart; fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            marks = [int.from_bytes(fingerprint(x.as_py(), width), "big", signed=True) for x in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(marks, pa.int64())], names=["id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key")).mapInArrow(run, "id long, key long, fp long")


def plan_blocks(n: int, bits: int = 4) -> tuple[int, int]:
    """Blocks and how many of them must agree, so that a table's keys outnumber about an eighth of the fingerprints."""
    for blocks in range(bits + 1, bits + 6):
        clean = blocks - bits
        if 1 << (64 * clean // blocks) >= n / 8:
            break
    return blocks, clean


def block_keys(blocks: int, clean: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each table its number and the (shift, width) of its chosen blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(t, [(cuts[i], cuts[i + 1] - cuts[i]) for i in chosen]) for t, chosen in enumerate(combinations(range(blocks), clean))]


def meetings(marks: DataFrame, blocks: int, clean: int) -> DataFrame:
    """(fp) -> (key, fp), a row a table."""
    keys = []
    for t, parts in block_keys(blocks, clean):
        key = F.lit(t).cast("long")
        for shift, width in parts:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    return marks.select(F.explode(F.array(*keys)).alias("key"), "fp")


def stars(marks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints as a star for each connected part: (centre, member) of parts of two or more."""
    left, a, b = np.arange(len(marks)), [], []
    while len(left):
        front, left, centre = [left[0]], left[1:], left[0]
        while front and len(left):
            near = np.bitwise_count(marks[left] ^ marks[front.pop()]) <= bits
            if near.any():
                got = left[near]
                left = left[~near]
                front += got.tolist()
                a.append(np.full(len(got), marks[centre]))
                b.append(marks[got])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(met: DataFrame, bits: int) -> DataFrame:
    """(key, tile, fp), dealt and sorted by key and tile -> (a, b)."""

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, np.any(key[1:] != key[:-1], axis=1), True]) if len(key) else np.zeros(1, np.int64)
        size = np.diff(cut)
        run = np.repeat(np.arange(len(size)), size)
        small = np.repeat(size <= 8, size)
        a, b = [], []
        for gap in range(1, 8):
            if not (pair := (run[gap:] == run[:-gap]) & small[gap:]).any():
                break
            at = np.flatnonzero(pair)
            at = at[np.bitwise_count(fp[at] ^ fp[at + gap]) <= bits]
            a.append(fp[at])
            b.append(fp[at + gap])
        for i in np.flatnonzero(size > 8):
            x, y = stars(np.unique(fp[cut[i] : cut[i + 1]]), bits)
            a.append(x)
            b.append(y)
        none = np.zeros(0, np.uint64)
        return pa.record_batch([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.concatenate([key, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            last = np.flatnonzero(np.any(key != key[-1], axis=1)) if len(key) else []
            if len(last):  # all but the meeting that may go on
                cut = last[-1] + 1
                yield found(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        yield found(key, fp)

    return met.select("key", "tile", "fp").mapInArrow(run, "a long, b long")


def near_components(marked: DataFrame, bits: int = 4, hot: int = 100_000) -> DataFrame:
    """(id, key, fp), materialised -> the same, root, component_id: the least id reachable over links of at most `bits` bits."""
    marks = marked.select("fp").distinct()
    met = meetings(marks, *plan_blocks(marks.count(), bits))
    crowds = materialise(met.groupBy("key").count().where(F.col("count") > hot), "crowds")
    if crowds.isEmpty():
        met = met.select("key", F.lit(0).cast("long").alias("tile"), "fp")
    else:
        met = met.join(crowds.withColumnRenamed("count", "n"), "key", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") * 2 / hot), F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least(j, own) * F.col("k") + F.greatest(j, own))
        met = met.select("key", F.explode(every).alias("tile"), "fp")
    pairs = links(met.repartition("key", "tile").sortWithinPartitions("key", "tile"), bits)
    roots = connected_components(pairs)
    out = marked.join(roots, marked["fp"] == roots["node"], "left").select("id", "key", "fp", F.coalesce("root", "fp").alias("root"))
    # written, so that the join below has an exchange on either side and a large component can be split
    least = materialise(out.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return out.join(least, "root")


def simhash_dedup(docs: DataFrame, bits: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id."""
    found = near_components(materialise(fingerprints(docs, width, id_col, text_col), "fingerprints", arrow_rows=TEXTS), bits)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: the least id, nulls last."""
    found = near_components(materialise(fingerprints(docs, width, id_col, text_col), "fingerprints", arrow_rows=TEXTS), bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x"))
    first = materialise(first.select(F.col("x.id").alias("own"), F.col("x.key").alias("hash")), "kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("k"))
    out = whole.join(first, F.col("i").eqNullSafe(F.col("own")) & (F.col("k") == F.col("hash")), "left_semi")
    rows = found.join(first, found["id"].eqNullSafe(first["own"]) & (found["key"] == first["hash"]), "left_semi")
    if rows.count() > first.count():  # rows that repeat id and text: one stays
        out = out.dropDuplicates(["i", "k"])
    return out.select("doc.*")
