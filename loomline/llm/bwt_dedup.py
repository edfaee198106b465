"""Suffix-array dedup of long byte passages by merging Burrows-Wheeler transforms.

windows.py brings the contents that have to be compared to buckets, one of each class of equal ones with a note if the
class has several members. Here a batch is cut into shards of about `SHARD_BYTES` symbols. A content is
read as strings of symbols: a symbol is the 64-bit digest of a block of `step` bytes (a divisor of the window), and the
positions p, p + step, p + 2 step ... are one string, so a window is window / step symbols and every byte position is a
suffix. Each shard sorts its own suffixes and keeps its transform, the symbol before each suffix. The shards are then
merged by interleave refinement: an array says which shard the next suffix comes from; a pass reads the transforms
in that order and deals the entries stably by symbol, after which the interleave is right for one symbol more. With it
goes a group number: two neighbours share a prefix after the pass if they have the same symbol and shared one before.
After window / step passes the groups are the intervals of suffixes with a common prefix of a window; no suffix of two
shards was compared. Intervals of two suffixes or more, or of one that stands for several members, are repeats; nothing
else removes a byte.

Null texts are empty: no bytes, no spans, the digest of nothing. Null ids and repeated rows stay, and a row repeated
is a repeat. Texts shorter than the window stay whole. A very long text is a chunk of its own; its bytes are held
whole by the tasks that read it, all that is computed on them is held by slices. An empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import Chunk, Kind, changes, gram_hashes, repeated_windows

#: Symbols of a shard; bytes merged at a time, in whole marks; contents of a mark that meet in one merge, of 540 bytes or so.
SHARD_BYTES, BATCH, ROOM = 1 << 14, 1 << 17, 1 << 12
ROW = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class ShardBWT:
    """Suffixes of the shard's strings, sorted to their ends: place[i] is a row of the i-th, before[i] the symbol before it.

    symbols: of each row its symbol, 0 at the end of a string; rows step apart follow each other; begin: first rows."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray, step: int, longest: int):
        rank, reach = named(symbols.astype(np.uint64)), 1  # every string has an end, so 0 stays 0
        while reach < longest:
            key = rank.astype(np.uint64) << np.uint64(21)
            for hop in (reach * step, 2 * reach * step):
                if hop < len(rank):
                    key[:-hop] |= np.where((begin[hop:] == begin[:-hop]) & (rank[:-hop] > 0), rank[hop:], 0).astype(np.uint64)
                key = key << np.uint64(21) if hop == reach * step else key
            rank = np.where(symbols > 0, named(key) + 1, 0)
            reach *= 3
        self.place = by_symbol(rank).astype(np.int32)
        before = np.zeros(len(rank), symbols.dtype)
        before[step:] = symbols[:-step]
        before[step:][begin[step:] != begin[:-step]] = 0
        self.before = before[self.place]
        self.ends = int((symbols == 0).sum())


def named(values: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits by their ranks among the distinct ones, from 0."""
    order = np.argsort(values)
    sorted_ = values[order]
    new = np.zeros(len(values), np.int32)
    new[1:] = sorted_[1:] != sorted_[:-1]
    out = np.empty(len(values), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Stable order of numbers under 2^32: two counting passes of 16 bits."""
    low = np.argsort(symbols.astype(np.uint16), kind="stable")
    return low[np.argsort((symbols[low] >> 16).astype(np.uint16), kind="stable")] if len(symbols) and symbols.max() > 0xFFFF else low


def merge(shards: list[ShardBWT], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, group) in merged order; entries count through the shards. Neighbours of a group share `passes` symbols."""
    before = np.concatenate([s.before for s in shards])
    origin = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.before) for s in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.ends for s in shards])
    group, entry = np.zeros(len(origin), np.int32), np.arange(len(origin), dtype=np.int32)
    for _ in range(passes):
        symbol = before[entry]
        live = np.flatnonzero(symbol)
        turn = live[by_symbol(symbol[live])]
        s, g = symbol[turn], group[turn]
        new = changes(s, g)
        origin = np.concatenate([ends, origin[turn]])
        group = np.concatenate([np.zeros(len(ends), np.int32), np.cumsum(new, dtype=np.int32)])
        entry[np.argsort(origin, kind="stable")] = np.arange(len(origin), dtype=np.int32)
    return entry, group


def resolve(window: int, step: int, shard_bytes: int = SHARD_BYTES):
    def run(units: np.ndarray, start: np.ndarray, size: np.ndarray, windows: np.ndarray, turn: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window if it stands again: its interval holds two suffixes, or one that stands for several members (times)."""
        first = np.cumsum(windows) - windows
        hit = np.zeros(int(windows.sum()), bool)
        digest = gram_hashes(units, step)
        # rows of a content: its positions and one more; the last `step` are the ends of its strings
        rows = size + 1
        begin = np.repeat(np.arange(len(size), dtype=np.int32), rows)
        offset = (np.arange(int(rows.sum())) - np.repeat(np.cumsum(rows) - rows, rows)).astype(np.int32)
        whole = offset + step <= np.repeat(size, rows)
        symbols = np.zeros(len(offset), np.uint32)
        symbols[whole] = named(digest[(np.repeat(start.astype(np.int32), rows) + offset)[whole]]) + 1
        longest = int(size.max()) // step + 1
        share = (np.cumsum(rows) - 1) // shard_bytes
        cuts = np.r_[0, np.flatnonzero(np.diff(share)) + 1, len(rows)]
        at = np.r_[0, np.cumsum(rows)][cuts]
        shards = [ShardBWT(symbols[a:b], begin[a:b], step, longest) for a, b in zip(at[:-1], at[1:], strict=True)]
        entry, group = merge(shards, window // step)
        row = np.concatenate([s.place + np.int32(a) for s, a in zip(shards, at, strict=False)])[entry]
        live = offset[row] < windows[begin[row]]
        row, group = row[live], group[live]
        again = np.bincount(group, 1 + times[begin[row]])[group] > 1
        hit[(first[begin[row]] + offset[row])[again]] = True
        return hit, hit

    return run


def _write(chunk: Chunk | None, gone: tuple[np.ndarray, np.ndarray] | None) -> pa.Table:
    rows = []
    if chunk:
        lo, hi = gone
        first = np.searchsorted(lo, chunk.ends)
        for i, (a, b) in enumerate(zip(chunk.ends[:-1].tolist(), chunk.ends[1:].tolist(), strict=True)):
            spans = range(first[i], first[i + 1])
            edges = [a, *(int(x) for j in spans for x in (lo[j], hi[j])), b]
            kept = b"".join([chunk.data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)])
            rows.append((int(chunk.ids[i]) if chunk.known[i] else None, b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def byte_units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, ends


def block_of(window: int, most: int = 100) -> int:
    return max(d for d in range(1, min(window, most) + 1) if window % d == 0)


def kind_of(window: int = 400, gram: int = 128, texts: bool = False) -> Kind:
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts
    write = lambda chunk, gone: _write(chunk, gone).select(cols)
    return Kind(window, min(gram, window), byte_units, write, ROW + ", kept binary" * texts, resolve(window, block_of(window)), np.uint8, False, ROOM, BATCH)


def bwt_dedup(docs: DataFrame, window: int = 400, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256; with texts, the kept bytes too."""
    return repeated_windows(docs, kind_of(window, min(128, window), texts), id_col, text_col).withColumnRenamed("doc_id", id_col)


