"""Substring dedup of word passages by prefix-partitioned suffix trees.

windows.py deals windows by prefix: by a gram of `gram` words in them, and where the corpus holds more contents of a gram
than fit in memory, by a longer one, up to a whole window. It brings one content of each class of equal ones, with a
note if the class has several members. Here each window of a batch is a suffix, read to the window's depth. Suffixes are
split by their first word; where a prefix holds more than `group` suffixes, by one word more, and so on: variable-length
prefixes, each with a group of suffixes that fits in memory, or as deep as a window.
Each group's subtree is grown breadth first: a node is the suffixes that share a path, its children differ in the next
word; nodes of one suffix that stands for itself alone are leaves and end there. The internal nodes as deep as a window
are the repeats: all but their earliest suffix go, and nothing else removes a word.

Earliest is by id, null ids last; repeated rows are in the order of chunk and row. Null texts have no words. Texts of
fewer words than a window stay whole. Words are compared by 64-bit digests. A very long text is a chunk of its own; its
words are cut, hashed and written by slices. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut_words
from .windows import BYTES, Chunk, Kind, mixed, powers, repeated_windows

ROW = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: Suffixes of a group, and contents of a prefix that meet in one batch: of 25 words or so, 7 MB.
GROUP, ROOM = 1 << 12, 1 << 15
#: Bytes of a text that are cut into words at a time; longer words are hashed whole.
CUT = 1 << 16
IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def children(words: np.ndarray, twice: np.ndarray, rows: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split nodes by the word at `depth`; leaves, nodes of one suffix that is not `twice`, are dropped. node: ascending numbers."""
    nxt = words[rows + depth]
    order = np.lexsort((nxt, node))
    rows, node, nxt = rows[order], node[order], nxt[order]
    new = np.r_[True, (node[1:] != node[:-1]) | (nxt[1:] != nxt[:-1])]
    child = np.cumsum(new) - 1
    inner = np.bincount(child, 1 + twice[rows])[child] > 1
    return rows[inner], child[inner]


def prefix_groups(words: np.ndarray, twice: np.ndarray, rows: np.ndarray, depth: int, group: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(suffixes, node, prefix length): prefixes of at most `group` suffixes, several to a batch of that size; a prefix of more is split on."""
    todo = [(rows, np.zeros(len(rows), np.int64), 0)]
    while todo:
        rows, node, at = todo.pop()
        if not len(rows):
            continue
        if len(rows) <= group or at == depth:
            yield rows, node, at
            continue
        rows, node = children(words, twice, rows, node, at)
        if not len(rows):
            continue
        size = np.bincount(node)
        share = np.cumsum(size) // group
        cut = np.r_[0, np.flatnonzero(np.diff(share[node])) + 1, len(rows)]
        todo += [(rows[a:b], node[a:b], at + 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def deep_nodes(words: np.ndarray, twice: np.ndarray, rows: np.ndarray, depth: int, group: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes, node) of the internal nodes at `depth`, a batch of subtrees at a time. twice: of each place, if its suffix stands for several."""
    for own, node, at in prefix_groups(words, twice, rows, depth, group):
        while at < depth and len(own):
            own, node = children(words, twice, own, node, at)
            at += 1
        if len(own):
            yield own, node


def resolve(window: int, group: int = GROUP):
    def run(units: np.ndarray, start: np.ndarray, size: np.ndarray, windows: np.ndarray, turn: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, if its node holds another suffix (or several members), and if it holds an earlier one."""
        first = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(len(owner)) - first[owner]
        again, later = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
        rows = start[owner] + offset
        back = np.full(len(units), -1, np.int64)
        back[rows] = np.arange(len(rows))
        twice = np.zeros(len(units), bool)
        twice[rows] = times[owner]
        for own, node in deep_nodes(units, twice, rows, window, group):
            at = back[own]
            again[at] = True
            # the order of the items' firsts is that of all their windows: another document, or further on in one
            order = np.lexsort((offset[at], turn[owner[at]], node))
            later[at[order[1:][node[order][1:] == node[order][:-1]]]] = True
        return again, later

    return run


def word_units(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests, texts' ends in words). A word's digest is its bytes' numbers by powers and its length, mixed; that of a
    word of more than `CUT` bytes is BLAKE2b. Bytes are taken by slices."""
    words, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    up, down = powers()
    for a, b in text_cuts(data, ends):
        inside, edge = np.zeros(b - a + 2, bool), np.zeros(b - a + 1, bool)  # edge: a text begins
        inside[1:-1] = ~IS_WHITE[data[a:b]]
        edge[ends[slice(*np.searchsorted(ends, [a, b + 1]))] - a] = True
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        size = end - begin
        if b - a <= 2 * CUT:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(BYTES[data[a:b]] * up[: b - a], out=sums[1:])
            digest = mixed((sums[end] - sums[begin]) * down[begin] + size.astype(np.uint64))
        else:  # ends in a word of more than CUT bytes, and begins with at most CUT bytes of others
            digest = np.r_[word_units(data[a : a + begin[-1]], np.array([0, begin[-1]]))[0], np.uint64(0)]
        for i in np.flatnonzero(size > CUT).tolist():
            digest[i] = int.from_bytes(blake2b(data[a + begin[i] : a + end[i]], digest_size=8).digest(), "little")
        words.append(digest)
        starts.append(begin + a)
    return np.concatenate(words), np.searchsorted(np.concatenate(starts), ends)


def text_cuts(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about `CUT` bytes that end at a text's end or before white space."""
    at, last = 0, int(ends[-1])
    while at < last:
        end = min(at + CUT, last)
        near = int(ends[np.searchsorted(ends, end)])
        while end < near and not len(white := np.flatnonzero(IS_WHITE[data[end : min(end + CUT, near)]])):
            end = min(end + CUT, near)
        end += int(white[0]) if end < near else 0
        yield at, end
        at = end


def _write(chunk: Chunk | None, gone: tuple[np.ndarray, np.ndarray] | None, texts: bool = False) -> pa.Table:
    rows = []
    if chunk:
        lo, hi = gone
        first, data = np.searchsorted(lo, chunk.cuts), memoryview(chunk.data)
        for i, (a, b) in enumerate(zip(chunk.ends[:-1].tolist(), chunk.ends[1:].tolist(), strict=True)):
            begin, n = int(chunk.cuts[i]), int(chunk.cuts[i + 1] - chunk.cuts[i])
            edges = [0, *(int(x) - begin for j in range(first[i], first[i + 1]) for x in (lo[j], hi[j])), n]
            stays = list(zip(edges[::2], edges[1::2], strict=True))
            digest, kept, seen, left = hashlib.sha256(), [], 0, 0
            for words in cut_words(bytes(data[a:b])):
                here = [w for x, y in stays if x < seen + len(words) and y > seen for w in words[max(0, x - seen) : y - seen]] if len(stays) > 1 else words
                seen += len(words)
                if here:
                    piece = (b" " if left else b"") + b" ".join(here)
                    digest.update(piece)
                    kept += [piece] * texts
                    left += len(here)
            rows.append((int(chunk.ids[i]) if chunk.known[i] else None, n, n - left, digest.hexdigest(), b"".join(kept).decode()))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def kind_of(window: int = 20, gram: int = 6, texts: bool = False, group: int = GROUP) -> Kind:
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    write = lambda chunk, gone: _write(chunk, gone, texts).select(cols)
    return Kind(window, min(gram, window), word_units, write, ROW + ", kept string" * texts, resolve(window, group), np.uint64, True, ROOM)


def substring_dedup(docs: DataFrame, window: int = 20, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256; with texts, the kept words too."""
    return repeated_windows(docs, kind_of(window, min(6, window), texts), id_col, text_col).withColumnRenamed("doc_id", id_col)
