"""Spelling variants: words one edit apart, by a self-join of the vocabulary's trie with active-node sets.

The trie is cut into parts by prefixes of variable length: three letters, one more where a part has over `most` words, so
no part is unbounded. Two words one edit apart part ways at one node, the end of their longest common prefix. Above the
cuts that node's active set holds what one edit reaches, and only equal remainders can follow: a join by node and
remainder, whose groups have at most a word for each letter and one more. Inside a part the sets are propagated down,
level by level for all nodes at once: to a child go the children with the same letter of its parent's active nodes, its
parent (a letter less), its siblings (another letter) and its own children (a letter more). Terminal nodes in a terminal
node's set are its near words.

Words are runs of `RUN`, A-Z lower-cased. `garble` takes a letter out of a run where a hash of document and run says so,
a stated source of misspellings. A word's form is its most frequent near word (ties: the smallest by code point), if `ratio`
times as frequent; forms are followed to the root, a chain no longer than the counts' logarithm to base `ratio`.

A null text has no words; a null id hashes as an empty one; repeated rows count again; an empty table gives no rows.
Only id and text are read, so other columns may have any name. Long texts become words in the JVM, a text at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The letters of a word, as in the contract; with the two signs among them.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, near struct<less: bigint, word: string>"


def garble(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run without the letter at h % length, if `every` divides h, the CRC-32 of `<doc_id>:<run>`."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): distinct words of at least `least_chars` letters and `least_n` occurrences. Shorter runs can't become such words."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least_chars},}})"), 1)
    rows = docs.select(F.col(id_col).alias("i"), F.explode(runs).alias("r")).select("i", F.translate("r", UPPER, LOWER).alias("r"))
    words = rows.select(garble(F.col("i"), F.col("r"), every).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def cut(words: DataFrame, first: int = 3, most: int = 1 << 15) -> DataFrame:
    """word, n, part, depth: the word's prefix that is its part, and its length. The parts of over `most` words at a length,
    at most a `most`-th of the words, go one letter on; words are distinct, so that ends."""
    done, rest, depth = None, words, first
    while True:
        part = F.substring("word", 1, depth)
        here = rest.withColumn("part", part).withColumn("depth", F.lit(depth))
        full = materialise(here.groupBy("part").count().where(F.col("count") > most).select("part"), "full-parts")
        if full.isEmpty():
            return here if done is None else done.unionByName(here)
        out = here.join(full, "part", "left_anti").select("word", "n", "part", "depth")
        done = out if done is None else done.unionByName(out)
        rest, depth = materialise(here.join(full, "part", "left_semi").select("word", "n"), "words-below"), depth + 1


def near_above(parts: DataFrame) -> DataFrame:
    """NEAR rows of pairs that part ways above their parts: at node `word[:i]` one loses letter i and has the other's remainder."""
    i = F.col("i")
    rows = parts.select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word")))).alias("i"))
    node = F.concat(F.substring("word", F.lit(1), i), F.lit("|"))
    rest = lambda k: F.substring("word", i + 1 + k, F.length("word"))
    letter = F.substring("word", i + 1, F.lit(1))
    lost = F.struct(F.concat(node, rest(1)).alias("key"), letter.alias("lost"), F.lit("").alias("next"))
    own = F.struct(F.concat(node, rest(0)).alias("key"), F.lit(None).cast("string").alias("lost"), letter.alias("next"))
    keys = rows.select("word", "n", F.explode(F.when(letter == "", F.array(own)).otherwise(F.array(lost, own))).alias("k")).select("word", "n", "k.*")
    met = keys.groupBy("key").agg(F.collect_list(F.struct("word", "n", "lost", "next")).alias("m")).where(F.size("m") > 1)  # at most the letters and one
    a, b = F.col("a"), F.col("b")
    pair = met.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).where(a["word"] != b["word"])
    both = a["lost"].isNotNull() & b["lost"].isNotNull()
    # the node is the end of the longest common prefix only if the letter lost isn't the other's next
    one = (a["lost"].isNotNull() & b["lost"].isNull() & (a["lost"] != b["next"])) | (a["lost"].isNull() & b["lost"].isNotNull() & (a["next"] != b["lost"]))
    near = F.min(F.struct((-b["n"]).alias("less"), b["word"].alias("word")))
    return pair.where(both | one).groupBy(a["word"].alias("word")).agg(F.count(F.lit(1)).alias("n_near"), near.alias("near"))


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, member) for the ranges first .. first + n - 1, end to end."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]


class Trie:
    """A trie a part, side by side, of distinct words. Nodes are numbered by depth, then parent, then letter; the parts' roots come first."""

    def __init__(self, words: list[str], part: np.ndarray, depth: np.ndarray):
        flat = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start, width = np.cumsum(length) - length, int(flat.max(initial=0)) + 1
        self.width, keys, base = width, [], int(part.max()) + 1
        at, alive, self.levels, d = part.astype(np.int64), np.arange(len(words)), [0, base], 0
        ends = [np.full(base, -1, np.int64)]
        while True:
            stop = length[alive] - depth[alive] <= d
            ends[-1][at[stop] - self.levels[-2]] = alive[stop]
            alive, at = alive[~stop], at[~stop]
            if not len(alive):
                break
            own, number = np.unique(at * width + flat[start[alive] + depth[alive] + d], return_inverse=True)
            keys.append(own)
            at, d = self.levels[-1] + number.ravel(), d + 1
            ends.append(np.full(len(own), -1, np.int64))
            self.levels.append(self.levels[-1] + len(own))
        self.end = np.concatenate(ends)
        self.keys = np.concatenate([*keys, np.zeros(0, np.int64)])  # of node base + i: parent and letter, ascending
        self.base, self.parent = base, np.r_[np.full(base, -1), self.keys // width]
        self.first = base + np.searchsorted(self.keys, np.arange(len(self.end)) * width)
        self.kids = np.diff(np.r_[self.first, base + len(self.keys)])

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """-1: there is none."""
        if not len(self.keys):
            return np.full(len(node), -1)
        want = node * self.width + letter
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[i] == want, self.base + i, -1)

    def pairs(self):
        """(a, b) of word numbers one edit apart, both ways, level by level."""
        roots = np.arange(self.base)
        node, active = _spread(self.first[:self.base], self.kids[:self.base])
        node = roots[node]
        for lo, hi in zip(self.levels[1:], [*self.levels[2:], None], strict=True):
            a, b = self.end[node], self.end[active]
            both = (a >= 0) & (b >= 0)
            yield a[both], b[both]
            if hi is None:
                return
            which, kid = _spread(self.first[node], self.kids[node])
            same = self.child(active[which], self.keys[kid - self.base] % self.width)
            found, level = same >= 0, np.arange(lo, hi)
            up = self.parent[level]
            side, sibling = _spread(self.first[up], self.kids[up])
            down, grandchild = _spread(self.first[level], self.kids[level])
            node = np.concatenate([kid[found], level, level[side], level[down]])
            active = np.concatenate([same[found], up, sibling, grandchild])
            pair = np.unique((node * len(self.end) + active)[node != active])
            node, active = pair // len(self.end), pair % len(self.end)


def _near_below(table: pa.Table) -> pa.Table:
    words = table.column("word").to_pylist()
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)  # by code point: numbers order as words do
    words, n = [words[i] for i in order], table.column("n").to_numpy()[order]
    part = table.column("part").combine_chunks().dictionary_encode()
    part = (part.combine_chunks() if isinstance(part, pa.ChunkedArray) else part).indices.to_numpy()[order]
    trie = Trie(words, part, table.column("depth").to_numpy()[order])
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
    for a, b in trie.pairs():
        count += np.bincount(a, minlength=len(words))
        rank = np.lexsort((b, -n[b], a))
        a, b = a[rank], b[rank]
        lead = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
        a, b = a[lead], b[lead]
        old = best[a]
        better = (old < 0) | (n[b] > n[old]) | ((n[b] == n[old]) & (b < old))
        best[a[better]] = b[better]
    own = np.flatnonzero(count)
    near = pa.StructArray.from_arrays([pa.array(-n[best[own]]), pa.array([words[i] for i in best[own]], pa.string())], names=["less", "word"])
    return pa.table([pa.array([words[i] for i in own], pa.string()), pa.array(count[own]), near], names=["word", "n_near", "near"])


def near_words(words: DataFrame, first: int = 3, most: int = 1 << 15) -> DataFrame:
    """word, n, n_near, near (its near word of the largest n, ties to the smallest), near_n; both null without a near word."""
    parts = materialise(cut(words, first, most), "parts")
    groups = max(1, -(-parts.count() // most))
    below = parts.groupBy(F.pmod(F.xxhash64("part"), F.lit(groups))).applyInArrow(_near_below, NEAR)
    found = near_above(parts).unionByName(below).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    out = parts.select("word", "n").join(found, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("near.word").alias("near"), (-F.col("near.less")).alias("near_n"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, form) -> (word, root): each round a word's goal becomes its goal's goal, so chains of 2^rounds end."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        now = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
    return now


def spelling_variants(
    docs: DataFrame, least_chars: int = 6, least_n: int = 5, ratio: int = 5, every: int = 199, first: int = 3, most: int = 1 << 15,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row a word; root is the word itself if it has no form."""
    if ratio < 2 or least_n < 1:
        raise ValueError("forms need a ratio of 2 or more and words an occurrence")
    words = materialise(vocabulary(docs, least_chars, least_n, every, id_col, text_col), "vocabulary")
    known = near_words(words, first, most)
    has = F.col("near_n") >= ratio * F.col("n")
    known = materialise(known.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    top = known.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(max(1, top / least_n)) / math.log(ratio))  # each form is `ratio` times as frequent
    goal = roots(known.where("form is not null"), math.ceil(math.log2(steps + 1)))
    out = known.join(goal, "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
