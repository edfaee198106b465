"""Every operator against a brute-force version, on the small tables and on a table of odd rows."""

import hashlib
import math
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from loomline.llm import bwt_dedup, common, exact_dedup, language_id, mixing, packing, queries, sharding, simhash, suffix_trees, token_counts, vptree, windows  # noqa: E402
from loomline.llm.tokens import Encoder  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["documents", "odd", "none"])
def docs(request, spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet") if request.param == "documents" else request.getfixturevalue(request.param)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "", r.source, r.text) for r in docs.collect()]


def got(df, cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def token_ids(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, rows, tmp_path):
    want = Counter((i, len(t.encode()), n, n > 2048) for (i, t, *_), n in zip(rows, map(len, token_ids([r[1] for r in rows])), strict=True))
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time all is in the cache
        assert got(token_counts.token_counts(docs, TOKENIZER, cache=cache), ("doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    kept = docs.sparkSession.read.parquet(cache)
    assert kept.count() == kept.select("digest").distinct().count() <= len({r[1] for r in rows})


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_cache_of_hits_misses_and_a_digest_twice(docs, rows, tmp_path, few, monkeypatch):
    """Half the rows fill the cache, which then holds every digest twice; all rows are counted once, only the rest is encoded."""
    monkeypatch.setattr(token_counts.fill_cache, "__defaults__", (few,))
    cache, half = str(tmp_path / "cache"), docs.where("coalesce(doc_id, 0) % 2 = 0")
    token_counts.token_counts(half, TOKENIZER, cache=cache)
    kept = docs.sparkSession.read.parquet(cache)
    first = kept.count()
    if first:
        docs.sparkSession.createDataFrame(kept.collect(), kept.schema).write.mode("append").parquet(cache)
    want = Counter((i, len(t.encode()), n) for (i, t, *_), n in zip(rows, map(len, token_ids([r[1] for r in rows])), strict=True))
    assert got(token_counts.token_counts(docs, TOKENIZER, cache=cache), ("doc_id", "n_bytes", "n_tokens")) == want
    kept = docs.sparkSession.read.parquet(cache)
    assert kept.count() == first + kept.select("digest").distinct().count()


def test_word_table_is_exact():
    rng = np.random.default_rng(1)
    marks = [chr(c) for c in (*range(1, 300), 0x301, 0x308, 0x3C3, 0x3A3, 0x130, 0x2028, 0xFB01, 0x1100, 0x1161, 0x200D, 0x3000)] + ["<|endoftext|>", "<|startoftext|>", " ", " "]
    texts = ["".join(rng.choice(marks, rng.integers(60))) for _ in range(1500)]
    enc = Encoder(TOKENIZER, words_kept=50)
    assert enc.by_word
    assert enc.ids([t.encode() for t in texts]) == [np.array(x, "<u4").tobytes() for x in token_ids(texts)]


def test_a_word_is_looked_up_once_however_often_it_stands():
    class Asked(dict):
        n = 0

        def get(self, *key):
            self.n += 1
            return super().get(*key)

    letters = [chr(c) for c in range(0x180) if chr(c).isalpha()]
    words = [*letters, *(x + y for x in letters for y in "'.,<-~"), "", "l'été,", "we'll.", "Straße;", "ŸÉ!?", "x" * 3000, "<|endoftext|>", "a<|endoftext|>b"]
    texts = [" ".join(words), " \t\n\x0b\x0c\r".join(reversed(words)), "", " ", "\x1c a\x85b\xa0c\u3000d "] * 30
    for kept in (400_000, 7):
        enc = Encoder(TOKENIZER, words_kept=kept)
        enc.words.young, enc.parts.young = asked = Asked(), Asked()
        want = [np.array(x, "<u4").tobytes() for x in token_ids(texts)]
        assert enc.ids([t.encode() for t in texts]) == want and enc.counts([t.encode() for t in texts]) == [len(x) // 4 for x in want]
        assert 0 < min(t.n for t in asked) <= max(t.n for t in asked) <= 4 * len(words) < len(words) * 60


def test_exact_dedup(docs, rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t), i is None, i or 0, i))
    table = exact_dedup.exact_dedup(docs)
    want = Counter((i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert got(table, ("doc_id", "keep_id", "group_size", "text_sha256")) == want
    # one row of each group stays, rows that repeat its id and length included
    stays = [(r.doc_id, r.keep_id, r.text_sha256) for r in table.collect() if r.kept]
    assert Counter(h for *_, h in stays) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups) and all(i == k for i, k, _ in stays)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, len(r.text or ""), norm(r.text or "")) for r in kept.collect()) == Counter((min(g)[3], -min(g)[0], k) for k, g in groups.items())


def test_cuckoo_index():
    index, keys = exact_dedup.CuckooIndex(8), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(index.upsert(k, (1, 0, n, False, n), exact_dedup.better) for n, k in enumerate(keys))
    assert index.resizes and not any(index.upsert(k, (1, 0, 9, False, 9), exact_dedup.better) for k in keys)
    assert all(map(index.delete, keys[:2500])) and not any(map(index.delete, keys[:2500]))
    assert all(index.get(k) is None for k in keys[:2500]) and all(index.get(k)[0] == 2 for k in keys[2500:])
    assert all(index.upsert(k, (1, 0, 1, False, 1), exact_dedup.better) for k in keys[:100])


@pytest.mark.parametrize("bits", [0, 3])
def test_a_stored_index_takes_rows_and_deletions(docs, bits):
    """Half the rows, then the other half and three deletions: as if built at once without them; false hits are found out."""
    rows = common.materialise(exact_dedup.digests(docs), "digests")
    halves = [exact_dedup.entries_of(rows.where(f"row % 2 = {i}")) for i in (0, 1)]
    gone = rows.select("digest").distinct().orderBy("digest").limit(3)
    index = common.materialise(exact_dedup.update_index(None, halves[0], bits=bits), "index")
    index = common.materialise(exact_dedup.update_index(index, halves[1], gone), "index")
    dead = {bytes(r.digest) for r in gone.collect()}
    whole = {bytes(r.digest): tuple(r)[1:] for r in exact_dedup.live_entries(exact_dedup.build_index(rows)).collect()}
    assert {bytes(r.digest): tuple(r)[1:] for r in exact_dedup.live_entries(index).collect()} == {k: v for k, v in whole.items() if k not in dead}
    assert {bytes(r.digest) for r in exact_dedup.probe_index(index, rows.select("digest").distinct()).collect()} == set(whole) - dead
    assert index.count() <= 1 << bits


def test_false_hits_are_verified():
    """Digests of one tag and bucket: the filter can't tell them apart, the content does."""
    index, keys = exact_dedup.CuckooIndex(8), [bytes(10) + bytes([i]) * 22 for i in range(1, 9)]
    for n, k in enumerate(keys[:4]):
        assert index.upsert(k, (1, 0, n, False, n), exact_dedup.better)
    assert all(k in index.filter for k in keys) and index.get(keys[7]) is None and index.false_hits
    assert index.delete(keys[0]) and index.get(keys[1])[2] == 1 and index.get(keys[0]) is None


def brute_bytes(rows, w):
    texts = [t.encode() for _, t, *_ in rows]
    seen = Counter(hashlib.md5(b[i : i + w]).digest() for b in texts for i in range(len(b) - w + 1))
    out = Counter()
    for (i, *_), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for at in range(len(b) - w + 1):
            if seen[hashlib.md5(b[at : at + w]).digest()] > 1:
                gone[at : at + w] = b"\1" * w
        spans = len(re.findall(b"\1+", gone))
        out[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("w", [400, 60])
def test_bwt_dedup(docs, rows, w):
    assert got(bwt_dedup.bwt_dedup(docs, w), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(rows, w)


def test_bwt_merge_is_a_sort():
    """Many small shards give the repeats that one sorted list gives."""
    rng = np.random.default_rng(3)
    units = np.frombuffer(bytes(rng.choice(list(b"ab"), 6000).tolist()), np.uint8)
    start, size = np.arange(0, 6000, 100), np.full(60, 100)
    windows = np.full(60, 100 - 12 + 1)
    hit, _ = bwt_dedup.resolve(12, 4, 300)(units, start, size, windows, np.arange(60), np.zeros(60, bool))
    all_ = [units[a + o : a + o + 12].tobytes() for a in start for o in range(89)]
    n = Counter(all_)
    assert hit.tolist() == [n[x] > 1 for x in all_]


def brute_words(rows, w):
    seen, out = set(), Counter()
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = t.encode().split()
        gone = bytearray(len(words))
        for at in range(len(words) - w + 1):
            k = tuple(words[at : at + w])
            if k in seen:
                gone[at : at + w] = b"\1" * w
            seen.add(k)
        out[i, len(words), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(words, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("w", [20, 5])
def test_substring_dedup(docs, rows, w):
    assert got(suffix_trees.substring_dedup(docs, w), ("doc_id", "n_words", "n_removed", "kept_sha256")) == brute_words(rows, w)


@pytest.mark.parametrize("room, crowd, batch", [(0, 1 << 20, 1 << 19), (2, 40, 1), (1 << 13, 15, 5000)])
def test_long_prefixes_and_crowded_buckets(docs, rows, room, crowd, batch):
    """Grams lengthened to single windows, buckets folded by salts, small batches: the same rows."""
    kinds = [replace(k, room=room, crowd=crowd, batch=batch) for k in (bwt_dedup.kind_of(60, 16), suffix_trees.kind_of(5, 2))]
    by_bytes, by_words = (windows.repeated_windows(docs, k, "doc_id", "text") for k in kinds)
    assert got(by_bytes, ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(rows, 60)
    assert got(by_words, ("doc_id", "n_words", "n_removed", "kept_sha256")) == brute_words(rows, 5)


def test_prefix_groups_of_any_size():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 4000).astype(np.uint64)
    rows = np.arange(4000 - 8)
    want = Counter(words[r : r + 8].tobytes() for r in rows)
    alone = np.zeros(4000, bool)
    for group in (7, 100, 1 << 18):
        found = {int(r) for own, _ in suffix_trees.deep_nodes(words, alone, rows, 8, group) for r in own}
        assert found == {int(r) for r in rows if want[words[r : r + 8].tobytes()] > 1}


def brute_bfd(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        if room > x:
            insort(rooms, room - x)
    return n


def test_packing(docs, rows):
    table = packing.pack(docs, TOKENIZER, 512, 1).collect()
    ids = [[*x, 1] for x in token_ids([r[1] for r in rows])]
    want = Counter((i, k, at, zlib.crc32(np.array(x[at : at + 512], "<u4").tobytes()), len(x[at : at + 512])) for (i, *_), x in zip(rows, ids, strict=True) for k, at in enumerate(range(0, len(x), 512)))
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32, r.length) for r in table) == want
    bins = defaultdict(list)
    for r in table:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 512
    assert len(bins) == brute_bfd([r.length for r in table], 512)


def test_best_fit_by_histogram():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = Counter(rng.integers(1, 65, rng.integers(1, 400)).tolist())
        runs, n = packing.best_fit_decreasing(lengths, 64)
        assert n == brute_bfd(list(lengths.elements()), 64)
        assert sum(r[2] for r in runs) == lengths.total()


def waterfill(size, weights=(5, 2, 1)):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w, fixed, total = {n: weights[i % 3] for i, n in enumerate(names)}, set(), sum(size.values())
    while free := [n for n in names if n not in fixed]:
        left, all_ = total - sum(3 * size[n] for n in fixed), sum(w[n] for n in free)
        if not (more := [n for n in free if left * w[n] / all_ > 3 * size[n] + 1e-9]):
            return {n: 3 * size[n] if n in fixed else left * w[n] / all_ for n in names}
        fixed.update(more)
    return {n: 3.0 * size[n] for n in names}


def test_mixing(docs, rows):
    own = docs.withColumn("src", F.col("source"))
    table = mixing.mix(own, carry=("src",)).collect()
    again = mixing.mix(own)
    assert Counter((r.doc_id, r.size, r.src) for r in table) == Counter((i, len(WORD.findall(t)), s) for i, t, s, _ in rows)
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(WORD.findall(t))
    want = waterfill(dict(size) | {s: size[s] for _, _, s, _ in rows})
    taken = Counter()
    for r in table:
        assert r.source_size == size[r.src] and r.target == pytest.approx(want[r.src], abs=1e-6) and 0 <= r.taken <= 3 * r.size
        assert (r.taken == 0) == (not r.shards) and all(0 <= s < 16 for s in r.shards)
        taken[r.src] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in want)
    assert got(again, ("doc_id", "size", "taken")) == Counter((r.doc_id, r.size, r.taken) for r in table)


def test_the_tree_decides_which_documents_are_taken(spark, sf):
    """Another tree: other documents, the same words of each source, each document three times at most."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    one, two = ({r.doc_id: r for r in mixing.mix(docs, tree_seed=i, carry=("source",)).collect()} for i in (1, 2))
    sums = [Counter(), Counter()]
    for table, own in ((one, sums[0]), (two, sums[1])):
        for r in table.values():
            own[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
    assert sums[0] == sums[1] and all(abs(sums[0][r.source] - r.target) <= 0.51 for r in one.values())
    other = sum(r.taken != two[i].taken for i, r in one.items())
    assert other > 0.02 * len(one)


def test_mixing_of_integer_sources_and_odd_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.withColumn("source", F.substring("source", 4, 2).cast("int")).withColumns({c: F.lit(1) for c in ("__i", "__k", "__s", "doc", "i", "t", "s", "draw", "own", "a.b")})
    assert mixing.mix(odd.drop("a.b")).count() == docs.count()
    out = mixing.mixed_rows(odd)
    assert out.columns == [*odd.columns, "__shard", "__turn"] and out.count() > 0
    for f in (exact_dedup.drop_copies, simhash.drop_near_copies, language_id.drop_rejected):
        assert f(odd).columns == odd.columns


def test_split_quotas_are_exact(spark):
    counts = spark.createDataFrame([("a", 700), ("b", 31), (None, 5), ("c", 1)], "source string, n long")
    table = mixing.split_quotas(counts, 6, 1).collect()
    by_source, by_shard = Counter(), Counter()
    for r in table:
        by_source[r.source] += r.n
        by_shard[r.shard] += r.n
    assert by_source == {"a": 700, "b": 31, None: 5, "c": 1}
    assert len(by_shard) == 6 and max(by_shard.values()) - min(by_shard.values()) <= 2
    many = [mixing.split_quotas(counts.where("source in ('a', 'b')"), 2, s).where("source = 'b' and shard = 0").first() for s in range(12)]
    assert 11 < np.mean([m.n if m else 0 for m in many]) < 20  # hypergeometric: mean 15.5


def test_mixed_rows(docs, rows):
    out = mixing.mixed_rows(docs)
    assert out.columns == [*docs.columns, "__shard", "__turn"]
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += len(r.shards)
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_mix_shuffles_inside_a_shard(docs):
    table = mixing.mix(docs)
    at = defaultdict(list)
    for r in table.collect():
        assert len(r.shards) == len(r.places)
        for s, p in zip(r.shards, r.places, strict=True):
            at[s].append(p)
    assert all(sorted(p) == list(range(len(p))) for p in at.values())
    turn = F.xxhash64(F.xxhash64(F.xxhash64("doc_id", F.lit(17)), F.lit(18)), "pass", F.lit(21))  # of its draws, from 0
    draws = table.where("doc_id is not null").select("doc_id", F.posexplode(F.arrays_zip("shards", "places")).alias("pass", "d"))
    rows = sorted((r.s, r.p, r.t) for r in draws.select(F.col("d.shards").alias("s"), F.col("d.places").alias("p"), turn.alias("t")).collect())
    assert rows == sorted(rows, key=lambda r: (r[0], r[2], r[1]))


def test_mixed_rows_come_in_order(docs):
    for slice_rows in (3, 2048):
        rows = [(r["__shard"], r["__turn"]) for r in mixing.mixed_rows(docs, slice_rows=slice_rows).collect()]
        seen = set(rows)
        assert rows == sorted(seen) and all(p == 0 or (s, p - 1) in seen for s, p in rows)


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, bits=4):
    root = list(range(len(marks)))
    for i in range(len(marks)):
        todo = [i] if root[i] == i else []
        while todo:
            x = todo.pop()
            for y in range(len(marks)):
                if root[y] > i and (marks[x] ^ marks[y]).bit_count() <= bits:
                    root[y] = i
                    todo.append(y)
    return root


def test_simhash(docs, rows):
    marks = [fingerprint(t) for _, t, *_ in rows]
    least = defaultdict(list)
    roots = components(marks)
    for r, (i, *_) in zip(roots, rows, strict=True):
        least[r] += [i] if i is not None else []
    want = Counter((i, f"{m:016x}", min(least[r], default=None)) for (i, *_), m, r in zip(rows, marks, roots, strict=True))
    assert got(simhash.simhash_dedup(docs), ("doc_id", "fingerprint", "component_id")) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_fingerprints_of_long_texts(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 50, n)) + end for n in (0, 1, 2, 3, 4, 5, 40, 30_000) for end in ("", " ", "\n\n x")]
    for text in texts:
        assert int.from_bytes(simhash.fingerprint(text), "big") == fingerprint(text)
    cut = simhash.cut_words
    monkeypatch.setattr(simhash, "cut_words", lambda raw: cut(raw, 3))
    assert all(int.from_bytes(simhash.fingerprint(t), "big") == fingerprint(t) for t in texts[:-3])


@pytest.mark.parametrize("hot", [100_000, 20])
def test_simhash_of_a_crowd(spark, hot):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(1 << 62))
    marks = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(300)] + [int(x) for x in rng.integers(1 << 62, size=100)]
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(i, i, m) for i, m in enumerate(signed)], "id long, key long, fp long")
    found = {r.id: r.component_id for r in simhash.near_components(df, 4, hot).collect()}
    assert [found[i] for i in range(len(marks))] == components(marks)


def test_sharding(docs, rows):
    table = sharding.shard_documents(docs, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in table) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in table:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    # equal texts share a shard; the fullest shard is at most the even share or the largest group above it
    of, groups, shards = {(r.doc_id, r.text_crc32): r.shard for r in table}, defaultdict(set), Counter()
    for r in table:
        shards[r.shard] += r.size
    for i, t, *_ in rows:
        if t:  # null texts are a group beside empty ones
            groups[t].add(of[i, zlib.crc32(t.encode())])
    assert all(len(g) == 1 for g in groups.values())
    largest = Counter()
    for _, t, *_ in rows:
        largest[t] += len(t.encode()) + 1
    if rows:
        assert max(shards.values()) <= sum(shards.values()) / 16 + max(largest.values())


def test_shards_of_documents_are_even(spark, sf):
    table = sharding.shard_documents(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), 16).collect()
    shards = Counter()
    for r in table:
        shards[r.shard] += r.size
    assert len(shards) == 16 and max(shards.values()) - min(shards.values()) <= 0.001 * max(shards.values())


def test_differencing():
    rng = np.random.default_rng(11)
    items = rng.integers(1, 10_000, 500).tolist()
    where, sums = sharding.differencing([[0, 0, 0, x] for x in items])
    got = [0] * 4
    for x, at in zip(items, where, strict=True):
        got[at[3]] += x
    assert got == sums and max(sums) - min(sums) <= 20


def test_sharding_in_levels(spark):
    rng = np.random.default_rng(4)
    size = rng.integers(1, 5000, 3000).tolist()
    df = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(size)], "node string, bytes long")
    at = {r.node: r.shard for r in sharding.balance(df, 8, bucket_groups=50, fan=4).collect()}
    sums = np.zeros(8)
    for i, s in enumerate(size):
        sums[at[f"g{i}"]] += s
    assert len(at) == 3000 and sums.max() - sums.min() < 5000


@pytest.mark.parametrize("relax", [1.0, 1.5])
def test_nearest(spark, sf, relax):
    x = spark.read.parquet(f"{sf}/embeddings.parquet")
    many = x.unionByName(spark.createDataFrame([(10_000 + i, [0.5] * 64, 0) for i in range(60)] + [(20_001, None, 0), (20_002, [0.0] * 64, 0), (20_003, [float("nan")] * 64, 0), (20_004, [None] + [1.0] * 63, 0), (20_005, [1.0] * 3, 0), (None, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int"))
    rows = {r.vec_id: np.array(r.embedding, float) for r in many.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    table = vptree.nearest(many, many.where("vec_id % 20 = 0"), 20, relax, shard_rows=200, block_rows=10, leaf=16).collect()
    found = defaultdict(list)
    for r in sorted(table, key=lambda r: r["rank"]):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i in rows if i % 20 == 0}
    hit = total = 0
    for q, hits in found.items():
        want = sorted(((-float(v @ rows[q]), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])))[:20]
        assert [r for r, _ in hits] == [i for _, i in sorted((-s, i) for i, s in hits)]
        total += len(want)
        hit += sum(s >= -want[-1][0] - 1e-12 for _, s in hits)
        assert all(s == pytest.approx(float(rows[q] @ rows[i]), abs=1e-12) for i, s in hits)
        if relax == 1.0:
            assert [s for _, s in hits] == pytest.approx([-w for w, _ in want], abs=1e-12)
    assert hit / total >= 0.9


def test_ties_of_distinct_vectors_go_to_smaller_ids(spark):
    """2000 distinct vectors of one score, in several leaves and shards, by exact search."""
    rows = [(i, [1.0] + [float(j == i % 50) * (1 + i) for j in range(50)]) for i in range(2000)] + [(5000, [1.0] + [0.0] * 50)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (4096, 300):
        got_ = vptree.nearest(x, x.where("vec_id = 5000"), 20, 1.0, shard_rows=shard_rows, leaf=64).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got_] == [(i, 1.0) for i in range(20)]


def test_stored_trees(spark, sf, tmp_path):
    x = spark.read.parquet(f"{sf}/embeddings.parquet")
    vptree.build_index(x, 100, path=str(tmp_path / "trees"))
    found = vptree.search_index(vptree.open_index(spark, str(tmp_path / "trees")), x.where("vec_id % 20 = 0"), 20, 1.0)
    assert got(found, ("query_id", "rank", "vec_id")) == got(vptree.nearest(x, x.where("vec_id % 20 = 0"), 20, 1.0), ("query_id", "rank", "vec_id"))


def test_nearest_of_nothing(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").where("false")
    assert vptree.nearest(x, x).count() == 0


FOLDED = {b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)}
MARKS = set("#$%&*+/<=>@[]\\^_`{|}~")


def brute_language(rows, labels):
    """(language, confidence) of each row, with every row labelled in the sample: plain Python over trigram dictionaries."""
    def grams(t):
        b = [FOLDED[x] for x in t.encode()]
        out = [tuple(b[i : i + 3]) for i in range(len(b) - 2)]
        out = [g for g in out if not (g[1] == 32 and 32 in (g[0], g[2]))]
        return [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> 18 for g in out], sum(x != 32 for x in b), sum(c in MARKS for c in t)

    names = sorted({x for x in labels if x is not None})
    counts = {n: Counter() for n in names}
    seen = [grams(t) for _, t, *_ in rows]
    for (g, *_), label in zip(seen, labels, strict=True):
        if label is not None:
            counts[label].update(g)
    k, text = len(names) + 1, []
    for g, letters, marks in seen:
        half = {n: 0.5 * min(1, counts[n].total() / 2**14) for n in names}
        by = [sum(math.log((counts[n][x] + half[n]) / (counts[n].total() + half[n] * 2**14)) for x in g) for n in names]
        say = lambda r: marks * math.log(r) + letters * math.log(1 - r)  # noqa: B023, E731
        log = [(x + say(0.01)) / 8 for x in by] + [max(-len(g) * 14 * math.log(2) + say(0.01), max(by) + say(0.5)) / 8 + math.log(1e-3)]
        p = [math.exp(x - max(log)) for x in log] if letters else [0.0] * len(names) + [1.0]
        text.append([x / sum(p) for x in p])
    prior = [(sum(p[j] for p in text) + 1 / k) / (len(text) + 1) for j in range(k)]

    def smoothed(values):
        sums, n = defaultdict(lambda: [0.0] * k), Counter(values)
        for v, p in zip(values, text, strict=True):
            sums[v] = [a + b for a, b in zip(sums[v], p, strict=True)]
        return [prior if v is None else [(max(a - b, 0) + 20 * q) / (n[v] - 1 + 20) for a, b, q in zip(sums[v], p, prior, strict=True)] for v, p in zip(values, text, strict=True)]

    found = [re.search(r"(?:@|://)[A-Za-z0-9.-]*\.([A-Za-z]{2,})\b", t) for _, t, *_ in rows]
    hosts, suffixes = smoothed([s for _, _, s, _ in rows]), smoothed([m and m[1].lower() for m in found])
    out = []
    for p, h, f in zip(text, hosts, suffixes, strict=True):
        score = [math.log(max(a, 1e-12)) + math.log(max(b, 1e-6)) + math.log(max(c, 1e-6)) - math.log(max(q, 1e-6)) for a, b, c, q in zip(p, h, f, prior, strict=True)]
        e = [math.exp(x - max(score)) for x in score]
        out.append(([*names, "und"][e.index(max(e))], max(e) / sum(e)))
    return out


def test_language_id(docs, rows):
    out = language_id.language_id(docs).collect()
    want = brute_language(rows, [r.lang for r in docs.collect()]) if rows else []
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in rows)
    assert all(r.kept == (r.language != "und") and 0 <= r.confidence <= 1 + 1e-9 for r in out)
    close = lambda x: round(x, 2)
    assert Counter((r.doc_id, r.language, close(r.confidence)) for r in out) == Counter((i, n, close(c)) for (i, *_), (n, c) in zip(rows, want, strict=True))
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, raw) for (i, _, _, raw), (n, _) in zip(rows, want, strict=True) if n != "und")


def test_without_labels_no_language_is_known(spark):
    rows = spark.createDataFrame([(1, "some words here", None, "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.language, r.kept) for r in language_id.language_id(rows).collect()] == [("und", False)] * 2


def test_a_very_long_text_is_tallied_in_pieces():
    rng = np.random.default_rng(8)
    text = bytes(rng.choice(list(b"abc d$.Z\xc3\xa9"), 5 * language_id.PIECE + 1).tolist())
    data, ends, weights = np.frombuffer(text, np.uint8), np.array([0, len(text)]), rng.random((2, 1 << 14))
    whole = language_id.tallies(data, ends, weights)
    code, folded = language_id.trigrams(data, ends[1:])
    live = code[code >= 0]
    assert whole[0] == pytest.approx([weights[0][live].sum(), weights[1][live].sum(), len(live), (folded != 32).sum(), language_id.SYMBOL[data].sum()])


def test_language_accuracy_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    seen = language_id.identify(language_id.document_evidence(docs.where("doc_id % 2 = 1")), model)
    hits = docs.select("doc_id", "lang").join(seen, F.col("doc_id") == F.col("id"))
    right, kept = hits.agg(F.avg(F.when(F.col("kept"), (F.col("lang") == F.col("language")).cast("int"))), F.avg(F.col("kept").cast("int"))).first()
    assert right > 0.99 and kept > 0.94  # junk, words drowned in symbols, goes: some 4 % of these tables


def test_evidence_decides_where_text_can_not(spark):
    model = language_id.fit(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)], "doc_id long, text string, lang string"))
    pages = [(i, f"https://a{i % 3}.example.{'de' if i % 2 else 'com'}/x", f"<html lang='{'de' if i % 2 else 'en'}'><p>{'der hund und' if i % 2 else 'the cat and'}</p></html>") for i in range(200)]
    pages += [(900, "https://q.example.de/", "<html lang=de><p>o</p></html>"), (901, "https://q.example.com/", "<html lang=en><p>o</p></html>"), (902, None, None)]
    out = {r.page_id: r for r in language_id.page_language_id(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert out[900].language == "de" and out[901].language == "en" and not out[902].kept


@pytest.mark.parametrize("labelled", [10_000, 30])
def test_junk_and_unknown_scripts_go(spark, sf, labelled):
    """Unknown scripts, random letters and words drowned in symbols are rejected whatever the size of the table; clean rows stay."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang", "source").where(f"doc_id < {labelled}")
    rng = np.random.default_rng(5)
    odd = ["Съешь ещё этих мягких французских булок да выпей чаю, потом ложись спать и не забудь закрыть окно " * 3, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈" * 4,
           " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(60))]
    clean = [r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(5).collect()]
    drowned = [" ".join(w + "$%#&"[i % 4] * 4 for i, w in enumerate(t.split())) for t in clean if len(t.split()) > 40]
    extra = spark.createDataFrame([(-1 - i, t, None, "src0") for i, t in enumerate(odd + drowned)], docs.schema)
    out = language_id.language_id(docs.union(extra)).cache()
    assert drowned and not out.where("kept and doc_id < 0").count()
    marks = F.length(F.regexp_replace("text", r"[^#$%&*]", "")) > 0.1 * F.length("text")
    plain = docs.where(~marks & F.col("text").rlike("[A-Za-z]{2}")).select("doc_id")
    assert out.join(plain, "doc_id").where("kept").count() >= 0.99 * plain.count()


def test_queries_with_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        cols = sorted(df.columns)
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_components_of_chains_and_hubs(spark):
    """A long chain, a hub of many and a ring of pairs settle; too few rounds are an error."""
    chain = [(i, i + 1) for i in range(1000, 1600)]
    hub = [(5000, 6000 + i) for i in range(3000)]
    ring = [(9000 + i, 9000 + (i + 1) % 50) for i in range(50)] + [(3, 3)]
    edges = spark.createDataFrame(chain + hub + ring, "a long, b long")
    got_ = {r.node: r.root for r in common.connected_components(edges).collect()}
    want = {n: 1000 for n in range(1000, 1601)} | {5000: 5000} | {6000 + i: 5000 for i in range(3000)} | {9000 + i: 9000 for i in range(50)}
    assert got_ == want
    with pytest.raises(RuntimeError):
        common.connected_components(edges, max_rounds=2)
