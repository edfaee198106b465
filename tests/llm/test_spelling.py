"""Spelling variants against brute force: the trie, parts of any depth, and the query on the small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """By deletion keys: words that share one are checked."""
    keys = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys.setdefault(k, []).append(w)
    pairs = {(a, b) for own in keys.values() for a in own for b in own if a != b and one_edit(a, b)}
    out = {w: [] for w in words}
    for a, b in pairs:
        out[a].append(b)
    return out


def brute(rows, least_chars=6, least_n=5, ratio=5, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_n}
    near, form = neighbours(n), {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = Counter()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w, n[w], len(near[w]), form[w], n.get(form[w]), root] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_trie_pairs(parts):
    rng = random.Random(parts)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(400)})
    part = np.array([zlib.crc32(w.encode()) % parts for w in words])
    trie = spelling.Trie(words, part, np.zeros(len(words), np.int64))
    found = Counter((int(a), int(b)) for x, y in trie.pairs() for a, b in zip(x, y, strict=True))
    assert found == Counter((i, j) for i, a in enumerate(words) for j, b in enumerate(words) if part[i] == part[j] and one_edit(a, b))


@pytest.mark.parametrize("most", [1 << 15, 40, 1])
def test_parts_of_any_depth_lose_no_pair(spark, most):
    """most = 1 cuts every shared prefix, so all pairs part ways above their parts."""
    rng = random.Random(7)
    words = {"".join(rng.choices("abéÿ", k=rng.randint(6, 8))) for _ in range(300)} | {"abcabc", "abcabca", "abcabcab"}
    n = {w: rng.randint(5, 9) for w in words}
    rows = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), most=most).collect()
    near = neighbours(words)
    best = {w: min(own, key=lambda v: (-n[v], v), default=None) for w, own in near.items()}
    assert {(r.word, r.n, r.n_near, r.near, r.near_n) for r in rows} == {(w, n[w], len(near[w]), best[w], n.get(best[w])) for w in words}


@pytest.mark.parametrize("every, least_n", [(199, 5), (3, 1)])
@pytest.mark.parametrize("kind", ["documents", "odd", "none"])
def test_spelling_variants(request, spark, sf, kind, every, least_n):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if kind == "documents" else request.getfixturevalue(kind)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], least_n=least_n, every=every)
    assert got(spelling.spelling_variants(docs, least_n=least_n, every=every)) == want
    assert kind != "documents" or want


def test_chains_letters_and_long_words(spark):
    """Forms of forms, letters beyond A-Z kept as they are, a run of 20,000 letters, signs that cut runs, ties by code point."""
    long = "ab" * 10_000
    texts = ["kolonne " * 125, "kolonnd " * 25, "kolonnf " * 25, "kolonfd " * 5, "ÉTUDES " * 10 + "études " * 60, f"{long} {long}c " * 6, "don't—donut5donuts" * 9, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.word: r for r in spelling.spelling_variants(docs, every=10**9).collect()}
    assert found["kolonfd"].form in ("kolonnd", "kolonff") and found["kolonfd"].root == "kolonne"
    assert found["Études"].root == "études" and found["Études"].n == 10
    assert found[long].n_near == found[long + "c"].n_near == 1
    assert Counter({(w, r.n, r.n_near, r.form, r.form_n, r.root): 1 for w, r in found.items()}) == brute(list(enumerate(texts)), every=10**9)
