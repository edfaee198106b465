"""Language identification by Bayesian evidence fusion.

The classes are the languages of the labelled rows and "und", no language. Text: a naive Bayes likelihood over hashed byte
trigrams of the whole text, tempered (neighbouring trigrams overlap). Its model is fitted on a bounded sample of labelled
rows: about `bound` rows by a hash of the id. "und" explains a text as noise (every trigram as likely as any other: unknown
languages and scripts, random letters) or as words of a language drowned in symbols (as many symbols as letters, where
a language has one in a hundred); it starts from `DOUBT`, so a text has to speak for it.
Declared markup language and address suffix: the ratio P(language | value) / P(language), from sums of the text
posteriors grouped by value over all rows. Host: a prior smoothed towards its domain's, which is smoothed towards that
of all rows, from grouped sums too. Every sum leaves out the row's own posterior; missing values say nothing. Documents have
no address and no markup of their own: their source is the host, and the first address or <html lang> in the text is used.

A row is rejected (language "und", kept false) if "und" has the largest posterior; a text without any letter is "und" for
certain. A short text has little evidence, so it goes with its priors. Null texts count as empty and so are rejected. Null
ids and repeated rows stay. An empty table gives none; without labelled rows no language is known and all is "und".
More than `MOST` languages are an error, as the model goes to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, materialise, text_slices
from .tokens import forget

BITS, MOST = 14, 512
DOUBT, PLAIN, DROWNED = 1e-3, 0.01, 0.5
#: Bytes of a text that are looked at together.
PIECE = 1 << 19
#: ASCII other than letters is a space; upper-case ASCII is lower-cased; all other bytes stand for themselves.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
#: ASCII that is neither a letter, a digit, white space nor the punctuation of sentences.
SYMBOL = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in "'\"(),-.:;?!" for b in range(256)])


def trigrams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end -> a feature for each position (-1: spaces only, or across two texts), letters seen."""
    b = FOLD[data]
    if len(b) < 3:
        return np.full(len(b), -1, np.int32), b
    code = np.full(len(b), -1, np.int32)
    whole = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    feature = ((whole * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    blank = (b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32))
    code[:-2] = np.where(blank, -1, feature)
    for back in (1, 2):
        at = ends - back
        code[at[at >= 0]] = -1
    return code, b


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # languages x features, log probabilities

    @property
    def classes(self) -> list[str]:
        return [*self.languages, "und"]


def fit(rows: DataFrame, bound: int = 4000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> TextModel:
    """The sample: labelled rows whose hashed id falls under bound / rows; its size is about `bound` at any scale."""
    own = rows.where(F.col(label_col) != "und")
    if own.select(label_col).distinct().limit(MOST + 1).count() > MOST:
        raise ValueError(f"more than {MOST} languages")
    share = min(1.0, bound / max(1, own.count()))
    sample = own.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, at = batch.column(0).to_pylist(), 0
            for data, ends in text_slices(batch.column(1), PIECE):
                code, _ = trigrams(data, ends[1:])
                for i in range(len(ends) - 1):
                    c = code[ends[i] : ends[i + 1]]
                    sums.setdefault(labels[at], np.zeros(1 << BITS, np.int64))
                    sums[labels[at]] += np.bincount(c[c >= 0], minlength=1 << BITS)
                    at += 1
        for label, n in sums.items():
            f = np.flatnonzero(n)
            yield pa.record_batch([pa.array([label] * len(f), pa.string()), pa.array(f, pa.int32()), pa.array(n[f], pa.int64())], names=["label", "feature", "n"])

    # at most 2^14 rows a language
    got = sample.select(label_col, text_col).mapInArrow(count, "label string, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    names = sorted(set(got["label"]))
    n = np.zeros((len(names), 1 << BITS))
    n[[names.index(x) for x in got["label"]], got["feature"]] = got["n"]
    # half a count for each feature, less where the sample is smaller than the features: else a language of a few words is as flat as noise
    n += 0.5 * np.minimum(1, n.sum(axis=1, keepdims=True) / (1 << BITS))
    return TextModel(names, np.log(n / n.sum(axis=1, keepdims=True)))


def tallies(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each text: log likelihood of its trigrams by language, trigrams, letters, symbols."""
    if len(data) > 4 * PIECE:  # one text
        parts = [tallies(data[at : at + PIECE + 2], np.array([0, min(PIECE + 2, len(data) - at)]), weights) for at in range(0, len(data), PIECE)]
        twice = [tallies(data[at : at + 2], np.array([0, len(data[at : at + 2])]), weights) for at in range(PIECE, len(data), PIECE)]
        return sum(parts) - sum(twice)
    code, folded = trigrams(data, ends[1:])
    live = code >= 0
    sums = lambda v: np.diff(np.r_[0, np.cumsum(v, dtype=np.float64)][ends])
    return np.stack([*(sums(np.where(live, w[code], 0)) for w in weights), sums(live), sums(folded != 32), sums(SYMBOL[data])], 1)


def posteriors(tally: np.ndarray, temper: float) -> np.ndarray:
    """Of each text the classes' posteriors by its text alone, languages even."""
    by_language, (n, letters, symbols) = tally[:, :-3], tally[:, -3:].T
    if not by_language.shape[1]:
        return np.ones((len(tally), 1))
    share = lambda r: symbols * np.log(r) + letters * np.log(1 - r)
    noise, drowned = -n * BITS * np.log(2) + share(PLAIN), by_language.max(axis=1) + share(DROWNED)
    log = np.c_[by_language + share(PLAIN)[:, None], np.maximum(noise, drowned)] / temper
    log[:, -1] += np.log(DOUBT)
    log[letters == 0] = [-np.inf] * by_language.shape[1] + [0.0]
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def text_evidence(rows: DataFrame, model: TextModel, temper: float = 8.0) -> DataFrame:
    """(id, body, ...) -> the other columns and p array<double>, a number a class."""
    names = [c for c in rows.columns if c != "body"]
    schema = T.StructType([*(f for f in rows.schema if f.name != "body"), *T._parse_datatype_string("p array<double>")])
    shared = rows.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))  # MOST x 2^14 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        weights = shared.value
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            if not batch.num_rows:
                continue
            p = np.concatenate([posteriors(tallies(data, ends, weights), temper) for data, ends in text_slices(batch.column("body"), PIECE)])
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), p.ravel())
            yield pa.record_batch([*(batch.column(c) for c in names), lists], names=[*names, "p"])

    return rows.mapInArrow(run, schema)


def _total(k: int) -> Column:
    return F.array(*(F.sum(F.col("p")[i]) for i in range(k)))


def _smoothed(sums: Column, n: Column, parent: Column, weight: float) -> Column:
    """(sums without the own posterior + weight * parent) / (n - 1 + weight), for each language."""
    rest = F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    return F.zip_with(rest, parent, lambda s, q: (s + weight * q) / (n - 1 + weight))


def fuse(seen: DataFrame, classes: list[str], weight: float = 20.0, floor: float = 1e-6) -> DataFrame:
    """seen: id, p, declared, suffix, domain, host -> the same and posterior array<double>."""
    k = len(classes)
    whole = seen.agg(_total(k).alias("sums"), F.count("*").alias("n")).select(
        F.transform("sums", lambda s: (s + 1.0 / k) / (F.col("n") + 1)).alias("base"))
    base = whole.first()  # k numbers
    prior = F.array(*map(F.lit, base[0] if base and base[0] else [1.0 / k] * k))
    out = seen
    for name, parent in (("declared", prior), ("suffix", prior), ("domain", prior), ("host", F.col("domain_p"))):
        # written, so that the join has an exchange on either side and a value that many rows share can be split
        sums = materialise(seen.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(_total(k).alias("_s"), F.count("*").alias("_n")), "sums")
        value = F.when(F.col("_n").isNotNull(), _smoothed(F.col("_s"), F.col("_n"), parent, weight)).otherwise(parent)
        out = out.join(sums, out[name] == F.col("_v"), "left").withColumn(f"{name}_p", value).drop("_v", "_s", "_n")
    log = lambda a, least=floor: F.transform(a, lambda x: F.log(F.greatest(x, F.lit(least))))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    score = plus(log("p", 1e-12), log("host_p"))
    for name in ("declared_p", "suffix_p"):
        score = plus(score, minus(log(name), log(prior)))
    out = out.withColumn("score", score).withColumn("score", F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    return out.withColumn("all", F.aggregate("score", F.lit(0.0), lambda a, x: a + x)).withColumn("posterior", F.transform("score", lambda x: x / F.col("all")))


def identify(evidence: DataFrame, model: TextModel, weight: float = 20.0) -> DataFrame:
    """evidence: id, body, declared, suffix, domain, host -> id, language, confidence (its posterior), kept."""
    seen = materialise(text_evidence(evidence, model), "evidence", "zstd", TEXTS)
    names, best = F.array(*map(F.lit, model.classes)), F.array_max("posterior")
    out = fuse(seen, model.classes, weight).withColumn("language", names[F.array_position("posterior", best).cast("int") - 1])
    return out.select("id", "language", best.alias("confidence"), (F.col("language") != "und").alias("kept"))


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def document_evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A document has no address or markup of its own: of those in its text the first is used; its source is the host."""
    text = F.col(text_col)
    suffix = F.regexp_extract(text, r"(?:@|://)[A-Za-z0-9.-]*\.([A-Za-z]{2,})\b", 1)
    declared = F.regexp_extract(text, r"(?i)<html[^<>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("body"),
        _some(F.lower(F.when(text.contains("<html") | text.contains("<HTML"), declared))).alias("declared"),
        _some(F.lower(F.when(text.contains("@") | text.contains("://"), suffix))).alias("suffix"),
        F.lit(None).cast("string").alias("domain"), F.col(host_col).cast("string").alias("host"),
    )


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    html, url = F.col(html_col), F.lower(F.col(url_col))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    return pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ").alias("body"),
        _some(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))).alias("declared"),
        _some(F.concat_ws("/", _some(F.regexp_extract(host, r"\.([a-z]+)$", 1)), _some(F.regexp_extract(url, r"^[^:]+://[^/]+/([a-z]{2})(?:/|$)", 1)))).alias("suffix"),
        _some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), _some(host).alias("host"),
    )


def language_id(docs: DataFrame, bound: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """One row a document: id, language, confidence, kept."""
    model = fit(docs, bound, id_col=id_col, text_col=text_col, label_col=label_col)
    return identify(document_evidence(docs, id_col, text_col, host_col), model).select(F.col("id").alias(id_col), "language", "confidence", "kept")


def page_language_id(pages: DataFrame, model: TextModel) -> DataFrame:
    return identify(page_evidence(pages), model).select(F.col("id").alias("page_id"), "language", "confidence", "kept")


def drop_rejected(docs: DataFrame, bound: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source") -> DataFrame:
    """The rows that identify() keeps, with all their columns. Its verdicts are written, keyed by a hash of id, text and
    source; rows that repeat these share their verdict."""
    model = fit(docs, bound, id_col=id_col, text_col=text_col, label_col=label_col)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64(id_col, text_col, host_col).alias("key"), F.col(text_col).alias("body"), F.col(host_col).alias("host"))
    verdicts = materialise(identify(document_evidence(whole, "key", "body", "host"), model), "verdicts")
    gone = verdicts.where("not kept").select(F.col("id").alias("gone"))
    return whole.join(gone, F.col("key") == F.col("gone"), "left_anti").select("doc.*")
