"""Token counts through a digest cache.

The cache is a table (version, digest, n_tokens): version is the digest of the tokenizer file, digest that of the
normalised text. Documents are reduced to narrow rows (id, bytes, digest), which are joined to it by digest; of the
misses, one row for each digest is encoded, and the counts are appended. Only the texts of these rows are moved: up to
`FEW` of them are marked by a broadcast of their keys, more are met by a join. A call whose texts are all in the cache moves none.

The representative of a digest is the least id of a pre-aggregated minimum, so a text that a third of the rows share is
encoded once and read by no single task. Jobs that append at once may leave a digest in the cache twice; it is read once.

Null texts count as empty; null ids stay (one row each); repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, fresh_path, materialise, text_or_empty
from .tokens import drops_white, encoder

CACHE = "version string, digest binary, n_tokens long"
#: Rows of some 60 bytes that a broadcast may hold.
FEW = 10_000


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digested(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_bytes, digest). Normalisation is what the vocabulary can't tell apart: kinds of white space if it
    drops them, else nothing. key: a quick hash of the text, which finds the row of an id again."""
    text = text_or_empty(text_col)
    norm = F.translate(text, "\t\n\x0b\x0c\r", "     ") if drops_white(tokenizer) else text
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(norm, 256)).alias("digest"))


def encode_misses(rows: DataFrame, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            yield pa.record_batch([b.column("digest").cast(pa.binary()), pa.array(enc.counts(b.column("body").cast(pa.binary()).to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    return rows.select("digest", "body").mapInArrow(run, "digest binary, n_tokens long")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer, a row a digest."""
    return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, narrow: DataFrame, tokenizer: str, version: str, cache: str, id_col: str, text_col: str, few: int = FEW) -> int:
    """Encodes what the cache lacks and appends it; gives how many texts that were. narrow: digested(docs), materialised."""
    spark, known = docs.sparkSession, exists(docs.sparkSession, cache)
    least = narrow.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("x")).select("digest", F.col("x.id").alias("id"), F.col("x.key").alias("key"))
    if known:
        least = least.join(read_cache(spark, cache, version), "digest", "left_anti")
    least = materialise(least, "misses")
    if not (n := least.count()) and known:
        return 0
    text = text_or_empty(text_col)
    bodies = docs.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("k"), text.alias("body"))
    missing = bodies.join(F.broadcast(least) if n <= few else least.hint("merge"), F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")))
    new = encode_misses(missing, tokenizer).dropDuplicates(["digest"])
    new.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    return n


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit. cache: a table's path, kept between calls; None: a new one."""
    spark = docs.sparkSession
    cache, version = cache or fresh_path(spark, "token-cache"), version_of(tokenizer)
    narrow = materialise(digested(docs, tokenizer, id_col, text_col), "digests")
    fill_cache(docs, narrow, tokenizer, version, cache, id_col, text_col)
    # written, so that the join has an exchange on either side and a digest that many rows share can be split
    known = materialise(read_cache(spark, cache, version), "known")
    out = narrow.select("id", "n_bytes", "digest").join(known, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
