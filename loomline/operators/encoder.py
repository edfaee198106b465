"""A text encoder that is fitted here: hashed words weighted by rarity, projected by a distributed singular value decomposition.

A text is a sparse vector over `buckets` hashed words, log counts times inverse document frequency, length one. The projection is
the `dim` leading right singular vectors of a bounded sample's matrix, by randomised subspace iteration: each round every task
sums its rows' share of A'A times the basis, the shares meet by bucket, and the driver holds a basis of buckets x dim numbers.
The sample is a hashed choice of about `sample` rows (a parameter); weights and projection are the model, saved as a table.

Words are runs of letters and digits in lower case. A null text, or one without words, has a vector of zeros."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import landed, slices

WORD = re.compile(r"[^\W_]+")
#: Buckets that meet in one task of a round.
GROUP = 1024


def hashed(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, ascending, and log counts of a text's words."""
    n: Counter[int] = Counter()
    for w, k in Counter(WORD.findall((text or "").lower())).items():
        n[zlib.crc32(w.encode()) % buckets] += k
    at = np.fromiter(sorted(n), np.int32, len(n))
    return at, np.log1p(np.fromiter((n[i] for i in at), np.float64, len(at)))


def unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


class Encoder:
    def __init__(self, weights: np.ndarray, basis: np.ndarray):
        """weights: of each bucket; basis: buckets x dim, orthonormal columns."""
        self.weights, self.basis = weights, basis

    @property
    def dim(self) -> int:
        return self.basis.shape[1]

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            at, n = hashed(text, len(self.weights))
            out[i] = (n * self.weights[at]) @ self.basis[at]
        return unit(out).astype(np.float32)

    def encode(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """The rows with `embedding`, an array<float> of length one, or zero."""
        model = rows.sparkSession.sparkContext.broadcast((self.weights, self.basis))  # buckets x dim numbers, whatever the rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Encoder(*model.value)
            for part in slices(batches):
                v = own.vectors(part.column(text).to_pylist())
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, own.dim, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, each], names=[*part.schema.names, "embedding"])

        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{kinds}, embedding array<float>")

    def __call__(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return self.encode(rows, text)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), v.astype(np.float64).tobytes()) for i, (w, v) in enumerate(zip(self.weights, self.basis, strict=True))]
        spark.createDataFrame(rows, "bucket int, weight double, basis binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(path).orderBy("bucket").collect()  # as many as buckets
        return cls(np.array([r.weight for r in rows]), np.array([np.frombuffer(r.basis) for r in rows]))


def fit(rows: DataFrame, text: str = "text", dim: int = 64, buckets: int = 1 << 14, sample: int = 20_000, rounds: int = 3, seed: int = 1) -> Encoder:
    spark, all_ = rows.sparkSession, rows.count()
    share = min(1.0, sample / max(1, all_))
    some = rows.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [hashed(t, buckets) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.float64()))], names=["at", "n"])

    a = landed(some.mapInArrow(sparse, "at array<int>, n array<double>"), "sparse")
    n = a.count()
    df = np.zeros(buckets)
    for r in a.select(F.explode("at").alias("b")).groupBy("b").count().collect():  # as many as buckets
        df[r.b] = r["count"]
    weights = np.log((n + 1) / (df + 1)) + 1
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, dim)))[0]
    for _ in range(rounds + 1):
        share_ = times(a, weights, basis)
        last, (basis, _) = basis, np.linalg.qr(share_)
    # the small matrix last' A'A last turns the subspace into singular vectors, the largest first
    values, turn = np.linalg.eigh(last.T @ share_)
    return Encoder(weights, last @ turn[:, np.argsort(-values)])


def times(a: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis, A's rows the weighted texts of length one."""
    buckets, dim = basis.shape
    model = a.sparkSession.sparkContext.broadcast((weights, basis))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, q = model.value
        sums, seen = np.zeros((buckets, dim)), np.zeros(buckets, bool)
        for b in batches:
            for at, n in zip(b.column("at"), b.column("n"), strict=True):
                at = at.values.to_numpy()
                x = unit(n.values.to_numpy() * w[at])
                sums[at] += x[:, None] * (x @ q[at])
                seen[at] = True
        for lo in range(0, buckets, GROUP):
            own = lo + np.flatnonzero(seen[lo : lo + GROUP])
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array([lo // GROUP]), pa.array([own.astype(np.int32).tobytes()]), pa.array([sums[own].tobytes()])], names=["g", "at", "sums"])

    def added(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        sums = np.zeros((GROUP, dim))
        for at, own in sorted(zip(parts.column("at").to_pylist(), parts.column("sums").to_pylist(), strict=True)):
            sums[np.frombuffer(at, np.int32) % GROUP] += np.frombuffer(own).reshape(-1, dim)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([sums.tobytes()])], names=["g", "sums"])

    met = a.mapInArrow(part, "g long, at binary, sums binary").groupBy("g").applyInArrow(added, "g long, sums binary")
    out = np.zeros((-(-buckets // GROUP) * GROUP, dim))
    for r in met.collect():  # the basis's size
        out[r.g * GROUP : (r.g + 1) * GROUP] = np.frombuffer(r.sums).reshape(GROUP, dim)
    return out[:buckets]
