"""Training by epochs: softmax regression on vectors by gradients that are summed over all partitions, a checkpoint an epoch.

A step is one pass over its rows: each task adds up its rows' gradients and gives a row a cell, Spark sums the cells, and the
driver holds the model and its two running means, no more. The sums are whole numbers (2^-46 the unit, weights add up to one), so
they don't depend on the order of tasks, and as the rows are written once, at the start, a run that is taken up gives the model of one that was
never cut. Each epoch is
written with its loss and its macro-F1 and accuracy on the rows held out; the best one is the model (ties: the earlier).

Rows with a null label, one outside the classes, or a vector that is null, of another length or not finite take no part."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.landing import complete
from . import metrics

UNIT = 2.0**46
STEP = "epoch int, loss double, macro_f1 double, accuracy double, weights binary, first binary, second binary"


@dataclass(frozen=True)
class Plan:
    """What is trained. batches: steps an epoch, each over a hashed part of the rows; warmup: the share of all steps in which the
    rate rises to `rate`, from there it falls to zero; patience: epochs without a better one after which training ends."""

    classes: int
    dim: int
    epochs: int = 10
    batches: int = 1
    rate: float = 0.1
    decay: float = 0.0
    warmup: float = 0.1
    balanced: bool = True
    patience: int | None = None

    def rate_at(self, step: int) -> float:
        """Of step 0, 1, ..."""
        steps, rise = self.epochs * self.batches, int(self.warmup * self.epochs * self.batches)
        return self.rate * ((step + 1) / rise if step < rise else (steps - step) / max(1, steps - rise))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the weighted cross-entropy by the classes' coefficients, the intercept last; and the loss."""
    x = np.c_[x, np.ones(len(x))]
    p = softmax(x @ w.T)
    loss = -float(weight @ np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)))
    p[np.arange(len(y)), y] -= 1
    return (p * weight[:, None]).T @ x, loss


def adam(w: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next weights and running means of the gradient and its square; the intercept doesn't decay."""
    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
    move = first / (1 - 0.9 ** (step + 1)) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + 1e-8)
    shrink = np.r_[np.full(w.shape[1] - 1, decay), 0.0]
    return w - rate * (move + shrink * w), first, second


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def summed(rows: DataFrame, w: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Gradient and loss over the rows (x, y, weight), divided by `total`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(w.size + 1)
        for b in batches:
            g, loss = gradient(w, matrix(b.column("x"), w.shape[1] - 1), b.column("y").to_numpy(), b.column("weight").to_numpy() / total)
            sums += np.r_[g.ravel(), loss]
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.rint(sums[own] * UNIT).astype(np.int64))], names=["cell", "part"])

    cells = rows.mapInArrow(run, "cell long, part long").groupBy("cell").agg(F.sum("part").alias("part")).collect()  # as many as the model has numbers
    out = np.zeros(w.size + 1)
    for r in cells:
        out[r.cell] = r.part / UNIT
    return out[:-1].reshape(w.shape), float(out[-1])


class Model:
    def __init__(self, weights: np.ndarray, epoch: int):
        self.weights, self.epoch = weights, epoch

    def predict(self, rows: DataFrame, vec: str = "embedding") -> DataFrame:
        """The rows with prediction (ties: the smaller class) and probability; both null without a vector."""
        w = self.weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column(vec).is_valid().to_numpy(zero_copy_only=False)
                p = softmax(np.c_[matrix(b.column(vec).filter(pa.array(own)), w.shape[1] - 1), np.ones(own.sum())] @ w.T)
                said, each = np.full(len(own), -1), np.full((len(own), w.shape[0]), np.nan)
                said[own], each[own] = p.argmax(axis=1), p
                cols = [pa.array(said, pa.int32(), mask=~own), pa.array([list(r) if ok else None for r, ok in zip(each, own, strict=True)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "prediction", "probability"])

        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(run, f"{kinds}, prediction int, probability array<double>")


def _state(spark: SparkSession, path: str, epoch: int):
    return spark.read.schema(STEP).parquet(f"{path}/epoch={epoch}").first()


def _weights(plan: Plan, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(plan.classes, plan.dim + 1).copy()


def done(spark: SparkSession, path: str) -> int:
    """Epochs that were written to their end."""
    n = 0
    while complete(spark, f"{path}/epoch={n}"):
        n += 1
    return n


def history(spark: SparkSession, path: str, model: str = "softmax") -> DataFrame:
    """model, epoch, loss, macro_f1, accuracy of the epochs done, and which is the best."""
    n = done(spark, path)
    out = spark.createDataFrame([], STEP) if n == 0 else spark.read.schema(STEP).parquet(*(f"{path}/epoch={i}" for i in range(n)))
    first = Window.partitionBy("model").orderBy(F.col("macro_f1").desc(), "epoch")  # a row an epoch
    return out.select(F.lit(model).alias("model"), "epoch", "loss", "macro_f1", "accuracy").withColumn("best", F.row_number().over(first) == 1)


def best(spark: SparkSession, path: str) -> Model:
    plan = Plan(**json.loads(spark.read.text(f"{path}/plan").first()[0]))
    top = metrics.best_epoch(history(spark, path).select("model", "epoch", "macro_f1")).first()
    return Model(_weights(plan, _state(spark, path, top.epoch).weights), top.epoch)


def train(rows: DataFrame, held_out: DataFrame, path: str, plan: Plan, vec: str = "embedding", label: str = "label", until: int | None = None) -> DataFrame:
    """Trains, or takes up what stands at `path` under the same plan, to the plan's end or before epoch `until`; gives the history."""
    spark = rows.sparkSession
    told = json.dumps(asdict(plan), sort_keys=True)
    if complete(spark, f"{path}/plan"):
        if spark.read.text(f"{path}/plan").first()[0] != told:
            raise ValueError("another plan stands at this path")
    else:
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/plan")
    y = F.col(label).cast("int")
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = lambda df: df.select(F.col(vec).cast("array<double>").alias("x"), y.alias("y")).where(F.col("y").between(0, plan.classes - 1) & (F.size("x") == plan.dim) & ~odd)
    x = fit(rows)
    if plan.balanced:
        each = metrics.balanced_weights(x, "y").select(F.col("label").alias("y"), "weight")
        x = x.join(F.broadcast(each), "y").select("x", "y", "weight")  # a row a class
    else:
        x = x.withColumn("weight", F.lit(1.0))
    if not complete(spark, f"{path}/rows"):  # written once: tasks of every step and run read the same rows in the same order
        x.withColumn("batch", F.pmod(F.xxhash64("x", "y"), F.lit(plan.batches))).write.mode("overwrite").parquet(f"{path}/rows")
    x, test = spark.read.parquet(f"{path}/rows"), fit(held_out)
    total = {r.batch: r.w for r in x.groupBy("batch").agg(F.sum("weight").alias("w")).collect()}  # a row a batch
    n = done(spark, path)
    if n:
        last = _state(spark, path, n - 1)
        w, first, second = (_weights(plan, last[c]) for c in ("weights", "first", "second"))
    else:
        w, first, second = (np.zeros((plan.classes, plan.dim + 1)) for _ in range(3))
    f1 = [r.macro_f1 for r in history(spark, path).orderBy("epoch").collect()]  # a row an epoch
    stop = lambda: plan.patience is not None and len(f1) - 1 - int(np.argmax(f1 or [0])) >= plan.patience and len(f1) > 0
    for epoch in range(n, min(plan.epochs, plan.epochs if until is None else until)):
        if stop():
            break
        loss = 0.0
        for batch in range(plan.batches):
            if batch not in total:
                continue
            step = epoch * plan.batches + batch
            g, part = summed(x.where(F.col("batch") == batch).select("x", "y", "weight"), w, total[batch])
            w, first, second = adam(w, g, first, second, step, plan.rate_at(step), plan.decay)
            loss += part / len(total)
        seen = Model(w, epoch).predict(test, "x").select("y", F.col("prediction").alias("p"))
        scores = metrics.macro_f1(seen).first()[0], metrics.accuracy(seen).first()[0]
        row = (epoch, loss, *scores, *(a.tobytes() for a in (w, first, second)))
        spark.createDataFrame([row], STEP).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        f1.append(scores[0])
    return history(spark, path)
