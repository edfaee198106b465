"""Stratified splits and the linear probe: class-balanced multinomial regression on precomputed vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.landing import landed
from . import metrics


def quotas(rows: DataFrame, label: str = "label", test_size: float = 0.33) -> DataFrame:
    """label, n, n_test: ceil(test_size * all) rows, shared by class by largest remainder, ties to the smaller label."""
    return quotas_of(rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")), test_size)


def quotas_of(n: DataFrame, test_size: float) -> DataFrame:
    """label, n -> label, n, n_test."""
    every = Window.partitionBy(F.lit(0))  # as many rows as classes
    want = F.ceil(F.lit(test_size) * F.sum("n").over(every))
    exact = want * F.col("n") / F.sum("n").over(every)
    q = n.withColumn("want", want).withColumn("low", F.floor(exact)).withColumn("part", F.round(exact - F.floor(exact), 9))
    extra = F.row_number().over(every.orderBy(F.col("part").desc(), "label")) <= F.col("want") - F.sum("low").over(every)
    return q.select("label", "n", (F.col("low") + extra.cast("int")).cast("long").alias("n_test"))


def stratified_split(rows: DataFrame, id_col: str, label: str = "label", test_size: float = 0.33, seed: int = 42, bits: int = 12) -> DataFrame:
    """The rows with split = train or test; a class's test rows are the first of a hashed order. The quota holds exactly.

    The order is cut into 2^bits ranges a class, which are counted: ranges before the one on the quota's edge are test rows
    whole, and only the edge's rows are ranked, so no task gets a class."""
    turn = F.xxhash64(F.col(id_col), F.lit(seed))
    own = rows.withColumn("_turn", turn).withColumn("_range", F.shiftright("_turn", 64 - bits))
    counts = own.groupBy(F.col(label).alias("label"), "_range").agg(F.count("*").alias("n"))
    counts = landed(counts, "ranges")  # the one reading before the rows themselves are dealt
    before = F.sum("n").over(Window.partitionBy("label").orderBy("_range")) - F.col("n")  # at most 2^bits rows a class
    q = quotas_of(counts.groupBy("label").agg(F.sum("n").alias("n")), test_size).select(F.col("label").alias("_l"), "n_test")
    spread = counts.withColumn("_before", before).join(q, F.col("label").eqNullSafe(F.col("_l")))
    edge = spread.where((F.col("_before") <= F.col("n_test")) & (F.col("n_test") < F.col("_before") + F.col("n")))
    edge = edge.select("_l", F.col("_range").alias("_edge"), (F.col("n_test") - F.col("_before")).alias("_left"))
    whole = q.join(edge.withColumnRenamed("_l", "_e"), F.col("_l").eqNullSafe(F.col("_e")), "left").select(F.col("_l").alias("_k"), "_edge", "_left")
    out = own.join(F.broadcast(whole), F.col(label).eqNullSafe(F.col("_k")))  # a row a class
    # a null edge: the whole class is test rows
    sure = out.where(F.col("_edge").isNull() | (F.col("_range") != F.col("_edge"))).withColumn("_test", F.col("_edge").isNull() | (F.col("_range") < F.col("_edge")))
    near = out.where(F.col("_range") == F.col("_edge"))
    near = near.withColumn("_test", F.row_number().over(Window.partitionBy(label).orderBy("_turn", id_col)) <= F.col("_left"))
    both = sure.unionByName(near)
    return both.select(*rows.columns, F.when(F.col("_test"), "test").otherwise("train").alias("split"))


def fit(train: DataFrame, label: str = "label", vec: str = "embedding", c: float = 1.0, max_iter: int = 2000) -> LogisticRegressionModel:
    """Balanced class weights; the penalty is 1 / (c * sum of weights) in this estimator's terms."""
    w = metrics.balanced_weights(train, label).select(F.col("label").alias("_l"), "weight")
    rows = train.join(w, F.col(label) == F.col("_l")).select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"), "weight")
    n = rows.agg(F.sum("weight")).first()[0]
    return LogisticRegression(family="multinomial", maxIter=max_iter, tol=1e-6, elasticNetParam=0.0, standardization=False, weightCol="weight", regParam=1.0 / (c * n)).fit(rows)


def predict(model: LogisticRegressionModel, rows: DataFrame, vec: str = "embedding", names: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with prediction (int) and probability (array); with names, label_name and a map of probabilities too."""
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))))
    out = out.withColumn("probability", vector_to_array("probability")).withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction")
    if names:
        known = F.array(*map(F.lit, names))
        out = out.withColumn("label_name", F.element_at(known, F.col("prediction") + 1)).withColumn("probabilities", F.map_from_arrays(known, "probability"))
    return out


def save(model: LogisticRegressionModel, names: tuple[str, ...], path: str) -> None:
    """The model and its labels' names beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(list(enumerate(names)), "label int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load(spark: SparkSession, path: str) -> tuple[LogisticRegressionModel, tuple[str, ...]]:
    rows = spark.read.schema("label int, name string").json(f"{path}/labels").orderBy("label").collect()  # as many rows as classes
    return LogisticRegressionModel.load(f"{path}/model"), tuple(r["name"] for r in rows)


def task_seconds(spark: SparkSession, group: str) -> float:
    """What the tasks of a job group ran, as the scheduler's listener has it: other groups' work at the same time doesn't count."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, total = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}:
        if tracker.getStageInfo(stage) is not None:
            total += store.lastStageAttempt(stage).executorRunTime()
    return total / 1000


@contextmanager
def job_group(spark: SparkSession, name: str) -> Iterator[str]:
    """This thread's jobs inside are one group, named after `name`."""
    sc, group = spark.sparkContext, f"{name}-{uuid.uuid4().hex}"
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, name)
    try:
        yield group
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])


RESULT = "model string, macro_f1 double, accuracy double, per_class_f1 array<double>, embed_seconds double, fit_seconds double, report string, dim int, error string"


def linear_probe(model: str, encode: Callable[[DataFrame], DataFrame], train: DataFrame, test: DataFrame, names: tuple[str, ...], label: str = "label", c: float = 1.0) -> DataFrame:
    """One row of results; a failure is a row too. encode adds `embedding`. Seconds are those of the tasks."""
    spark, held = train.sparkSession, []
    try:
        x, y = encode(train).persist(), encode(test).persist()
        held = [x, y]
        with job_group(spark, f"encode {model}") as encoding:
            for part in held:  # Spark is lazy: an action that reads every embedding
                part.select("embedding").write.format("noop").mode("overwrite").save()
        dim = x.select(F.size("embedding")).first()[0]
        with job_group(spark, f"fit {model}") as fitting:
            lr = fit(x, label, c=c)
        embed, fitted = task_seconds(spark, encoding), task_seconds(spark, fitting)
        seen = predict(lr, y).select(F.col(label).alias("y"), F.col("prediction").alias("p"))
        each = metrics.per_class(metrics.class_counts(seen, labels=metrics.label_dimension(spark, names))).orderBy("label").collect()  # as many rows as classes
        row = (model, metrics.macro_f1(seen).first()[0], metrics.accuracy(seen).first()[0], [r["f1"] for r in each], embed, fitted, metrics.report_text(metrics.report(seen)), dim, None)
    except Exception as e:  # noqa: BLE001  an error is a row
        nan = float("nan")
        row = (model, nan, nan, [], nan, nan, "", 0, f"{type(e).__name__}: {e}")
    finally:
        for part in held:
            part.unpersist()
    return spark.createDataFrame([row], RESULT)


def probes(encoders: dict[str, Callable[[DataFrame], DataFrame]], train: DataFrame, test: DataFrame, names: tuple[str, ...], label: str = "label", at_once: int = 4) -> DataFrame:
    """A row of results an encoder, `at_once` of them at a time: one that waits for its last tasks leaves the cluster to others, one
    that fails is a row."""
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(lambda e: linear_probe(e[0], e[1], train, test, names, label), encoders.items()))
    return reduce(DataFrame.unionByName, rows)


def bake_off(encoders: dict[str, Callable[[DataFrame], DataFrame]], train: DataFrame, test: DataFrame, names: tuple[str, ...], label: str = "label", at_once: int = 4) -> DataFrame:
    """The leaderboard of several encoders."""
    return metrics.leaderboard(probes(encoders, train, test, names, label, at_once), names)


def hashed_encoder(dim: int = 256, text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A stand-in encoder that needs no model: hashed word counts, length one. It shows mechanics, not quality."""
    from ..functions.vectors import unit

    def encode(rows: DataFrame, col: str = text) -> DataFrame:
        words = F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        out = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_counts").transform(rows.withColumn("_words", words))
        return out.withColumn("embedding", unit(vector_to_array("_counts")).cast("array<float>")).drop("_words", "_counts")

    return encode


def tokenised(rows: DataFrame, tokenizer: str, most: int, text: str = "text") -> DataFrame:
    """The rows with input_ids, at most `most` of them, and `cut`, if there were more: batches of texts by a tokenizer file of
    the `tokenizers` library. Null texts have none. The file has to be at the same path on every executor."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", input_ids array<int>, cut boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer)
        for b in batches:
            ids = [x.ids for x in own.encode_batch([x or "" for x in b[text]], add_special_tokens=False)]
            yield b.assign(input_ids=[x[:most] for x in ids], cut=[len(x) > most for x in ids])

    return rows.mapInPandas(run, schema)
