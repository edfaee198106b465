"""Evaluation as aggregates: accuracy, F1, reports, class weights, leaderboards. y is the truth, p the prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def _part(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def class_counts(rows: DataFrame, y: str = "y", p: str = "p", labels: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn: of the labels seen in truth or prediction, or of those declared (an absent one has zeros)."""
    c = confusion(rows, y, p)
    each = c.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(True).alias("true")), F.struct(F.col("p").alias("label"), F.lit(False).alias("true")))).alias("x"), "y", "p", "n").select("x.*", "y", "p", "n")
    hit = F.col("y") == F.col("p")
    got = each.groupBy("label").agg(
        F.sum(F.when(F.col("true") & hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("true") & ~hit, F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("true") & ~hit, F.col("n")).otherwise(0)).alias("fn"),
    )
    if labels is None:
        return got
    return labels.select("label").join(got, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def per_class(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", _part(tp, tp + fp).alias("precision"), _part(tp, tp + fn).alias("recall"), _part(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).cast("long").alias("support"))


def macro_f1(rows: DataFrame, y: str = "y", p: str = "p", labels: DataFrame | None = None) -> DataFrame:
    """labels None: averaged over the labels observed; else over those declared."""
    return per_class(class_counts(rows, y, p, labels)).agg(F.avg("f1").alias("macro_f1"))


def report(rows: DataFrame, y: str = "y", p: str = "p", labels: DataFrame | None = None) -> DataFrame:
    """name, precision, recall, f1, support: the classes, then accuracy, macro avg and weighted avg."""
    each = per_class(class_counts(rows, y, p, labels))
    four = ("precision", "recall", "f1")
    weighted = lambda c: _part(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    total = F.sum("support").alias("support")
    mean = each.agg(*(F.avg(c).alias(c) for c in four), total).select(F.lit("macro avg").alias("name"), *four, "support")
    weigh = each.agg(*(weighted(c).alias(c) for c in four), total).select(F.lit("weighted avg").alias("name"), *four, "support")
    none = F.lit(None).cast("double")
    acc = rows.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("f1"), F.count("*").alias("support")).select(F.lit("accuracy").alias("name"), none.alias("precision"), none.alias("recall"), "f1", "support")
    return each.select(F.col("label").cast("string").alias("name"), *four, "support").unionByName(acc).unionByName(mean).unionByName(weigh)


def report_text(table: DataFrame, digits: int = 2) -> str:
    """The report as lines of text; a report has as many rows as classes and three more."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}"
    lines = [f"{'':>14}{'precision':>11}{'recall':>11}{'f1-score':>11}{'support':>11}"]
    return "\n".join(lines + [f"{r['name']:>14}{show(r['precision']):>11}{show(r['recall']):>11}{show(r['f1']):>11}{r['support']:>11}" for r in table.toLocalIterator()])


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight = rows / (classes * n)."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # as many rows as classes
    return n.select("label", "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))


def leaderboard(results: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """model, macro_f1, accuracy, dim, error, per_class_f1 -> rounded, errors' numbers null, best first, nulls last."""
    ok = F.col("error").isNull()
    four = lambda c: F.when(ok & ~F.isnan(c), F.bround(c, 4))
    each = [four(F.try_element_at("per_class_f1", F.lit(i + 1))).alias(f"f1_{name}") for i, name in enumerate(labels)]
    out = results.select("model", four(F.col("macro_f1")).alias("macro_f1"), four(F.col("accuracy")).alias("accuracy"), F.nullif("dim", F.lit(0)).alias("dim"), F.left("error", F.lit(80)).alias("error"), *each)
    return out.orderBy(F.col("macro_f1").desc_nulls_last(), "model")


def probe_rows(results: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """The leaderboard with the seconds: embed_s to 1 place, fit_s to 3; an error's numbers are null."""
    ok = F.col("error").isNull()
    seconds = results.select("model", F.when(ok, F.bround("embed_seconds", 1)).alias("embed_s"), F.when(ok, F.bround("fit_seconds", 3)).alias("fit_s"))
    return leaderboard(results, labels).join(seconds, "model").orderBy(F.col("macro_f1").desc_nulls_last(), "model")


def winner(board: DataFrame) -> DataFrame:
    return board.orderBy(F.col("macro_f1").desc_nulls_last(), "model").limit(1)


def of_winner(board: DataFrame, table: DataFrame) -> DataFrame:
    """The winner's rows of a table by model: its report, or its settings."""
    return winner(board).select("model").join(table, "model")


def best_epoch(epochs: DataFrame, score: str = "macro_f1") -> DataFrame:
    """Of each model's epochs the one of the highest score, the earliest of equals; unscored ones don't count."""
    best = F.max_by(F.struct("epoch", score), F.struct(score, -F.col("epoch")))
    return epochs.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy("model").agg(best.alias("x")).select("model", "x.*")


def chart_rows(board: DataFrame) -> DataFrame:
    return board.dropna(subset=["macro_f1"])


def label_dimension(spark: SparkSession, names: tuple[str, ...] = ("no", "yes", "unclear")) -> DataFrame:
    return spark.createDataFrame(list(enumerate(names)), "label int, name string")


def label_ids(col: Column, names: tuple[str, ...] = ("no", "yes", "unclear"), default: int = 2) -> Column:
    table = F.create_map(*(F.lit(x) for pair in zip(names, range(len(names)), strict=True) for x in pair))
    return F.coalesce(F.try_element_at(table, col), F.lit(default))
