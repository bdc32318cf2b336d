"""Evaluation reports over predictions (true_cls, pred_cls, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def correct() -> Column:
    return F.col("true_cls") == F.col("pred_cls")


def accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Rows, hits and accuracy of each group, and of all rows with null names."""
    out = predictions.rollup(*by).agg(F.count("*").alias("n"), F.count_if(correct()).alias("hits"))
    return out.withColumn("accuracy", F.col("hits") / F.col("n"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("true_cls", "pred_cls").agg(F.count("*").alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where a quotient has no base."""
    cells = confusion(predictions)
    true = cells.groupBy(F.col("true_cls").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(correct(), F.col("n")).otherwise(0)).alias("tp"))
    pred = cells.groupBy(F.col("pred_cls").alias("cls")).agg(F.sum("n").alias("predicted"))
    rows = true.join(pred, "cls", "full").fillna(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return rows.withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def weighted_f1(report: DataFrame) -> DataFrame:
    return report.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def normalized_confusion(predictions: DataFrame) -> DataFrame:
    """Each cell's share of its row; a row counts as 1 at least."""
    cells = confusion(predictions)
    total = F.sum("n").over(Window.partitionBy("true_cls"))
    return cells.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)))


def top_confused(predictions: DataFrame, k: int) -> DataFrame:
    """The k most frequent confusions, then by falling class names: a top-k report."""
    wrong = confusion(predictions).where(~correct())
    return wrong.orderBy(F.desc("n"), F.desc("true_cls"), F.desc("pred_cls")).limit(k)


def top_wrong(predictions: DataFrame, k: int) -> DataFrame:
    """The k most frequent wrong classes of each class: a top-k report."""
    w = Window.partitionBy("true_cls").orderBy(F.desc("n"), "pred_cls")
    return confusion(predictions).where(~correct()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_confusion(predictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """For class pairs (a, b): confusions each way, accuracies and a status of three levels."""
    cells = confusion(predictions)
    support = cells.groupBy("true_cls").agg(F.sum("n").alias("n"), F.sum(F.when(correct(), F.col("n")).otherwise(0)).alias("hit"))
    joined = pairs.join(cells, ((F.col("true_cls") == F.col("a")) & (F.col("pred_cls") == F.col("b"))) | ((F.col("true_cls") == F.col("b")) & (F.col("pred_cls") == F.col("a"))), "left")
    ways = joined.groupBy("a", "b").agg(F.coalesce(F.sum(F.when(F.col("true_cls") == F.col("a"), F.col("n"))), F.lit(0)).alias("a_to_b"), F.coalesce(F.sum(F.when(F.col("true_cls") == F.col("b"), F.col("n"))), F.lit(0)).alias("b_to_a"))
    acc = support.select(F.col("true_cls").alias("c"), (F.col("hit") / F.col("n")).alias("acc"))
    out = ways.join(acc.select(F.col("c").alias("a"), F.col("acc").alias("acc_a")), "a", "left").join(acc.select(F.col("c").alias("b"), F.col("acc").alias("acc_b")), "b", "left")
    least = F.least(F.coalesce("acc_a", F.lit(0.0)), F.coalesce("acc_b", F.lit(0.0)))
    return out.withColumn("status", F.when(least >= 0.8, "ok").when(least >= 0.5, "warn").otherwise("bad"))


def data_type(samples: DataFrame, real: list[str], augmented: list[str]) -> DataFrame:
    """Kind of data of each class: real before accent_aug before synthetic."""
    any_of = lambda names: F.bool_or(F.col("source").isin(*names))
    return samples.groupBy("cls").agg(F.when(any_of(real), "real").when(any_of(augmented), "accent_aug").otherwise("synthetic").alias("dtype"), F.count("*").alias("n"))


def majority_vote(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent prediction of each group (the smallest of equals), its votes and hit rate."""
    votes = predictions.groupBy(*by, "true_cls", "pred_cls").agg(F.count("*").alias("n"))
    best = votes.groupBy(*by, "true_cls").agg(F.max_by("pred_cls", F.struct("n", -F.col("pred_cls"))).alias("vote"), F.max("n").alias("votes"), F.sum("n").alias("trials"), F.sum(F.when(correct(), F.col("n")).otherwise(0)).alias("hits"))
    return best.withColumn("hit_rate", F.col("hits") / F.col("trials"))


def count_errors(pages: DataFrame) -> DataFrame:
    """Over pages with n_gt and n_pred: mean absolute count error, exact share, TP, FN, FP."""
    tp = F.least("n_gt", "n_pred")
    return pages.agg(
        F.count("*").alias("pages"),
        F.avg(F.abs(F.col("n_gt") - F.col("n_pred"))).alias("mae"),
        (F.avg((F.col("n_gt") == F.col("n_pred")).cast("double")) * 100).alias("exact_pct"),
        F.avg("n_pred").alias("mean_pred"),
        F.sum(tp).alias("tp"),
        F.sum(F.col("n_gt") - tp).alias("fn"),
        F.sum(F.col("n_pred") - tp).alias("fp"),
    )


def low_classes(report: DataFrame, under: float) -> DataFrame:
    """Sorted classes whose F1 is under a limit, as one list."""
    return report.agg(F.sort_array(F.collect_list(F.when(F.col("f1") < under, F.col("cls")))).alias("classes"))


def detail(predictions: DataFrame, base: DataFrame, k: int = 3) -> DataFrame:
    """Classes of interest (cls, base): accuracy, F1, support, the k most frequent wrong
    readings, and the share read as the base class."""
    wrong = top_wrong(predictions, k).groupBy("true_cls").agg(F.sort_array(F.collect_list(F.struct("rank", "pred_cls", "n"))).alias("wrong"))
    cells = confusion(predictions)
    as_base = base.join(cells, (F.col("true_cls") == F.col("cls")) & (F.col("pred_cls") == F.col("base")), "left").select("cls", "base", F.coalesce("n", F.lit(0)).alias("as_base"))
    rows = as_base.join(class_report(predictions), "cls", "left").join(wrong.withColumnRenamed("true_cls", "cls"), "cls", "left")
    return rows.select("cls", "base", F.col("recall").alias("accuracy"), "f1", "support", "wrong", (100.0 * F.col("as_base") / F.greatest("support", F.lit(1))).alias("base_pct"))


def size_bucket(n: Column) -> Column:
    """Composition by its number of characters."""
    return F.when(n == 1, "single").when(n <= 10, "few").when(n <= 32, "many").otherwise("dense")


def detection_rate(pages: DataFrame) -> DataFrame:
    return pages.agg((F.sum("n_pred") / F.greatest(F.sum("n_gt"), F.lit(1))).alias("rate"))
