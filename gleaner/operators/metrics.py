"""Quality of binary predictions (label, probability): all aggregates, no row reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = tuple(k / 10 for k in range(2, 10))


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def threshold_metrics(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, tn, support, predicted, precision, recall, f1, accuracy) in one pass."""
    sums = []
    for t in thresholds:
        hit, pos = F.col("probability") >= t, F.col("label") == "positive"
        sums.append(F.struct(F.lit(t).alias("threshold"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn")))
    m = rows.agg(F.array(*sums).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"support": tp + fn, "predicted": tp + fp, "precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "accuracy": _share(tp + tn, tp + fp + fn + tn)})
    return m.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_label(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(label, precision, recall, f1, support) of both labels."""
    m = threshold_metrics(rows, (threshold,))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))

    def side(name: str, t: Column, f: Column, n: Column) -> Column:
        p, r = _share(t, t + f), _share(t, t + n)
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), _share(2 * p * r, p + r).alias("f1"), (t + n).alias("support"))

    return m.select(F.explode(F.array(side("positive", tp, fp, fn), side("negative", tn, fn, fp))).alias("s")).select("s.*")


def _ranked(rows: DataFrame) -> DataFrame:
    """Distinct probabilities with their positives and negatives and the positives and rows at or above.

    Cumulative sums run per slice of the probability's range, offset by the sums of
    the slices above, so that no window holds more than a slice.
    """
    pos = (F.col("label") == "positive").cast("long")
    at = rows.groupBy("probability").agg(F.sum(pos).alias("pos"), F.count("*").alias("n")).withColumn("slice", F.least(F.greatest(F.floor(F.col("probability") * 1024), F.lit(0)), F.lit(1024)))
    tops = at.groupBy("slice").agg(F.sum("pos").alias("sp"), F.sum("n").alias("sn"))
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("above_pos"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("above_n"))
    w = Window.partitionBy("slice").orderBy(F.desc("probability"))
    return at.join(F.broadcast(tops), "slice").select("probability", "pos", "n", (F.col("above_pos") + F.sum("pos").over(w)).alias("cum_pos"), (F.col("above_n") + F.sum("n").over(w)).alias("cum_n"))


def ranking_metrics(rows: DataFrame) -> DataFrame:
    """(roc_auc, average_precision), ties as one step; NULL and 0 where a class is missing."""
    r = _ranked(rows)
    neg = F.col("n") - F.col("pos")
    pairs = neg * (F.col("cum_pos") - F.col("pos")) + neg * F.col("pos") / 2
    one = r.agg(F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.sum(pairs).alias("pairs"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("ap"))
    return one.select((F.col("pairs") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("roc_auc"), _share(F.col("ap"), F.col("p")).alias("average_precision"))


def select_threshold(metrics: DataFrame, min_precision: float = 0.8, min_recall: float = 0.5, floor: float = 0.6) -> DataFrame:
    """The one row to use: precise ones first by F1; else at least ``floor`` with recall, at least ``floor``, any."""
    c = F.col
    tier = F.when(c("precision") >= min_precision, 0).when((c("threshold") >= floor) & (c("recall") >= min_recall), 1).when(c("threshold") >= floor, 2).otherwise(3)
    first = F.when(tier == 0, F.struct(c("f1").alias("a"), c("recall").alias("b"), c("threshold").alias("c"), c("threshold").alias("d"))).otherwise(
        F.struct(c("precision").alias("a"), c("f1").alias("b"), c("recall").alias("c"), c("threshold").alias("d"))
    )
    return metrics.orderBy(tier, first.desc()).limit(1)


def label_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def host_label_counts(rows: DataFrame) -> DataFrame:
    """(label, hosts): distinct hosts with a label."""
    return rows.groupBy("label").agg(F.count_distinct("host").alias("hosts"))
