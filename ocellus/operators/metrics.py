"""Classification metrics, threshold search and ROC.

Everything that needs scores in order works on distinct scores with their class counts. Running totals over them
are made in two levels: within score bands, and over the at most BANDS band totals, which is a bounded table. So no window holds all rows.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, wilson
from .audit import raise_unless

BANDS = 1024


def confusion(df: DataFrame, label: str, score: str, threshold: float, *keys: str) -> DataFrame:
    """Counts and rates at a threshold (inclusive); a rate with nothing to count is 0."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    count = lambda c: F.count_if(c).cast("long")
    counted = df.groupBy(*keys).agg(count(y & p).alias("tp"), count(~y & ~p).alias("tn"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"))
    return rates(counted)


def rates(counted: DataFrame) -> DataFrame:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return counted.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)}).withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def full_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    base = confusion(df, label, score, threshold)
    out = base.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": ratio(tp, tp + fp)})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")))
    for name, hit, n in (("sensitivity", tp, tp + fn), ("specificity", tn, tn + fp), ("accuracy", tp + tn, tp + tn + fp + fn)):
        low, high = wilson(hit, n)
        out = out.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out


def by_score(df: DataFrame, score: str, flags: dict[str, Column]) -> DataFrame:
    """Distinct scores; of each flag its count there (name) and at and above (name_ge); the next lower distinct score.
    Rows without a score don't count. Bands are cut at approximate quantiles of the distinct scores, so that they are
    about equally full however the scores are spread."""
    at = df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(*(F.count_if(c).cast("long").alias(n) for n, c in flags.items()))
    cuts = at.agg(F.percentile_approx("score", [k / BANDS for k in range(1, BANDS)], 4 * BANDS).alias("q")).first()["q"] or []
    edges = [-math.inf, *sorted(set(cuts)), math.inf]
    at = Bucketizer(splits=edges if len(edges) > 2 else [-math.inf, 0.0, math.inf], inputCol="score", outputCol="band").transform(at).withColumn("band", F.col("band").cast("int"))
    above = Window.orderBy(F.desc("band"))
    bands = at.groupBy("band").agg(*(F.sum(n).alias(n) for n in flags), F.max("score").alias("top"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("band", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in flags), F.lead("top").over(above).alias("below"))
    inner = Window.partitionBy("band").orderBy(F.desc("score"))
    both = at.join(F.broadcast(bands), "band")  # BANDS rows at most
    return both.select("score", *flags, *((F.col(f"_{n}") + F.sum(n).over(inner)).cast("long").alias(f"{n}_ge") for n in flags), F.coalesce(F.lead("score").over(inner), F.col("below")).alias("lower"))


def _candidates(df: DataFrame, score: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of the flags at and above each candidate threshold (0, 0.5, 1, midpoints of neighbours), and their totals."""
    middle = by_score(df, score, flags).filter("lower IS NOT NULL").select(((F.col("score") + F.col("lower")) / 2).alias("threshold"), *(F.col(f"{n}_ge").alias(n) for n in flags))
    base = df.select(F.col(score).cast("double").alias("_s"), *(c.alias(n) for n, c in flags.items()))
    sums = [F.struct(F.lit(t).alias("threshold"), *(F.count_if(F.col(n) & (F.col("_s") >= t)).cast("long").alias(n) for n in flags)) for t in (0.0, 0.5, 1.0)]
    fixed = base.agg(F.array(*sums).alias("a")).select(F.inline("a"))
    totals = base.agg(*(F.count_if(F.col(n)).cast("long").alias(f"all_{n}") for n in flags))
    return middle.unionByName(fixed).groupBy("threshold").agg(*(F.max(n).alias(n) for n in flags)).crossJoin(F.broadcast(totals))  # one row


def threshold_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Counts and rates for each candidate threshold."""
    c = _candidates(df, score, {"pos": F.col(label) == 1, "neg": F.col(label) == 0})
    return rates(c.select("threshold", F.col("pos").alias("tp"), (F.col("all_neg") - F.col("neg")).alias("tn"), F.col("neg").alias("fp"), (F.col("all_pos") - F.col("pos")).alias("fn")))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Most balanced accuracy, then sensitivity, specificity, nearness to 0.5; of equals the smallest."""
    key = F.struct(F.round("balanced_accuracy", 12), F.round("sensitivity", 12), F.round("specificity", 12), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return curve.groupBy().agg(F.max_by(F.struct(*curve.columns), key).alias("r")).select("r.*")


def two_domain_threshold(df: DataFrame, label: str, score: str, domain: str, first: str, second: str, floor: float = 0.9) -> DataFrame:
    """One threshold for two domains, of the pooled candidates: first of all the floor of sensitivity in both, then the
    most least specificity, least balanced accuracy and sum of sensitivities; of equals the smallest."""
    flags = {f"{k}{i}": (F.col(domain) == d) & (F.col(label) == y) for i, d in enumerate((first, second)) for k, y in (("pos", 1), ("neg", 0))}
    c = _candidates(df, score, flags)
    for i in (0, 1):
        c = c.withColumn(f"sens{i}", ratio(F.col(f"pos{i}"), F.col(f"all_pos{i}"))).withColumn(f"spec{i}", ratio(F.col(f"all_neg{i}") - F.col(f"neg{i}"), F.col(f"all_neg{i}")))
    out = c.select(
        "threshold", F.least("sens0", "sens1").alias("least_sensitivity"), F.least("spec0", "spec1").alias("least_specificity"),
        (F.least(F.col("sens0") + F.col("spec0"), F.col("sens1") + F.col("spec1")) / 2).alias("least_balanced"), (F.col("sens0") + F.col("sens1")).alias("sum_sensitivity"),
    )
    key = F.struct(F.col("least_sensitivity") >= floor, *(F.round(x, 12) for x in ("least_specificity", "least_balanced", "sum_sensitivity")), -F.col("threshold"))
    return out.groupBy().agg(F.max_by(F.struct(*out.columns), key).alias("r")).select("r.*")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties counted half, and the class sizes; null without both classes."""
    ranked = by_score(df, score, {"pos": F.col(label) == 1, "neg": F.col(label) == 0})
    wins = F.sum(F.col("neg").cast("double") * (F.col("pos_ge") - F.col("pos")) + 0.5 * F.col("pos") * F.col("neg"))
    return ranked.agg((wins / F.sum("pos") / F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    ranked = by_score(df, score, {"pos": F.col(label) == 1, "neg": F.col(label) == 0})
    totals = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return ranked.crossJoin(F.broadcast(totals)).select("score", ratio(F.col("pos_ge"), F.col("p")).alias("tpr"), ratio(F.col("neg_ge"), F.col("n")).alias("fpr"))  # totals: one row


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counted.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    return counted.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # totals: one row


def log_loss(label: Column, score: Column, eps: float = 1e-7) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return F.avg(-(label * F.log(p) + (1 - label) * F.log(1 - p)))


def parity(df: DataFrame, left: str, right: str, threshold: float) -> DataFrame:
    gap = F.abs(F.col(left) - F.col(right))
    agree = ((F.col(left) >= threshold) == (F.col(right) >= threshold)).cast("double")
    return df.agg(F.count("*").alias("n"), F.max(gap).alias("max_difference"), F.avg(gap).alias("mean_difference"), F.avg(agree).alias("agreement"))


def best_stage(stages: DataFrame, stage: str = "stage", auc: str = "auc", loss: str = "log_loss") -> DataFrame:
    """The stage with the largest AUC, of equals the one with the smallest loss, of those the first by name."""
    order = F.struct(F.col(auc), -F.col(loss))
    best = stages.groupBy().agg(F.max(order).alias("m"))
    return stages.join(F.broadcast(best), order == F.col("m")).groupBy().agg(F.min(F.struct(stage, auc, loss)).alias("r")).select("r.*")  # one row


def smallest_accepted(candidates: DataFrame, name: str, size: str, accepted: str = "accepted") -> DataFrame:
    """The smallest candidate that passed; an error if none did."""
    best = candidates.filter(F.col(accepted)).groupBy().agg(F.min(F.struct(F.col(size).alias("_size"), F.col(name).alias("_name"))).alias("r"))
    return raise_unless(best, F.col("r").isNotNull(), "no candidate passed").select(F.col("r._name").alias(name), F.col("r._size").alias(size))
