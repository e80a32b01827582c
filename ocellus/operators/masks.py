"""Segmentation masks and heads: accuracy counts, label coding, line discs, weighted head fits, retry cascades."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def mask_scores(df: DataFrame, key: str, output: str = "output", label: str = "label") -> DataFrame:
    """Pixel accuracy, overlap of class 1 with all foreground, and precision of class 1, per key."""
    o, y = F.col(output), F.col(label)
    both, either, right = F.count_if((y == 1) & (o == 1)), F.count_if(o + y > 0), F.count_if(o == y)
    return df.groupBy(key).agg(ratio(right, F.count("*")).alias("accuracy"), ratio(both, either).alias("iou"), ratio(both, F.count_if(o > 0)).alias("precision"))


def coded_label(guidance: Column, rough: Column) -> Column:
    """Byte label of guidance (under 64: 0, under 144: -1, else 1) times 255 plus the rough mask (255 above 128)."""
    g = F.when(guidance < 64, 0).when(guidance < 144, -1).otherwise(1)
    return F.pmod(g * 255 + F.when(rough > 128, 255).otherwise(0), F.lit(256))


def line_discs(line: DataFrame, key: str, radius: float) -> DataFrame:
    """Largest and smallest mean value of discs along a line: pixels (key, x, y, v) of the line against each other on
    cells of the disc's radius, so a pixel meets its nine neighbouring cells only."""
    cell = lambda c: F.floor(F.col(c) / radius)
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = line.withColumn("sx", F.explode(step)).withColumn("sy", F.explode(step)).select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), (cell("x") + F.col("sx")).alias("gx"), (cell("y") + F.col("sy")).alias("gy"))
    b = line.select(key, "x", "y", "v", cell("x").alias("gx"), cell("y").alias("gy"))
    discs = a.join(b, [key, "gx", "gy"]).filter(F.pow(F.col("ax") - F.col("x"), 2) + F.pow(F.col("ay") - F.col("y"), 2) <= radius**2).groupBy(key, "ax", "ay").agg(F.avg("v").alias("m"))
    return discs.groupBy(key).agg(F.max("m").alias("max_steep"), F.min("m").alias("min_steep"))


def refit_head(df: DataFrame, features: Sequence[str], label: str, weight: str, strength: float):
    """Weighted logistic head on standardised features with the scaler folded in: (coefficients, intercept).

    `strength` is the inverse regularisation; Spark's penalty is per mean loss, hence 1 / (strength * total weight)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    total = df.agg(F.sum(weight)).first()[0]
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw"), StandardScaler(withMean=True, inputCol="_raw", outputCol="_std"), LogisticRegression(featuresCol="_std", labelCol=label, weightCol=weight, regParam=1 / (strength * total), standardization=False)]
    fitted = Pipeline(stages=stages).fit(df)
    scaler, head = fitted.stages[1], fitted.stages[2]
    scale = [c / s if s else 0.0 for c, s in zip(head.coefficients, scaler.std, strict=True)]
    return scale, float(head.intercept - sum(c * m for c, m in zip(scale, scaler.mean, strict=True)))


def cascade(items: DataFrame, key: str, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Items through the first stage that succeeds for them; a stage returns (key, status, ...) and 'ok' is success.
    What fails everywhere keeps the last stage's row."""
    left, done = items, None
    for i, stage in enumerate(stages):
        tried = stage(left).withColumn("stage", F.lit(i))
        good = tried if i == len(stages) - 1 else tried.filter("status = 'ok'")
        done = good if done is None else done.unionByName(good, allowMissingColumns=True)
        left = left.join(tried.filter("status = 'ok'").select(key), key, "left_anti")
    return done


def working_gap(radii: DataFrame, key: str, ring: int, slope: float, intercept: float) -> DataFrame:
    """Gap from the ring's weighted diameter, (2 max + min) / 3 * 2, by the calibration slope / diameter + intercept."""
    d = (2 * F.max("radius") + F.min("radius")) / 3 * 2
    return radii.filter(F.col("mire_num") == ring).groupBy(key).agg(d.alias("diameter")).withColumn("gap", slope / F.col("diameter") + intercept)


def guidance_weight(guide: Column, scale: float) -> Column:
    """`scale` where there is guidance, else 1."""
    return F.when(guide != 0, float(scale)).otherwise(1.0)
