"""Group-safe stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a split by exact targets may have; larger tables take split_by_fraction.
MOST_GROUPS = 200_000


def choose_groups(groups: list[tuple[str, int]], target: int) -> set[str]:
    """Names of whole groups whose sizes add up to the target, or else to the largest total below it.

    Only how many groups of each size are taken matters for the total. So totals are bits of one integer, widened
    size by size by powers of two of that size's groups; the counts are read back from the last size to the first,
    as few of a size as will do, and of one size the groups given first are taken.
    """
    of_size: dict[int, list[str]] = {}
    for name, size in groups:
        if size > 0:
            of_size.setdefault(size, []).append(name)
    sizes, within = sorted(of_size), (1 << target + 1) - 1
    totals = [1]
    for size in sizes:
        bits, left, share = totals[-1], len(of_size[size]), 1
        while left:
            share = min(share, left)
            bits |= bits << size * share & within
            left, share = left - share, 2 * share
        totals.append(bits)
    total, chosen = totals[-1].bit_length() - 1, set()
    for size, before in zip(reversed(sizes), reversed(totals[:-1]), strict=True):
        many = next(n for n in range(len(of_size[size]) + 1) if n * size <= total and before >> total - n * size & 1)
        chosen.update(of_size[size][:many])
        total -= many * size
    return chosen


def stratified_split(df: DataFrame, group: str, label: str, targets: dict[int, tuple[int, int]], seed: int = 20260916) -> DataFrame:
    """Adds split: per label, train then validation reach their targets with whole groups; the rest is test.

    Only group sizes come to the driver, and their number is checked; the assignment goes back as a table. Groups are
    ordered by a seeded hash, so the result doesn't depend on partitioning. A group of two labels is an error.
    """
    sizes = df.groupBy(group).agg(F.min(label).alias("y"), F.countDistinct(label).alias("k"), F.count("*").alias("n")).orderBy(F.xxhash64(F.col(group).cast("string"), F.lit(seed)), group).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups; use split_by_fraction")
    if any(r["k"] > 1 for r in sizes):
        raise ValueError("a group has more than one label")
    rows = []
    for y, (train, validation) in targets.items():
        mine = [(r[group], r["n"]) for r in sizes if r["y"] == y]
        first = choose_groups(mine, train)
        second = choose_groups([g for g in mine if g[0] not in first], validation)
        rows += [(g, "train" if g in first else "validation" if g in second else "test") for g, _ in mine]
    names = df.sparkSession.createDataFrame(rows, f"`{group}` {df.schema[group].dataType.simpleString()}, split string")
    return df.join(names, group, "left")


def split_by_fraction(df: DataFrame, group: str, train: float = 0.7, validation: float = 0.15, seed: str = "20260916") -> DataFrame:
    """Adds split by a hash of the group alone: no shuffle, any size, groups whole."""
    place = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(place < train, "train").when(place < train + validation, "validation").otherwise("test"))


def split_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"), F.count("*").alias("total"))


def split_violations(df: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")
