"""Manifest audit: label rules, consistency, file matching, issue lists, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def label_rule(rows: DataFrame, keys: Sequence[str], item: str, positive: str, neutral: Sequence[str] = ("",)) -> DataFrame:
    """Per key: 1 if any trimmed item is `positive`, 0 if all are neutral or empty, else null."""
    kept = F.trim(F.coalesce(F.col(item), F.lit("")))
    return rows.groupBy(*keys).agg(
        F.when(F.bool_or(kept == positive), 1).when(F.bool_and(kept.isin("", *neutral)), 0).cast("int").alias("label"),
        F.count("*").alias("n_rows"),
    )


def numbering(rows: DataFrame, key: str, number: str, first: int = 0, declared: str | None = None) -> DataFrame:
    """Per key: rows, distinct numbers, and whether the numbers are first, first + 1, ... without gap or repeat."""
    n, least, most, distinct = F.count("*"), F.min(number), F.max(number), F.countDistinct(number)
    ok = (least == first) & (most == first + n - 1) & (distinct == n)
    if declared is not None:
        ok &= (F.min(declared) == n) & (F.max(declared) == n)
    return rows.groupBy(key).agg(n.alias("n_rows"), distinct.alias("n_distinct"), ok.alias("consistent"))


def match_status(names: DataFrame, files: DataFrame, name: str, file_name: str) -> DataFrame:
    """Left join by name, counted before the join: missing, single or ambiguous."""
    counts = files.groupBy(F.col(file_name).alias(name)).agg(F.count("*").alias("matches"))
    n = F.coalesce("matches", F.lit(0)).cast("long")
    return names.select(name).distinct().join(counts, name, "left").select(name, n.alias("matches"), F.when(n == 0, "missing").when(n == 1, "single").otherwise("ambiguous").alias("status"))


def unmatched(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return names.join(known.select(key).distinct(), key, "left_anti")


def valid_box(box: Column, width: Column, height: Column) -> Column:
    x, y, w, h = (box[k] for k in ("x", "y", "width", "height"))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)
    return F.coalesce(inside, F.lit(False))


def issue_list(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes, in order, of the rules that hold; null counts as not."""
    return F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), code) for code, hit in rules)))


def issue_counts(df: DataFrame, issues: str = "issues") -> DataFrame:
    return df.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def selected(df: DataFrame, label: str = "label", issues: str = "issues") -> DataFrame:
    return df.filter(F.col(label).isNotNull() & (F.size(issues) == 0))


def group_name(members: Column) -> Column:
    """group_ and 12 hex digits of the SHA-256 of the sorted members, one a line."""
    return F.concat(F.lit("group_"), F.substring(F.sha2(F.array_join(F.sort_array(members), "\n"), 256), 1, 12))


def duplicates(df: DataFrame, key: str, digest: Column, label: str) -> DataFrame:
    """Groups of two or more equal digests: size, members' common name, conflicting labels. Sizes are counted first, so only
    members of such groups are gathered for the name."""
    rows = df.select(F.col(key).alias("_key"), digest.alias("digest"), F.col(label).alias("_label"))
    several = rows.groupBy("digest").agg(F.count("*").alias("n"), (F.countDistinct("_label") > 1).alias("conflict"), F.min("_key").alias("first_id")).filter("n > 1")
    names = rows.join(several.select("digest"), "digest", "left_semi").groupBy("digest").agg(group_name(F.collect_list(F.col("_key").cast("string"))).alias("duplicate_group"))
    return several.join(names, "digest").select("digest", "n", "duplicate_group", "conflict", "first_id")


def first_seen(df: DataFrame, digest: Column, order: str, *keep: str) -> DataFrame:
    """Of equal digests the row that is first in order, without sorting whole groups."""
    row = F.struct(F.col(order), *(F.col(k) for k in keep if k != order))
    return df.groupBy(digest.alias("digest")).agg(F.min_by(row, F.col(order)).alias("row")).select("digest", "row.*")


def raise_unless(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """The rows, failing the query at the first for which the condition isn't true."""
    bad = F.raise_error(F.lit(message))
    return df.filter(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(bad.cast("boolean")))


def contained(path: Column) -> Column:
    """True for a relative path that stays within its root: no drive or leading separator, and no more steps up than down at
    any point."""
    steps = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda acc, x: F.struct((acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(acc["least"], acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return F.coalesce(~path.rlike(r"^([/\\]|[A-Za-z]:)") & (depth["least"] >= 0) & (F.size(steps) > 0), F.lit(False))


def locked_split(df: DataFrame, key: str, group: str, label: str, expected: dict[tuple[str, int], int]) -> DataFrame:
    """The rows of a split, after three checks that raise: keys are unique, each (split, label) has exactly the expected
    number of rows, and no group is in two splits. One aggregate each; only the counts come to the driver."""
    if not df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("the split repeats a name")
    found = {(r["split"], r[label]): r["n"] for r in df.groupBy("split", label).agg(F.count("*").alias("n")).limit(len(expected) + 1).collect()}
    if found != expected:
        raise ValueError(f"locked split counts changed: {found}")
    if not df.groupBy(group).agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a group crosses splits")
    return df


def by_prefix(names: DataFrame, labels: DataFrame, name: str, prefix: str, separator: str = "_") -> DataFrame:
    """Rows joined with the labels whose name equals what comes before the last separator of theirs: an equality join."""
    cut = F.regexp_replace(F.col(name), rf"\{separator}[^\{separator}]*$", "")
    return names.withColumn("_prefix", cut).join(labels.withColumnRenamed(prefix, "_prefix"), "_prefix").drop("_prefix")
