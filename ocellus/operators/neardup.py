"""Near duplicates of 64-bit perceptual hashes: pairs, status, groups, nearest reference."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import number_distance
from .audit import group_name, raise_unless


def sign_hash(values: Column) -> Column:
    """Bit i is set if value i + 1 exceeds value i (a difference hash of a row of values)."""
    bits = F.transform(F.sequence(F.lit(0), F.size(values) - 2), lambda i: F.when(F.get(values, i + 1) > F.get(values, i), F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _probes(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def bands_for(rows: int, most: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """Bands (first bit, width, radius) of the bits: two codes at most `most` bits apart differ by the radius or less in one of
    them. Of all numbers of bands, that with the least work a row: its probes, and the rows that they meet if the codes were random."""

    def cut(n: int) -> list[tuple[int, int, int]]:
        edges = [round(i * bits / n) for i in range(n + 1)]
        return [(lo, hi - lo, min(most // n, hi - lo)) for lo, hi in zip(edges, edges[1:], strict=False)]

    return min(map(cut, range(1, min(bits, most + 1) + 1)), key=lambda bands: sum(_probes(w, r) * (1 + rows / 2**w) for _, w, r in bands))


def _part(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(F.shiftleft(code, 64 - first - width), 64 - width) if width < 64 else code


def _flipped(word: Column, width: int, flips: int, start: Column | None = None) -> Column:
    """All words that differ from `word` in exactly `flips` of `width` bits, made within the row; the plan grows by one
    nested lambda a flip, however many words there are."""
    if flips == 0:
        return F.array(word)
    bit = lambda i: F.call_function("shiftleft", F.expr("1L"), i.cast("int"))
    return F.flatten(F.transform(F.sequence(F.lit(0) if start is None else start, F.lit(width - flips)), lambda i: _flipped(word.bitwiseXOR(bit(i)), width, flips - 1, i + 1)))


def _keyed(code: Column, bands: Sequence[tuple[int, int, int]], flips: Sequence[int]) -> Column:
    """(band, part) for each band's words that are as many flips away as `flips` has for the band, one row each when exploded."""
    named = lambda i: lambda x: F.struct(F.lit(i).alias("band"), x.alias("part"))
    return F.flatten(F.array(*(F.transform(_flipped(_part(code, lo, w), w, k), named(i)) for (i, (lo, w, _)), k in zip(enumerate(bands), flips, strict=True) if k <= w)))


#: A probe of an index costs about as much as comparing a row with so many others in a block.
PROBE_COST = 256


def hamming_pairs(df: DataFrame, key: str, code: str, most: int, bits: int = 64) -> DataFrame:
    """Pairs a < b at most `most` bits apart, each once.

    The bits are cut into bands; a pair that close differs in one band by few bits only. So one side is keyed by its
    bands and the other by all words near its bands, an equality join finds all pairs, the distance is verified in the
    join, and a pair counts in the first band that finds it. How many bands there are follows the number of rows, with
    no limit: bands of about log2(rows) bits each, so that a key holds a few unrelated rows whatever the size of the table.
    Where a row's words would cost more than comparing it with all rows, blocks of rows are compared instead. Both are
    exact. Spark can't tell how many words a row has, so the join is by sorting: neither side is sent to the driver.
    """
    n = df.count()
    bands = bands_for(n, most, bits)
    if sum(_probes(w, r) for _, w, r in bands) * PROBE_COST > n:
        return _pairs_in_blocks(df, key, code, most, n)
    c = F.col(code)
    a = df.select(F.col(key).alias("a"), c.alias("ca"), F.explode(_keyed(c, bands, [0] * len(bands))).alias("e")).select("a", "ca", "e.band", "e.part")
    probes = F.concat(*(_keyed(c, bands, [k if k <= r else 65 for _, _, r in bands]) for k in range(max(r for _, _, r in bands) + 1)))
    b = df.select(F.col(key).alias("b"), c.alias("cb"), F.explode(probes).alias("e")).select("b", "cb", "e.band", "e.part")
    apart = F.col("ca").bitwiseXOR(F.col("cb"))
    first = F.coalesce(*(F.when(F.bit_count(_part(apart, lo, w)) <= r, i) for i, (lo, w, r) in enumerate(bands)))
    joined = a.join(b.hint("merge"), ["band", "part"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= most) & (F.col("band") == first))
    return joined.select("a", "b", F.bit_count(apart).alias("distance"))


def _pairs_in_blocks(df: DataFrame, key: str, code: str, most: int, n: int, block: int = 4096) -> DataFrame:
    """The pairs, by comparing every two blocks of about `block` rows: a block is one row of packed codes, and two of them
    are compared a few hundred rows at a time, so a task holds two blocks and a part of their pairs, however many there are."""
    blocks = max(1, -(-n // block))
    rows = df.select(F.col(key).alias("k"), F.col(code).cast("long").alias("c")).dropna().withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    packed, _ = _written(rows.groupBy("block").agg(F.collect_list(F.struct("k", "c")).alias("r")), "code-blocks")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, long work: not to be coalesced by size
    here, own = F.col("block"), [F.col("r.k").alias("ka"), F.col("r.c").alias("ca")]
    left = packed.select(here.alias("i"), F.explode(F.sequence(here, F.lit(blocks - 1))).alias("j"), *own).repartition(tasks, "i", "j")
    right = packed.select(F.explode(F.sequence(F.lit(0), here)).alias("i"), here.alias("j"), F.col("r.k").alias("kb"), F.col("r.c").alias("cb")).repartition(tasks, "i", "j")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in (batch.slice(at, 1) for batch in batches for at in range(batch.num_rows)):
            i, j = (cell[c][0].as_py() for c in ("i", "j"))
            ka, kb = (cell[c].flatten() for c in ("ka", "kb"))
            a, b = (cell[c].flatten().to_numpy().view(np.uint64) for c in ("ca", "cb"))
            for at in range(0, a.size, 128):
                far = np.bitwise_count(a[at : at + 128, None] ^ b)
                x, y = np.nonzero(far <= most)
                far, x = far[x, y], x + at
                if i == j:
                    once = x < y
                    far, x, y = far[once], x[once], y[once]
                if x.size:
                    yield pa.RecordBatch.from_arrays([ka.take(pa.array(x)), kb.take(pa.array(y)), pa.array(far.astype(np.int32))], names=["x", "y", "distance"])

    met = left.join(right.hint("merge"), ["i", "j"]).select("i", "j", "ka", "ca", "kb", "cb").mapInArrow(run, f"x {kind}, y {kind}, distance int")
    return met.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def nearest_reference(df: DataFrame, key: str, code: str, references: DataFrame, ref_key: str, ref_code: str, most_references: int = 1000) -> DataFrame:
    """The nearest reference, ties to the smaller key: by a list in the plan where there are few, else by nearest_of_table."""
    refs = references.select(F.col(ref_key).alias("reference"), F.col(ref_code).alias("rc")).limit(most_references + 1).collect()
    if not refs or len(refs) > most_references:
        return nearest_of_table(df, key, [code], references, ref_key, [ref_code]).withColumnRenamed("d0", "distance")
    listed = F.array(*(F.struct(F.lit(r["rc"]).alias("rc"), F.lit(r["reference"]).alias("reference")) for r in refs))
    best = F.array_min(F.transform(listed, lambda r: F.struct(hamming(F.col(code), r["rc"]).alias("distance"), r["reference"].alias("reference"))))
    return df.select(F.col(key), best.alias("m")).select(key, "m.reference", "m.distance")


class NearIndex:
    """Distinct reference codes, each with its two smallest keys, keyed by the bands of the first code; in the shared folder.

    Bands are as wide as log2 of the number of codes, so a word of a band has one unrelated code on average at any size.
    A row's neighbours are enumerated by growing radius: after all words `flips` or fewer bits from its bands have been
    probed, every reference nearer than `reach(flips)` has been met.
    """

    def __init__(self, references: DataFrame, key: str, codes: Sequence[str], bits: int = 64):
        self.codes = [f"r{i}" for i in range(len(codes))]
        rows = references.select(F.col(key).alias("k"), *(F.col(c).cast("long").alias(r) for c, r in zip(codes, self.codes, strict=True))).dropna()
        order = Window.partitionBy(*self.codes).orderBy("k")
        two = rows.withColumn("n", F.row_number().over(order)).filter("n <= 2").groupBy(*self.codes).agg(F.min("k").alias("k1"), F.max(F.when(F.col("n") == 2, F.col("k"))).alias("k2"))
        self.table, _ = _written(two, "near-index")
        self.size = self.table.count()
        n = max(1, bits // max(1, (max(1, self.size) - 1).bit_length()))
        edges = [round(i * bits / n) for i in range(n + 1)]
        self.bands = [(lo, hi - lo, 0) for lo, hi in zip(edges, edges[1:], strict=False)]
        home = _keyed(F.col(self.codes[0]), self.bands, [0] * n)
        self.home = self.table.select("*", F.explode(home).alias("e")).select(*self.codes, "k1", "k2", "e.band", "e.part")

    def reach(self, flips: int) -> int:
        """Codes at most this far apart have a band with `flips` or fewer differing bits."""
        return len(self.bands) * (flips + 1) - 1

    def probes(self, flips: int) -> int:
        return sum(comb(w, flips) for _, w, _ in self.bands)

    def met(self, rows: DataFrame, codes: Sequence[str], flips: int) -> DataFrame:
        """rows (key `q` and codes) with every reference that one of their words at exactly `flips` flips meets."""
        word = F.explode(_keyed(F.col(codes[0]), self.bands, [flips] * len(self.bands))).alias("e")
        return rows.select("*", word).select("q", *codes, "e.band", "e.part").join(self.home.hint("merge"), ["band", "part"])


def _best(found: DataFrame, codes: Sequence[str], others: Sequence[str], names: Sequence[str], skip_same_key: bool) -> DataFrame:
    """q, m: the least (distances, reference) of each row's candidates."""
    reference = F.when(F.col("k1") != F.col("q"), F.col("k1")).otherwise(F.col("k2")) if skip_same_key else F.col("k1")
    told = found.select("q", *(hamming(F.col(c), F.col(r)).alias(d) for c, r, d in zip(codes, others, names, strict=True)), reference.alias("reference"))
    return told.filter("reference IS NOT NULL").groupBy("q").agg(F.min(F.struct(*names, "reference")).alias("m"))


def nearest_of_table(df: DataFrame, key: str, codes: Sequence[str], references: DataFrame, ref_key: str, ref_codes: Sequence[str], skip_same_key: bool = False, block: int = 4096) -> DataFrame:
    """The nearest row of a reference table of any size, by the distances of all codes in turn, then the smaller key.

    Rows look their neighbours up in an index of the references by the first code, with a growing radius: a row is
    done when the best reference met so far is nearer than any that has not been met, and only the rest goes on to
    the next radius. References of equal codes are one entry, so copies make no hot key. The number of words grows
    quickly with the radius; where probing them would cost more than comparing a row with all references, the rows
    that are still open are compared with all references, in blocks: the search is exact at any distance. With
    skip_same_key a row is not its own reference. Without a reference, or a code of its own, a row has nulls. Keys are unique.
    """
    index = NearIndex(references, ref_key, ref_codes)
    names, own = [f"d{i}" for i in range(len(codes))], [f"c{i}" for i in range(len(codes))]
    rows = df.select(F.col(key).alias("q"), *(F.col(c).cast("long").alias(o) for c, o in zip(codes, own, strict=True)))
    left, _ = _written(rows.dropna(), "near-open")
    done, flips = [], 0
    empty = F.lit(None).cast(_best(index.met(left, own, 0), own, index.codes, names, skip_same_key).schema["m"].dataType)
    left = left.withColumn("m", empty)
    while index.size and index.probes(flips) * PROBE_COST <= max(index.size, PROBE_COST * len(index.bands)):
        found = _best(index.met(left, own, flips), own, index.codes, names, skip_same_key).withColumnRenamed("m", "new")
        after, _ = _written(left.join(found, "q", "left").select("q", *own, F.least("m", "new").alias("m")), "near-open")
        near = F.coalesce(F.col(f"m.{names[0]}") <= index.reach(flips), F.lit(False))
        done.append(after.filter(near).select("q", "m"))
        left, flips = after.filter(~near), flips + 1
        if left.isEmpty():
            break
    else:
        done.append(_compared(left, own, index, names, skip_same_key, block))
    best = done[0]
    for x in done[1:]:
        best = best.unionByName(x)
    return df.select(F.col(key).alias("_k")).join(best, F.col("_k") == F.col("q"), "left").select(F.col("_k").alias(key), "m.reference", *(f"m.{d}" for d in names))


def _compared(rows: DataFrame, own: Sequence[str], index: NearIndex, names: Sequence[str], skip_same_key: bool, block: int) -> DataFrame:
    """q, m: rows against all references, block by block in numpy; the best of each pair of blocks meet in one aggregate."""
    n_rows, n_refs = max(1, -(-rows.count() // block)), max(1, -(-index.size // block))
    dealt = lambda x, by, mine, others, n, m: x.withColumn(mine, F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))  # noqa: E731  (int on both sides: an int and a long of one value are dealt apart)
    left = dealt(rows.select("q", *own), ["q"], "x", "y", n_rows, n_refs)
    right, others = dealt(index.table, index.codes, "y", "x", n_refs, n_rows), list(index.codes)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        keys, k1 = a["q"].to_numpy(), b["k1"].to_numpy()
        out = {"q": [], "reference": [], **{d: [] for d in names}}
        order = np.argsort(k1, kind="stable")
        b = b.iloc[order]
        k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
        mine = [a[c].to_numpy().astype(np.int64).view(np.uint64) for c in own]
        theirs = [b[c].to_numpy().astype(np.int64).view(np.uint64) for c in others]
        for start in range(0, keys.size if k1.size else 0, 256):
            part = slice(start, start + 256)
            far = np.bitwise_count(mine[0][part, None] ^ theirs[0]).astype(np.int16)
            same = (keys[part, None] == k1) if skip_same_key else np.zeros(far.shape, bool)
            lone = same & pd.isna(k2)
            far[lone] = 999
            i, j = np.nonzero(far == far.min(axis=1)[:, None])
            i, j = i[~lone[i, j]], j[~lone[i, j]]
            d = [np.bitwise_count(x[part][i] ^ y[j]).astype(np.int32) for x, y in zip(mine, theirs, strict=True)]
            reference = np.where(same[i, j], k2[j], k1[j])
            by = np.lexsort((pd.Series(reference).rank(method="dense").to_numpy(), *d[::-1], i))
            first = by[np.r_[True, i[by][1:] != i[by][:-1]]] if by.size else by
            out["q"].append(keys[part][i[first]])
            out["reference"].append(reference[first])
            for name, x in zip(names, d, strict=True):
                out[name].append(x[first])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, object) for c, v in out.items()})

    kinds = rows.schema["q"].dataType.simpleString(), index.table.schema["k1"].dataType.simpleString()
    cells = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(run, f"q {kinds[0]}, reference {kinds[1]}, " + ", ".join(f"{d} int" for d in names))
    return cells.groupBy("q").agg(F.min(F.struct(*names, "reference")).alias("m"))


def pair_status(pairs: DataFrame, decisions: DataFrame, exact: Column) -> DataFrame:
    """exact, confirmed, rejected or review_required. `decisions` has a, b, decision in any order of a and b."""
    known = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision").groupBy("a", "b").agg(F.min("decision").alias("decision"))
    return pairs.join(known.hint("merge"), ["a", "b"], "left").withColumn("status", F.when(exact, "exact").otherwise(F.coalesce("decision", F.lit("review_required")))).drop("decision")


def _shared_folder(spark: SparkSession) -> str:
    local = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    folder = spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints" if local else None)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return folder.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A copy of the table in the shared folder, and where it is."""
    path = f"{_shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def connected(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Smallest member of each node's component; nodes without pairs are their own.

    Each round takes the least label of a node's neighbours and then that of the label itself, among the nodes that have
    pairs; labels only fall, and the loop ends when none does. Every round is written to spark.checkpoint.dir (or the
    local default) in place of the one before, so lineage stays short and a lost executor loses nothing.
    """
    spark = pairs.sparkSession
    files = spark._jvm.org.apache.hadoop.fs.Path(_shared_folder(spark)).getFileSystem(spark._jsc.hadoopConfiguration())
    written = lambda df: _written(df, "connected")
    edges, _ = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, at = written(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    while True:
        around = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(around.hint("merge"), labels["node"] == around["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        of = labels.select(F.col("node").alias("mid"), F.col("root").alias("beyond"))
        after, new = written(lower.join(of.hint("merge"), "mid").select("node", "old", F.least("mid", "beyond").alias("root")))
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at), True)
        labels, at = after.select("node", "root"), new
        if after.filter("root <> old").isEmpty():
            every = nodes.select(F.col(key).alias("node")).distinct()
            return every.join(labels.hint("merge"), "node", "left").select(F.col("node").alias(key), F.coalesce("root", "node").alias("root"))


def named_groups(labels: DataFrame, key: str) -> DataFrame:
    """Group name and size of each component."""
    return labels.groupBy("root").agg(group_name(F.collect_list(F.col(key).cast("string"))).alias("similarity_group"), F.count("*").alias("size"))


def shifted_correlation(pairs: DataFrame, first: str, second: str, side: int, reach: int = 4) -> DataFrame:
    """Adds the largest Pearson correlation of two side x side previews over shifts of up to `reach` in x and y."""

    @F.pandas_udf("double")
    def best(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), -1.0)
        for at in range(0, len(a), 256):  # so many pairs at once, shift by shift
            x, y = (np.stack(c.iloc[at : at + 256].to_numpy()).reshape(-1, side, side).astype(float) for c in (a, b))
            most = out[at : at + 256]
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    u = x[:, max(0, dy) : side + min(0, dy), max(0, dx) : side + min(0, dx)].reshape(len(x), -1)
                    v = y[:, max(0, -dy) : side + min(0, -dy), max(0, -dx) : side + min(0, -dx)].reshape(len(x), -1)
                    u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
                    scale = np.sqrt((u * u).sum(1) * (v * v).sum(1))
                    fits = np.divide((u * v).sum(1), scale, out=np.full(len(x), -1.0), where=scale > 0)
                    np.maximum(most, fits, out=most)
        return pd.Series(out)

    return pairs.withColumn("correlation", best(F.col(first), F.col(second)))


def duplicate_candidates(rows: DataFrame, decisions: DataFrame, key: str, codes: Sequence[str], digest: str, label: str, preview: str, side: int, bounds: Sequence[int] = (8, 10), least_correlation: float = 0.97) -> DataFrame:
    """Pairs to group or to review, one row each: a < b, d0, d1 (distances of the two codes), number_distance, correlation,
    exact, same_label, status.

    Pairs of equal digest are exact; pairs with a manual decision count as such; other pairs count if both codes are within
    their bounds and the names are consecutive numbers or the shifted correlation of the previews is high enough.
    Alike codes alone group nothing. A decision on a name that isn't there, or two different ones on a pair, is an error.
    Exact pairs are linked through the group's smallest key, so a large group of copies gives one pair a member.
    """
    names = decisions.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    if not names.join(rows.select(key), key, "left_anti").isEmpty():
        raise ValueError("a decision names an unknown row")
    manual = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision").groupBy("a", "b").agg(F.min("decision").alias("decision"), F.max("decision").alias("_other"))
    if not manual.filter("decision <> _other").isEmpty():
        raise ValueError("a pair is both confirmed and rejected")
    least = rows.groupBy(digest).agg(F.min(key).alias("a"), F.count("*").alias("_n")).filter("_n > 1")
    same = rows.join(least, digest).filter(F.col("a") < F.col(key)).select("a", F.col(key).alias("b"), F.lit(True).alias("exact"), F.lit(None).cast("string").alias("decision"))
    alike = hamming_pairs(rows, key, codes[0], bounds[0]).select("a", "b", F.lit(False).alias("exact"), F.lit(None).cast("string").alias("decision"))
    judged = manual.select("a", "b", F.lit(False).alias("exact"), "decision")
    pairs = same.unionByName(alike).unionByName(judged).groupBy("a", "b").agg(F.bool_or("exact").alias("linked"), F.max("decision").alias("decision"))
    of = lambda k: rows.select(F.col(key).alias(k), *(F.col(c).alias(f"{k}_{c}") for c in (*codes, digest, label, preview)))
    full = pairs.join(of("a"), "a").join(of("b"), "b").withColumns({f"d{i}": hamming(F.col(f"a_{c}"), F.col(f"b_{c}")) for i, c in enumerate(codes)})
    full = full.withColumn("exact", F.col(f"a_{digest}") == F.col(f"b_{digest}")).filter(F.col("linked") | F.col("decision").isNotNull() | (~F.col("exact") & (F.col("d1") <= bounds[1])))
    stem = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.[^.]*$", "")
    full = shifted_correlation(full, f"a_{preview}", f"b_{preview}", side).withColumn("number_distance", number_distance(stem("a"), stem("b")))
    close = (F.col("d0") <= bounds[0]) & (F.col("d1") <= bounds[1]) & (F.coalesce(F.col("number_distance") == 1, F.lit(False)) | (F.col("correlation") >= least_correlation))
    status = F.when(F.col("exact"), "exact_grouped").when(F.col("decision") == "confirmed", "confirmed_grouped").when(F.col("decision") == "rejected", "reviewed_not_grouped").otherwise("review_required")
    kept = full.filter(F.col("exact") | F.col("decision").isNotNull() | close)
    return kept.select("a", "b", "d0", "d1", "number_distance", F.round("correlation", 6).alias("correlation"), "exact", (F.col(f"a_{label}") == F.col(f"b_{label}")).alias("same_label"), status.alias("status"))


def similarity_groups(rows: DataFrame, candidates: DataFrame, key: str, label: str) -> DataFrame:
    """(key, similarity_group, size) from the grouped candidates; a group of two labels is an error."""
    linked = candidates.filter(F.col("status").isin("exact_grouped", "confirmed_grouped"))
    labels = connected(linked, rows, key).join(rows.select(key, label), key)
    names = labels.groupBy("root").agg(group_name(F.collect_list(F.col(key).cast("string"))).alias("similarity_group"), F.count("*").alias("size"), F.countDistinct(label).alias("_labels"))
    names = raise_unless(names, F.col("_labels") <= 1, "a similarity group has more than one label")
    return labels.join(names, "root").select(key, "similarity_group", "size")
