"""How far the sources of a language differ in their words: exact integer divergences, ranked.

Terms are the matches of TERM, only A-Z lower-cased. A language keeps the terms in at least `least` of its documents, V of
them. Every occurring (lang, source) group, and each language as a whole, gives each kept term
p = 1 + floor(SCALE * (count + 1) / (N + V)), N being its count of all kept terms. Two distributions differ at a term by
floor((p - q)^2 / q). Part `pair` has, for each group and each other source of its language, the sum over all kept terms
(0 without kept terms), all ranks; part `term` has the kept terms that a group uses, and more than its language does, with
their values against the language, to rank `top`. Ranks start at 1, value descending, item ascending in UTF-8 order.

Plain relational: matches are exploded and counted, with a map-side combine, by (lang, source, term), and the counts of a
term by source, one entry a source of its language at most, become a map beside it; the groups of a language meet its kept
terms in a join that fills in the zeros; that table is dealt by (lang, term) and joined with itself there, each pair of
sources once for both directions, so a key has one row a source, never a row a document. The join that fills in the zeros
would have only as many keys as there are languages, so both its sides carry one of SALTS numbers, by the term. No side is broadcast but those
that Spark finds small. All arithmetic is in 64-bit integers: the division runs over three digits to the base 1,000, so
that N + V may be up to 9e15.

Null texts, languages and sources count as empty. Groups without any term have rows in `pair` and none in `term`; the only
source of a language has no `pair` row. Repeated rows count each, null and repeated doc_ids too: a row is a document. Texts
of any length are taken whole. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, column, discard, staged

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, LEAST, TOP = 1_000_000_000, 3, 200
#: Numbers by which a language's terms are dealt when they meet its sources.
SALTS = 256


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 1) / (total + kept)) for count <= total, three digits at a time so that nothing leaves 64 bits."""
    rest, below, out = count + 1, total + kept, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + quotient(rest, below), rest % below
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it)."""
    empty = [F.coalesce(column(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))]
    whole = docs.select(*empty, F.coalesce(column(text), F.lit("")).alias("text"))
    lower = F.when(F.length("text") == F.octet_length("text"), F.lower("text")).otherwise(ascii_lower(F.col("text")))
    found = whole.select("lang", "source", F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)).alias("terms"))
    both = found.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    rows = both.select("lang", "source", F.col("once").cast("long").alias("once"), F.explode("terms").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def shares(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the (lang, source) groups; and lang, term, source, n, p, q of every group and kept term of its language."""
    counts = term_counts(docs, text, lang, source)
    by_source = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), by_source).filter(F.col("docs") >= least)
    vocabulary = staged(vocabulary.select("lang", "term", "n_lang", "counts"), "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("kept"))
    totals = vocabulary.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    found = docs.select(*(F.coalesce(column(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source)))).distinct()
    groups = staged(found.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")), "groups")
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    dealt = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "source", "total", "total_lang", "kept")
    full = vocabulary.withColumn("salt", salt).join(dealt, ["lang", "salt"])
    full = full.select("lang", "term", "source", F.coalesce(F.try_element_at("counts", F.col("source")), F.lit(0)).alias("n"), "total", "n_lang", "total_lang", "kept")
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    full = staged(full.select("lang", "term", "source", "n", p.alias("p"), q.alias("q")), "shares")
    discard(vocabulary)
    return groups, full


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    groups, full = shares(docs, text, lang, source, least)
    sides = full.select("lang", "term", "source", "p"), full.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    p, other = F.col("p"), F.col("other")
    both = sides[0].join(sides[1], ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(distance(p, other)).alias("there"), F.sum(distance(other, p)).alias("back"))
    sums = both.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = full.filter("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
