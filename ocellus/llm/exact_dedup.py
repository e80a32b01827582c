"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text, A-Z lower-cased, is cut into blocks of fixed size. The distinct blocks are dealt by their content,
sorted, and numbered: the number is the block's integer name, which equal blocks share and no others do.
Adjacent names are then paired and the distinct pairs sorted and numbered in the same way, halving each
document's names per level until one is left. Texts of the same number of blocks are equal exactly if their
last names are.

Blocks cross the shuffle once, after equal ones are combined where they are read. Names go back to their
documents by the block's 64-bit hash wherever that hash stands for one block only; blocks that share a hash
with a different block, if there are any, are joined by content. So no two different texts can meet, and a
block or pair that a third of the rows share is an ordinary skewed join key of a few bytes, which adaptive
execution splits. Names are written to the shared checkpoint folder once each level, so a lost executor
cannot renumber them.

Null texts count as empty. Of equal texts the row with the largest doc_id stays; a null doc_id counts as the
smallest, and of rows that repeat both id and text one stays. A row is known by its id and the SHA-256 of its
text, so rows may share an id. Texts of any length are cut into as many blocks as they take. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, column, discard, staged, unused

#: Characters in a block.
BLOCK = 2048


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Number distinct keys after sorting them where they were dealt: equal keys can't be in two partitions."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """One row per block: doc_id, sha, n (blocks of its text), place, block."""
    cut = F.when(F.col("whole") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    return (
        docs.select(F.col(key).alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("whole"))
        .select("doc_id", F.sha2("whole", 256).alias("sha"), cut.alias("cut"))
        .select("doc_id", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("place", "block"))
    )


def _block_names(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """doc_id, sha, n, place, name of every block of every row."""
    blocks = _blocks(docs, key, text, size)
    named = staged(_named(blocks.select("block").distinct(), "block").select(F.xxhash64("block").alias("hash"), "name"), "block-names")
    by_hash = staged(named.groupBy("hash").agg(F.count("*").alias("blocks"), F.min("name").alias("name")), "block-hashes")
    hashed = blocks.select("doc_id", "sha", "n", "place", F.xxhash64("block").alias("hash"))
    out = hashed.join(by_hash.filter("blocks = 1").select("hash", "name"), "hash").select("doc_id", "sha", "n", "place", "name")
    shared = by_hash.filter("blocks > 1").select("hash")
    if shared.isEmpty():
        return out
    clash = blocks.withColumn("hash", F.xxhash64("block")).join(shared, "hash", "left_semi")
    content = staged(_named(clash.select("block").distinct(), "block").withColumn("name", -2 - F.col("name")), "block-clashes")
    return out.unionByName(clash.join(content, "block").select("doc_id", "sha", "n", "place", "name"))


def _level(names: DataFrame) -> DataFrame:
    """The next level: adjacent names paired, distinct pairs sorted and numbered."""
    even = F.col("place") % 2 == 0
    pairs = names.groupBy("doc_id", "sha", "n", F.shiftright("place", 1).alias("place")).agg(
        F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"), F.sum(F.when(even, F.col("copies"))).alias("copies")
    )
    coded = staged(_named(pairs.select("left", "right").distinct(), "left", "right"), "pair-names")
    return pairs.join(coded, ["left", "right"]).select("doc_id", "sha", "n", "place", "name", "copies")


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """doc_id, sha, n, name, copies: rows of equal texts, and only those, agree in (n, name)."""
    level = staged(_block_names(docs, key, text, size).withColumn("copies", F.lit(1).cast("long")), "names")
    done, most = level.filter("n = 1"), level.agg(F.max("n")).first()[0] or 1
    left, height = level.filter("n > 1"), 0
    while 1 << height < most:
        height += 1
        level = staged(_level(left), "names")
        last = f"n <= {1 << height}"
        done, left = done.unionByName(level.filter(last)), level.filter(f"NOT ({last})")
    return done.groupBy("doc_id", "sha", "n", "name").agg(F.sum("copies").alias("copies"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = staged(identities(docs, key, text, size), "identities")
    groups = staged(rows.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return rows.select("*", copy).join(groups, ["n", "name"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that stay; of rows that repeat both id and text one. Other columns may have any names."""
    mark, mine, theirs = unused(docs, "text_sha256", "keep_doc_id", "keep_sha256")
    rows = staged(identities(docs, key, text, size), "identities")
    last = staged(rows.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id")), "groups")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stay = staged(rows.join(last, ["n", "name"]).filter(same).select(F.col("doc_id").alias(mine), F.col("sha").alias(theirs), "copies"), "kept-rows")
    discard(rows, last)
    marked = docs.withColumn(mark, F.sha2(ascii_lower(F.coalesce(column(text), F.lit(""))), 256))
    met = column(key).eqNullSafe(column(mine)) & (column(mark) == column(theirs))
    out = marked.join(stay.filter("copies = 1"), met, "left_semi").select(*map(column, docs.columns))
    again = stay.filter("copies > 1")  # whole rows are dealt a second time only where id and text repeat
    if again.isEmpty():
        return out
    return out.unionByName(marked.join(again, met, "left_semi").dropDuplicates([key, mark]).select(*map(column, docs.columns)))
