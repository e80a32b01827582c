"""Line-first quality rules, in DataFrame operations only.

A text is cut at line feeds. Every line is judged by itself, and the lines that fail any rule are taken out:

* punctuation: the line has fewer than LONG words and doesn't end like a sentence, or more than MARKS percent of its word characters are ASCII
  punctuation;
* navigation: a menu, one of `|`, `>`, `»`, `·`, `•` standing alone between words at least once in four words;
* boilerplate: notices on cookies, copyright, licences, scripts and the like, and lines that repeat an earlier line.

Then the document is judged by what is left: it goes if it fails the base rules (fewer than LEAST_WORDS words, or more
than REPEATED percent of its words in three-word windows that the text holds twice or more), or if its lines kept less
than KEEP percent of its word characters. Words are separated by space and the characters \\x09 to \\x0D.

All of it happens within a row: one scan, no shuffle, no Python. Repeated windows are found by sorting the row's own
windows with their places; neighbours in that order that agree are repeats, whatever their number. Work is n log n in
the words of a text, and memory is that of one text's windows (about 150 bytes a word).

Null texts have no words and lines, fail the base rules and come back as null. Empty texts fail too. Texts of any length
are taken whole. Every row gives a row, also of repeated or null ids; other columns are not read (`quality_rules`) or pass
through whatever their names (`clean`). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, unused

WORD = r"[^\x20\x09-\x0D]"
LEAST_WORDS, REPEATED, KEEP, MARKS, LONG = 50, 50, 50, 25, 20
#: What a sentence may end with, then at most four closing quotes and brackets.
ENDING = r"[.!?…:;。！？]['\"’”»)\x5D]{0,4}\z"
PUNCTUATION = r"[!-/:-@\x5B-\x60\x7B-\x7E]"
MENU = r"(^| )[|>»·•]( |\z)"
#: In lower-case text.
BOILERPLATE = r"(^|[^a-z])(cookie|javascript|privacy policy|terms of (use|service)|all rights reserved|copyright|©|\(c\) ?[0-9]{4}|licen[sc]ed? (under|agreement|to you)|sign (in|up) |log ?in |newsletter|subscribe|click here|read more|lorem ipsum)"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def spaced(text: Column) -> Column:
    """The text with a space for every white-space character but the line feed."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "))


def line_passes(line: Column) -> Column:
    """True for a line that no rule fails; lines are judged by themselves."""

    def judged(line: Column) -> Column:
        marked = 100 * F.regexp_count(line, F.lit(PUNCTUATION)) > MARKS * F.length(without_spaces(line))
        words = F.size(F.array_remove(F.split(line, " ", -1), ""))
        menu = line.rlike(MENU) & (4 * F.regexp_count(line, F.lit(MENU)) >= words)
        return (F.substring(F.rtrim(line), -5, 5).rlike(ENDING) | (words >= LONG)) & ~marked & ~menu & ~F.lower(line).rlike(BOILERPLATE)

    return let(spaced(line), judged)


def worded_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the list of words holds twice or more."""

    def covered(found: Column) -> Column:  # starts of repeated windows, rising
        return F.aggregate(F.transform(found, lambda at, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), at - F.get(found, k - 1)))), F.lit(0), lambda a, b: a + b)

    def starts(ordered: Column) -> Column:
        same = lambda x, k: x["w"].eqNullSafe(F.get(ordered, k)["w"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.struct(F.concat(x, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return let(let(F.sort_array(windows), starts), covered)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars, base_failed, kept."""
    held = docs.select(column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    plain = held.select("doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), "text")
    words = F.array_remove(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ", -1), "")
    cut = F.struct(worded_lines(F.col("text")).alias("lines"), words.alias("words"))
    # a row of its own: else a filter on the result would be pushed into the lambdas' inputs, which each word would compute anew
    cut = plain.select("doc_id", "n_symbols", F.inline(F.array(cut)))
    told = cut.select("doc_id", "n_symbols", "words", F.size("lines").alias("n_lines"), F.array_distinct("lines").alias("lines"))
    passed = F.filter("lines", line_passes)
    n_repeat = F.when(F.size("words") < 4, F.lit(0)).otherwise(repeat_words(F.col("words")))
    rows = told.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.col("n_lines") - F.size("lines")).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        F.length(without_spaces(spaced(F.array_join(passed, "")))).cast("long").alias("kept_chars"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * F.col("kept_chars") >= keep * F.col("word_chars")))


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: int = KEEP) -> DataFrame:
    """The documents that are kept, all columns, with the lines that failed taken out of their texts."""
    (mark,) = unused(docs, "rule_input")
    measured = docs.withColumn(mark, column(text))
    flat = quality_rules(measured.select(F.struct(*map(column, docs.columns)).alias("row"), column(mark)), "row", mark, keep).filter("kept")
    left = F.array_join(F.filter(F.array_distinct(worded_lines(F.col("doc_id").getField(text))), line_passes), "\n")
    return flat.select(*((left if c == text else F.col("doc_id").getField(c)).alias(c) for c in docs.columns))
