"""Driver queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, exact_dedup, hard_negatives, lm_scoring, quality, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity, url_filter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]
PATTERN = public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages"), URL_RULES)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the embeddings; labels of ids divisible by 7 move on by one, components become floor(256 x)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label), scale=256.0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_url_filters": op7_url_filters,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_divergence": op12_source_divergence,
    "op13_quality_rules": op13_quality_rules,
}
#: The rules of op7 as SQL, longest first. No page of the shared tables names an alias, so their verdict is the rule's or
#: allow; the components are held against brute force in the tests.
_RULES = "[" + ", ".join(f"{{'verdict': '{r.verdict}', 'host': '{r.host}', 'path': '{r.path}', 'name': '{r.name}'}}" for r in sorted(URL_RULES, key=lambda r: -len(r.name))) + "]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    """A pattern inside an SQL string."""
    return pattern.replace("'", "''")


ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op6_decontamination": rf"""
        WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
        pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS p FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
        win AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM dw, (SELECT DISTINCT m FROM pat), unnest(range(1, len(w) - m + 2)) t(i)),
        hit AS (SELECT doc_id, i, m, item_id FROM win JOIN pat USING (m, p)),
        hw AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hw.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN its USING (doc_id)""".replace("\\\\", "\\"),
    "op7_url_filters": rf"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT page_id, host, path, list_filter({_RULES}, lambda x: (host = x.host OR ends_with(host, '.' || x.host)) AND starts_with(path, x.path))[1] AS fit FROM p)
        SELECT page_id, host, path, fit.name AS rule, coalesce(fit.verdict, 'allow') AS verdict FROM r""",
    "op8_substring_dedup": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS p FROM dw, unnest(range(1, len(w) - 48)) t(i)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY p) AS f FROM win) WHERE f < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM dw) ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM dw LEFT JOIN kept USING (doc_id)""".replace("\\", "\\"),
    "op11_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score FROM pos JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[A-Za-z\x{{80}}-\x{{10FFFF}}]+') AS terms FROM documents),
        t AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(terms) AS term FROM d) GROUP BY ALL),
        vocab AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
        lq AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q FROM vocab WINDOW w AS (PARTITION BY lang)),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT g.lang, g.source, v.term, coalesce(s.n, 0)::HUGEINT AS n FROM g JOIN vocab v USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) s USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(f), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source, y.source AS other, (x.p - y.p) * (x.p - y.p) // y.p AS f FROM p x JOIN p y USING (lang, term)) z ON z.lang = a.lang AND z.source = a.source AND z.other = b.source GROUP BY ALL),
        term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN lq USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200""".replace("\\\\", "\\"),
    "op13_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS p FROM d, unnest(range(1, len(w) - 1)) u(i)),
        rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, p) > 1),
        cov AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM rep) GROUP BY doc_id),
        line AS (SELECT doc_id, translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ') AS x FROM (SELECT doc_id, unnest(list_distinct(l)) AS line FROM d)),
        fit AS (SELECT doc_id, sum(length(replace(x, ' ', ''))) AS n FROM line
            WHERE (regexp_matches(right(rtrim(x), 5), '{_quoted(quality_rules.ENDING)}') OR len(regexp_extract_all(x, '[^ ]+')) >= {quality_rules.LONG})
            AND 100 * len(regexp_extract_all(x, '{_quoted(quality_rules.PUNCTUATION)}')) <= {quality_rules.MARKS} * length(replace(x, ' ', ''))
            AND NOT (regexp_matches(x, '{quality_rules.MENU}') AND 4 * len(regexp_extract_all(x, '{quality_rules.MENU}')) >= len(regexp_extract_all(x, '[^ ]+')))
            AND NOT regexp_matches(lower(x), '{quality_rules.BOILERPLATE}') GROUP BY doc_id),
        m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
            coalesce(fit.n, 0)::BIGINT AS kept_chars FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN fit USING (doc_id))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= {quality_rules.KEEP} * word_chars AS kept FROM m""".replace("\\\\", "\\"),
}
