"""URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting rule
decides. Redirect edges (an html refresh to another address, a location assigned or replaced by script) and canonical-link
edges make pages and addresses aliases of each other; relative targets are resolved against the page's base or url. Connected components over these edges, found by distributed
stars, carry block decisions to aliases that no rule decides: such a page is blocked if an address of its component,
whether a page of the table or not, is blocked by a rule. An explicit allow rule keeps its page allowed, whatever its aliases. Pages without a
fitting rule and without a blocked alias are allowed.

Rules are a short list in the caller's hands and become one CASE expression per rule; edges are extracted in the
JVM and only pages that have any join the component search. A null url, or one without "://", has an empty host
and path, fits no rule and is no one's alias by address; a null html has no edges. Rows that repeat an id or a
url give a row each. Pages of any length are read whole. Rules that fit equally long go by name. Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged
from .components import components


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """A-Z lower-cased host: after the first :// up to /, ?, # or the end; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def resolved(base: Column, ref: Column) -> Column:
    """The absolute form of a reference on a page at base; null for other schemes, fragments, and where base has no host."""
    host, path = F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1), url_path(base)
    root = F.concat(F.lit("http://"), host)
    return (
        F.when(ref.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), ref)
        .when(ref.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:") | ref.startswith("#"), F.lit(None))
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(host == "", F.lit(None))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref.startswith("?"), F.concat(root, path, ref))
        .otherwise(F.concat(root, F.when(path == "", "/").otherwise(F.regexp_replace(path, r"[^/]*$", "")), ref))
    )


def _targets(html: Column, url: Column) -> Column:
    """Absolute addresses that a page names as its canonical form or redirects to."""
    value, quoted = r"[\"']?\s*([^\"'<>\s]+)", r"[\"']([^\"'<>\s]+)[\"']"
    script = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script"), F.lit(1)), "\n")
    own = r"(?<!\b(?:var|let|const)\s{1,9})(?<![\w.$-])(?:(?:window|document|self|top|parent)\s*\.\s*)*location"
    found = [
        F.regexp_extract_all(html, F.lit(rf"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*(?<![\w-])href\s*=\s*{value}"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?\s*\d++(?:\.\d*+)?\s*+[;,]\s*+(?:url\s*=\s*)?{value}"), F.lit(1)),
        # an attribute may be named location too: outside of scripts only whole addresses count
        F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)\blocation(?:\.href)?\s*=\s*{quoted}"), F.lit(1)), lambda x: x.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://")),
        F.regexp_extract_all(script, F.lit(rf"(?is){own}(?:\s*\.\s*href)?\s*=\s*{quoted}"), F.lit(1)),
        F.regexp_extract_all(html, F.lit(rf"(?is)(?<![\w$-])location\s*\.\s*(?:replace|assign)\s*\(\s*{quoted}"), F.lit(1)),
    ]
    named = F.regexp_extract(html, rf"(?is)<base\b[^>]*(?<![\w-])href\s*=\s*{value}", 1)
    base = F.when(named != "", F.coalesce(resolved(url, named), url)).otherwise(url)
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*found)), lambda x: resolved(base, F.regexp_replace(x, "(?i)&(amp|#38|#x26);", "&"))), lambda x: x.isNotNull()))


def _plain(path: Column) -> Column:
    """The path without its "." and ".." segments."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), start, lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))).otherwise(F.array_append(held, x)))
    whole = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def address(url: Column) -> Column:
    """The form in which addresses are compared: host and path, and a query if there is one."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1), F.lit(""))
    return F.when(url.contains("://"), F.concat(url_host(url), F.regexp_replace(_plain(url_path(url)), "^$", "/"), query))


def url_filter(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), address(F.col(url)).alias("address"))
        .withColumn("fit", fit)
        .select("page_id", "url", "host", "path", "address", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    )
    edges = pages.select(address(F.col(url)).alias("a"), F.explode(_targets(F.coalesce(F.col(html), F.lit("")), F.col(url))).alias("to")).select("a", address(F.col("to")).alias("b"))
    edges = staged(edges.filter("a <> b").distinct(), "aliases")
    roots = staged(components(edges), "alias-roots")
    at = F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 1), F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", 2)
    named = roots.withColumn("verdict", fitting_rule(*at, rules)["verdict"])
    blocked = named.filter("verdict = 'block'").select("root").distinct().join(roots, "root").select(F.col("node").alias("address"), F.lit("block").alias("alias"))
    blocked = staged(blocked, "blocked-aliases")
    # only pages without a rule and with an address are looked up; the others are spread over the join's partitions
    open_ = F.col("verdict").isNull() & F.col("address").isNotNull()
    looked_up = F.when(open_, F.col("address")).otherwise(F.concat(F.lit("\n"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("url", F.lit(""))))
    return judged.withColumn("address", looked_up).join(blocked, "address", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"))
