"""URL filters with redirect equivalence.

A page whose url fits a rule has the rule's verdict.  Pages without one are judged by what they are aliases
of: urls joined by canonical links and redirects form components, and a block of any member reaches all
aliases, unless a member is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import prepare, quoted, written
from foliarc.llm.graph import connected_components

# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 1000
CANONICAL = r"""(?i)\brel\s*=\s*(?:canonical\b|"(?:[^">]*\s)?canonical[\s"]|'(?:[^'>]*\s)?canonical[\s'])"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], value: int) -> Column:
    """The longest fitting rule's text (value -1) or verdict (value 0); null where none fits.  Equally long rules: the longer host first."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules can be given as a list")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(rule[1] + rule[2] if value < 0 else rule[0])).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..``, which take the one before them away."""
    parts = F.split(path, "/")
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))
    gone = F.aggregate(F.slice(parts, 2, F.size(parts)), F.lit(""), step)
    gone = F.concat(gone, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path.rlike(r"^/(?:.*/)?\.\.?(?:/|$)"), gone).otherwise(path)


def resolved(to: Column, host: Column, path: Column) -> Column:
    """Host, path and query of what a reference names on a page of a host and path; null where it names no address.

    References are those of RFC 3986, 5.2: with a scheme and authority, with an authority, from the root, a
    query of the page itself, or relative to its folder; other schemes name nothing.  Fragments are left out.
    """
    to = F.regexp_extract(to, r"^[^#]*", 0)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    full = F.when(to == "", None).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.regexp_replace(to, r"^[^:]*://", ""))
    full = full.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None).when(to.startswith("//"), F.substring(to, 3, F.length(to)))
    full = full.when(to.startswith("/"), F.concat(host, to)).otherwise(F.concat(host, folder, to))
    full = F.concat(host_of(full), without_dots(path_of(full)), F.regexp_extract(full, r"^[^?]*(.*)", 1))
    return F.when(to.startswith("?"), F.concat(host, path, to)).otherwise(full)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): addresses of pages and of what their canonical links and refresh redirects name, outside comments and scripts."""
    html = F.regexp_replace(F.col(quoted(html_col)), r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)", " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    d = pages.where(F.col(quoted(html_col)).rlike(r"(?i)canonical|refresh")).select(F.col(quoted(url_col)).alias("url"), tags.alias("tags"))
    d = d.select("url", F.explode("tags").alias("tag"))
    link = F.when(F.col("tag").rlike(CANONICAL), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    link = link.when(F.col("tag").rlike(r"""(?i)http-equiv\s*=\s*["']?refresh"""), F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    d = d.select("url", F.replace(link, F.lit("&amp;"), F.lit("&")).alias("to")).where("to != '' and to is not null")
    d = d.select("to", after_scheme(F.col("url")).alias("rest"))
    d = d.select("to", host_of(F.col("rest")).alias("host"), path_of(F.col("rest")).alias("path"), F.regexp_extract("rest", r"^[^/?#]*([^#]*)", 1).alias("tail"))
    d = d.select(F.concat("host", "tail").alias("a"), resolved(F.col("to"), F.col("host"), F.col("path")).alias("b")).where("a != ''")
    return d.where("b != '' and a != b").distinct()


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Verdict on every page: ``id_col``, host, path, rule, verdict, address, by (rule, alias or default).

    A url that is null or has no ``://`` has an empty host and path, fits no rule and has no aliases; a null
    html names none.  Rows that repeat a url share its verdict; an empty table gives no rows; other columns
    are not read.  Components are found over addresses in distributed steps; one aggregate row a component
    is joined back.
    """
    prepare(pages.sparkSession)
    rest = F.col("rest")
    p = pages.select(F.col(quoted(id_col)).alias("id"), after_scheme(F.col(quoted(url_col))).alias("rest"))
    p = p.select("id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1).alias("tail"))
    p = p.select("id", "host", "path", F.concat("host", "tail").alias("address"))
    p = p.select("*", fitting_rule(F.col("host"), F.col("path"), rules, -1).alias("rule"), fitting_rule(F.col("host"), F.col("path"), rules, 0).alias("own"))
    nodes = connected_components(written(alias_edges(pages, url_col, html_col), "url-edges"))
    said = nodes.withColumn("own", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules, 0))
    sides = said.groupBy("component").agg(F.bool_or(F.col("own") == "block").alias("block"), F.bool_or(F.col("own") == "allow").alias("allow"))
    reached = nodes.join(sides.where("block and not coalesce(allow, false)").select(F.concat("component", F.lit("")).alias("c")), F.col("component") == F.col("c")).select("node")
    alone = F.concat(F.lit("\x00"), F.coalesce(F.col("id").cast("string"), F.lit("")))  # pages without address are dealt by id
    out = p.join(reached, F.when(F.col("address") != "", F.col("address")).otherwise(alone) == F.col("node"), "left")
    verdict = F.coalesce("own", F.when(F.col("node").isNotNull(), F.lit("block")).otherwise("allow"))
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("node").isNotNull(), "alias").otherwise("default")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "address", by.alias("by"))
