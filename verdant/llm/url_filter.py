"""URL filtering with block decisions that follow redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from verdant.llm.common import UPPER, staged
from verdant.llm.components import connected_components

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, UPPER.lower()), F.lit(""))


def path(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(host: Column, path: Column, url: Column) -> Column:
    """What tells pages apart: host, path and query. The scheme, the fragment, a trailing slash and
    ``utm_`` parameters lead to the same page."""
    query = F.regexp_extract(F.regexp_replace(url, r"(?s)#.*", ""), r"(?s)\?(.*)", 1)
    query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.startswith("utm_") & (x != ""))), "&")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, rule_verdict) for the distinct (host, path) of ``pages`` that a rule fits.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Each
    host is joined by its own suffixes, a handful, on equality, so neither side is compared with all of
    the other; Spark broadcasts the rules when they are small.
    """
    places = pages.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = places.withColumn("suffix", F.explode(suffixes))
    fits = named.join(rules, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("rule_verdict").alias("v")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.rule").alias("rule"),
                                                                    F.col("b.v").alias("rule_verdict"))


def page_targets(pages: DataFrame) -> DataFrame:
    """(u, v, host, path) of the redirect and canonical links in the pages' HTML: the page keys of both ends
    and the target's host and path, which the key does not tell exactly.

    A target without a scheme is read against the page's own address.
    """
    rows = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull())
    found = F.array(F.regexp_extract("html", CANONICAL, 1), F.regexp_extract("html", REFRESH, 1))
    has = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    rows = rows.where(has).select("url", F.explode(F.filter(found, lambda x: x != "")).alias("to"))
    to, url = F.col("to"), F.col("url")
    scheme = F.regexp_extract(url, r"^([^:]*)://", 1)
    base = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), "[^/]*$", "")
    target = (F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
              .when(to.startswith("/"), F.concat(base, to))
              .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), to)))
    rows = rows.withColumn("target", target).where((host(url) != "") & (host(F.col("target")) != ""))
    t = F.col("target")
    return rows.select(page_key(host(url), path(url), url).alias("u"), page_key(host(t), path(t), t).alias("v"),
                       host(t).alias("host"), path(t).alias("path"))


def key_ends(links: DataFrame) -> DataFrame:
    """(v, host, path) of both ends of the edges (u, v), read from the page keys themselves."""
    ends = links.select(F.explode(F.array("u", "v")).alias("v")).where("v is not null").distinct()
    return ends.select("v", F.regexp_extract("v", r"^[^/?]*", 0).alias("host"),
                       F.regexp_extract("v", r"(?s)^[^/?]*([^?]*)", 1).alias("path"))


def judge(pages: DataFrame, rules: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``.

    ``rules`` has (rule_host, rule_path, rule_verdict), ``links`` the edges (u, v) between page keys; by
    default the fixed rules and the edges in the pages' HTML. A page that a rule fits has the rule's
    verdict. Pages with one key, or joined by edges in either direction, are one component; a page
    without a rule is blocked if a rule blocks a page of its component and none explicitly allows one,
    else allowed. A link's end counts as a page of its component whether or not it is a row. Null or malformed urls have empty host and path, no rule, and stand alone, allowed.
    Repeated rows get equal answers; other columns are not looked at.
    """
    spark = pages.sparkSession
    if rules is None:
        table = F.inline(F.array(*[F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"),
                                            F.lit(v).alias("rule_verdict")) for h, p, v in RULES]))
        rules = spark.range(1).select(table)
    if links is None:
        ends = staged(page_targets(pages), "url-targets")
        links = ends.select("u", "v").where("u <> v")
    else:
        ends = key_ends(links)
    url = F.col("url")
    rows = pages.select(F.col("page_id"), host(url).alias("host"), path(url).alias("path"), url)
    rows = rows.select("page_id", "host", "path", F.when(F.col("host") != "", page_key(F.col("host"), F.col("path"), url)).alias("page"))
    fitted = match_rules(rows, rules).select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "rule", "rule_verdict")
    rows = staged(rows.join(fitted, (F.col("host") == F.col("r_host")) & (F.col("path") == F.col("r_path")), "left")
                  .select("page_id", "host", "path", "page", "rule", "rule_verdict"), "url-pages")
    groups = connected_components(links, "url-links")
    # what the rules say of link ends, which need not be rows
    ends = ends.select(F.col("v").alias("page"), F.col("host").alias("e_host"), F.col("path").alias("e_path")).distinct()
    fits = match_rules(ends.select(F.col("e_host").alias("host"), F.col("e_path").alias("path")), rules)
    ends = ends.join(fits, (F.col("e_host") == F.col("host")) & (F.col("e_path") == F.col("path")))
    places = rows.where("page is not null").select("page", "rule_verdict").unionByName(ends.select("page", "rule_verdict"))
    places = places.groupBy("page").agg(
        F.max(F.col("rule_verdict") == "block").alias("block"), F.max(F.col("rule_verdict") == "allow").alias("allow"))
    places = places.join(groups, F.col("page") == F.col("node"), "left").select(
        "page", F.coalesce("component", "page").alias("component"), "block", "allow")
    verdicts = places.groupBy("component").agg(
        (F.coalesce(F.max("block"), F.lit(False)) & ~F.coalesce(F.max("allow"), F.lit(False))).alias("blocked"))
    known = places.select(F.col("page").alias("p"), "component").join(
        verdicts.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select("p", "component", "blocked")
    return rows.join(known, F.col("page") == F.col("p"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "component")
