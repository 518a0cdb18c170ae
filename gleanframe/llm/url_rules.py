"""Host and path rules for pages, and their spread over redirects and canonical links; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.common import components, stage

AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules travel as a literal of the plan.
MOST_RULES = 10_000

CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
BASE_TAG = r"(?is)<base\b[^>]*\bhref\b[^>]*>"
#: What browsers don't read as tags.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
#: A scheme that leads to no page.
NO_PAGE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)"
TARGET = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"


def without_dots(path: Column) -> Column:
    """The path with "." and ".." segments taken out; an empty path is "/"."""
    def step(done: Column, part: Column) -> Column:
        return F.when(part == ".", done).when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))

    parts = F.split(path, "/")
    done = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)
    whole = F.concat(done, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(?:/|$)"), F.when(done == "", "/").otherwise(whole)).otherwise(path)


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds rest (what follows the first ://, or the empty text), host, path, and node: what names a page whatever its scheme,
    default port, dot segments and fragment, which is host, path and query, null without a host. Step by step, so that no expression
    holds another twice."""
    at = F.locate("://", F.coalesce(F.col(url), F.lit("")))
    query = F.regexp_extract("rest", r"^[^?#]*(\?[^#]*)?", 1)
    return (df.withColumn("rest", F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(""))
            .withColumn("host", F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), AZ, LOWER_AZ))
            .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
            .withColumn("node", F.when(F.col("host") != "", F.concat(F.regexp_replace("host", r":(?:80|443)?$", ""), without_dots(F.col("path")), query))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (verdict, host, path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        # Descending order of the negated length puts the longest first; ties go to allow, then to the smaller rule.
        by_host.setdefault(rule_host, []).append(F.struct(
            F.lit(-len(rule_host + rule_path)).alias("n"), F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"), F.lit(rule_path).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    known = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*own))])
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: known[s]), lambda r: r.isNotNull())), lambda r: F.startswith(path, r["path"]))
    best = F.get(F.array_sort(fits), F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def absolute(link: Column, url: str) -> Column:
    """The URL that a link leads to from url, whose parts are at hand. Null if it leads to no page."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.substring(F.col(url), F.lit(1), F.locate("://", F.col(url)) - 1)
    site = F.concat(scheme, F.lit("://"), "host")
    folder = F.regexp_replace(F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")), r"[^/]*$", "")
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.rlike(NO_PAGE), F.lit(None))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(site, link))
            .when(link.startswith("#"), F.col(url))
            .when(link.startswith("?"), F.concat(site, "path", link))
            .otherwise(F.concat(site, folder, link)))


def with_links(df: DataFrame) -> DataFrame:
    """(a, target): a row for every canonical link and redirect of a page: its node, and the link's absolute URL, from the page's
    base if it names one. Comments and scripts are not read. Needs url, html and the url's parts."""
    def found(tag: str, attribute: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))

    links = F.array_distinct(F.filter(F.concat(found(CANONICAL, HREF), found(REFRESH, TARGET)), lambda t: t != ""))
    base = F.regexp_extract(F.regexp_extract("html", BASE_TAG, 0), HREF, 1)
    read = df.filter("host <> ''").withColumn("a", F.col("node")).withColumn("html", F.regexp_replace("html", UNREAD, " "))
    based = read.withColumn("base", base).withColumn("base", F.when(F.col("base") != "", absolute(F.col("base"), "url")))
    based = based.withColumn("links", links).withColumn("base", F.coalesce("base", "url"))
    return with_parts(based.select("a", "links", "base"), "base").withColumn("link", F.explode("links")).withColumn(
        "target", absolute(F.col("link"), "base")).select("a", "target")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: its id, host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's; the longest fits best and
    decides. Pages without a rule take a block from their aliases: pages and link targets joined by redirects (meta refresh) and canonical links, all that a page has, in any number of
    steps, of which one is blocked by a rule. An allow rule of the page itself comes before that; an allowed alias neither passes
    its allow on nor stops a block. All others are allowed. Scheme, default port, dot segments and fragment don't tell pages apart;
    an empty path is "/". Links count from the page's base; those in comments and scripts don't.

    Null URLs and URLs without :// have empty host and path, no rule and no alias; null html has no link. Repeated rows are judged each, null ids kept. Other
    columns are not looked at.

    Rules are a literal expression, so pages with rules need no shuffle. Only pages with links enter the components; what comes
    back is the blocked aliases, joined by URL.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    linked = own.filter(F.col("html").rlike(CANONICAL) | F.col("html").rlike(REFRESH)).select("url", "html")
    # Written before anything filters on it: a filter pushed through would repeat all these expressions.
    links = stage(with_links(with_parts(linked, "url")), "links")
    named = components(with_parts(links, "target").select("a", F.col("node").alias("b"))).withColumn("url", F.concat(F.lit("x://"), "node")).drop("node")
    named = with_parts(named, "url").select("node", "root", rule_for(F.col("host"), F.col("path"), rules).alias("r"))
    bad = named.filter(F.col("r.verdict") == "block").select("root").distinct()
    blocked = named.join(bad, "root", "left_semi").select(F.col("node").alias("alias")).withColumn("spread", F.lit("block"))

    judged = with_parts(own.select("id", "url"), "url").withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return judged.join(blocked, F.col("node") == F.col("alias"), "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "spread", F.lit("allow")).alias("verdict"))
