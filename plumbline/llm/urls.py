"""URL verdicts that follow redirects and canonical links.

A rule (verdict, host, path) fits a url on its host or a subdomain whose path starts with the rule's path; the longest rule
wins, allow before block where equally long. Urls that redirect to each other or name the same canonical url are one class,
found as connected components of those edges. A url without a rule of its own is blocked if some url of its class is blocked
by a rule and none is allowed by one: an explicit allow goes before what is inherited, for the url itself and for its class.

Two urls are the same node if they agree in host, path and query; scheme and fragment do not name another resource.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and no alias, and is allowed; null html
has no link; pages with equal urls share a node; self-links are no edge; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import components, written

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]

_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null without a scheme."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that decides, as struct(rule, verdict); its fields are null if none fits."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        own = F.struct(
            F.lit(len(rule_host) + len(rule_path)).alias("length"), F.lit(verdict == ALLOW).alias("allow"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")
        )
        fits.append(F.when(((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path)), own))
    none = F.lit(None).cast("struct<length:int,allow:boolean,rule:string,verdict:string>")
    return F.array_max(F.array(none, *fits))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the canonical or refresh target that their html names."""
    html = F.col("html").cast("string")
    url = F.col("url").cast("string")
    found = pages.where(F.instr(url, "://") > 0).where(html.rlike(r"(?i)\b(canonical|refresh)\b"))
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, _HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, _TARGET, 1))
    links = found.select(url.alias("url"), F.explode(F.concat(canonical, refresh)).alias("href")).where("href <> ''")
    href, host = F.col("href"), host_of(F.col("url"))
    folder = F.regexp_extract(path_of(F.col("url")), r"^.*/", 0)
    target = (
        F.when(F.instr(href, "://") > 0, href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("x:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(F.lit("x://"), host, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.lit("x://"), host, path_of(F.col("url")), href))
        .when(~F.startswith(href, F.lit("#")), F.concat(F.lit("x://"), host, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
    return links.select(node_of(F.col("url")).alias("a"), node_of(target).alias("b")).where("a <> b")


def url_verdicts(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and ``inherited``: the verdict came from the page's class.

    ``redirects`` may add edges (from_url, to_url) that a crawler has seen.
    """
    url = F.col("url").cast("string")
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a <> b"))
    edges = written(edges.distinct(), "url-edges")
    groups = written(components(edges, "a", "b"), "url-groups")
    at = F.concat(F.lit("x://"), F.col("node"))  # a node's text is host, path and query
    ruled = groups.withColumn("found", rule_for(host_of(at), path_of(at), rules)["verdict"])
    classes = ruled.groupBy("component").agg(F.bool_or(F.col("found") == BLOCK).alias("blocks"), F.bool_or(F.col("found") == ALLOW).alias("allows"))
    blocked = classes.where("blocks AND NOT coalesce(allows, false)").select("component")
    inherited = written(groups.join(blocked, "component", "left_semi").select(F.col("node").alias("_node")).withColumn("_blocked", F.lit(True)), "url-blocked")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_at"))
    judged = judged.withColumn("_own", rule_for(F.col("host"), F.col("path"), rules))
    out = judged.join(inherited, F.col("_at") == F.col("_node"), "left")
    own = F.col("_own.verdict")
    follows = own.isNull() & F.coalesce("_blocked", F.lit(False))
    return out.select("page_id", "host", "path", F.col("_own.rule").alias("rule"), F.when(follows, F.lit(BLOCK)).otherwise(F.coalesce(own, F.lit(ALLOW))).alias("verdict"), follows.alias("inherited"))
