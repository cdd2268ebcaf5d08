"""URL filters: host and path rules, spread over redirect and canonical-link aliases.

A page's own verdict is that of the longest rule that fits its url. Pages that
redirect to one another or name one another as canonical are one resource:
connected components over these edges carry a block to all aliases without a
rule of their own, unless a member of the component is explicitly allowed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelops.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule; of equally long ones an allow comes first, then by name."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name), reverse=True):
        fits = r.fits(host, path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def resource(rest: Column) -> Column:
    """A url without scheme and fragment, host lower-cased: the identity of what it names."""
    return F.concat(host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


_TAG_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_TAG_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of meta redirects in a page, as written."""
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_TAG_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(_TAG_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _REFRESH_URL, 1))
    targets = F.transform(F.concat(canonical, refresh), lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))
    return F.filter(targets, lambda t: t != "")


def target_rest(target: Column, host: Column, path: Column) -> Column:
    """A target without its scheme, taken relative to the page that names it."""
    return (
        F.when(F.instr(target, "://") > 0, after_scheme(target))
        .when(target.startswith("//"), target.substr(F.lit(3), F.length(target)))
        .when(target.startswith("/"), F.concat(host, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(host, path, target))
        .otherwise(F.concat(host, F.coalesce(F.nullif(F.regexp_extract(path, r"^.*/", 0), F.lit("")), F.lit("/")), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target): resources linked by a canonical link or a redirect in the pages' html."""
    rest = after_scheme(F.col("url"))
    named = pages.select(rest.alias("rest"), F.explode(link_targets(F.col("html"))).alias("target"))
    target = target_rest(F.col("target"), host_of(F.col("rest")), path_of(F.col("rest")))
    return named.select(resource(F.col("rest")).alias("source"), resource(target).alias("target")).where("source <> '' and target <> ''")


def filter_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    ``edges`` (source, target) are further alias links between resources, such
    as redirects seen by a crawler. The rules are a bounded list: they become
    one expression. A null url, or one without ``://``, has empty host and path
    and fits no rule; it is allowed. A null html has no edges. Rows stay as
    they are, repeated ones too; other columns are dropped.
    """
    pages = pages.select("page_id", "url", "html")
    links = page_edges(pages)
    if edges is not None:
        links = links.union(edges.select("source", "target").where("source is not null and target is not null"))
    rest = after_scheme(F.col("url"))
    rows = pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.xxhash64(resource(rest)).alias("node"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))

    ends = links.select(F.explode(F.array("source", "target")).alias("rest")).distinct()
    node_verdict = judged(host_of(F.col("rest")), path_of(F.col("rest")), rules)[1]
    nodes = ends.select(F.xxhash64("rest").alias("node"), node_verdict.alias("own"))
    found = components(links.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    states = (
        nodes.join(found, "node")
        .groupBy("root")
        .agg(F.max(F.col("own") == "block").alias("blocked"), F.max(F.col("own") == "allow").alias("allowed"))
        .where("blocked and not coalesce(allowed, false)")
    )
    aliases = found.join(states, "root", "left_semi").select("node", F.lit("block").alias("passed"))
    verdict = F.coalesce("own", "passed", F.lit("allow")).alias("verdict")
    return rows.join(aliases, "node", "left").select("page_id", "host", "path", "rule", verdict)
