"""URL filters by redirect equivalence.

Rules (host, path, block or allow) fit a host and its subdomains where the url's path starts with the rule's;
of fitting rules the longest wins, and at equal length the allowing one. Redirects (``<meta http-equiv=refresh>``,
or a table given by the caller) and canonical links tie urls together; connected components over these edges
carry a block to every alias without a rule of its own. An explicit allow takes precedence: a page that an
allowing rule fits stays allowed, and a component with an allowed member carries no block.

Urls are compared in a normal form: scheme and host lower-cased (A-Z), an empty path is ``/``, the fragment goes. A
page's own rule is found on its url as it stands, as are host and path of the result.

Only DataFrame functions run. Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, takes part in no component and is allowed; a null page text has no links; repeated rows are judged
one by one; an empty table gives an empty result; further columns are not read; of rules of equal length that fit, the
allowing one holds. Links are taken from the raw text of the page: every ``link`` tag whose ``rel`` names canonical and every
refreshing ``meta`` tag, in any order of their attributes and commented-out ones included. ``&amp;`` in a target is
``&``, and relative targets (``//host``, ``/path``, ``path``, ``?query``) are resolved against the page's url; other schemes
without ``://`` and fragments are no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline.llm.components import connected_components
from gustline.llm.shared import ascii_lower, stash

#: Production rules: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Tags that may hold a link; what marks them; where they have it.
_LINK_TAG, _META_TAG = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_IS_CANONICAL, _IS_REFRESH = r"""(?is)\srel\s*=\s*["']?\s*([a-z-]+\s+)*canonical\b""", r"""(?is)\shttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)"""
_CONTENT = r"""(?is)\scontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """Scheme and host lower-cased, an empty path as ``/``, without fragment; null where there is no ``://``."""
    part = lambda k: F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)([^?#]*)([^#]*)", k)
    path = F.when(part(2) == "", F.lit("/")).otherwise(part(2))
    return F.when(url.contains("://"), F.concat(ascii_lower(part(1)), path, part(3)))


def resolve(url: Column, to: Column) -> Column:
    """The absolute form of the target ``to`` on the page ``url``; null for a fragment or a scheme without ``://``."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(to, r"(?s)^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(page == "", F.lit("/")).otherwise(F.regexp_extract(page, r"(?s)^(.*/)", 1))
    whole = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), r"(/\.{1,2})$", "$1/")
    # dot segments go; the first part, before the leading slash, is empty and stays
    step = lambda out, x: F.when(x == ".", out).when(x == "..", F.regexp_replace(out, "/[^/]*$", "")).otherwise(F.concat(out, F.lit("/"), x))
    parts = F.aggregate(F.slice(F.split(whole, "/"), 2, 1 << 30), F.lit(""), step)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("#") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("?"), F.concat(site, page, to))
        .otherwise(F.concat(site, parts, rest))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) in normal form from each url to all targets that its page names."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    named = pages.filter(url.contains("://") & html.rlike("(?i)canonical|refresh"))
    found = lambda tag, mark, where: F.transform(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(mark)), lambda t: F.regexp_extract(t, where, 1))
    links = named.select(url.alias("url"), F.explode(F.concat(found(_LINK_TAG, _IS_CANONICAL, _HREF), found(_META_TAG, _IS_REFRESH, _CONTENT))).alias("to")).filter("to != ''")
    links = links.withColumn("to", F.regexp_replace("to", "(?i)&(amp|#38|#x26);", "&"))
    return links.select(normal_form(F.col("url")).alias("a"), normal_form(resolve(F.col("url"), F.col("to"))).alias("b")).filter("b is not null")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. ``redirects``: further edges, columns a and b."""
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(normal_form(F.col("a")).alias("a"), normal_form(F.col("b")).alias("b")))
    member = stash(connected_components(edges))
    node = F.col("node")
    # targets that are no page of the table are judged too: a block on one reaches its aliases
    judged = member.withColumn("v", rule_of(host_of(node), path_of(node), rules)["verdict"])
    blocked = judged.groupBy("component").agg(F.max(F.col("v") == "block").alias("has_block"), F.max(F.col("v") == "allow").alias("has_allow"))
    carried = blocked.filter("has_block and not coalesce(has_allow, false)").select("component")
    hit = member.join(carried, "component").select(F.col("node").alias("normal"), F.lit("block").alias("carried"))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), normal_form(url).alias("normal"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return rows.join(hit, "normal", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), F.col("carried"), F.lit("allow")).alias("verdict"))
