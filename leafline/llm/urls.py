"""URL filters that hold for every alias of a page.

Block and allow rules name a host, all its subdomains and a path prefix; the longest rule that
fits a URL decides. A URL without a rule takes the decision of its aliases: redirect and
canonical-link edges make classes of equivalent URLs (connected components, in DataFrame
operations only), and within a class an explicit allow precedes any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Beyond its scheme: host, path, query. A fragment never reaches a server and is left out.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[0-9.\s]*;\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def node_of(url: Column) -> Column:
    """One name for a URL whatever its scheme and fragment; null where there is no ``://``."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), F.regexp_extract(url, PARTS, 3)))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(action, rule) of the longest fitting rule (action, host, path), or null; an allow wins a tie."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of the canonical links and refresh redirects that pages state."""
    url, html = F.col(url_col), F.col(html_col)
    found = pages.where(html.rlike(r"(?i)canonical|refresh")).select(url.alias("url"), F.explode(F.array(F.regexp_extract(html, LINK, 1), F.regexp_extract(html, REFRESH, 1))).alias("to")).where("to <> ''")
    base = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    to = F.col("to")
    full = F.when(F.instr(to, "://") > 0, to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(base, to)).otherwise(F.concat(F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1), to))
    return found.select(node_of(F.col("url")).alias("src"), node_of(full).alias("dst"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict (allow or block).

    redirects: further (src, dst) URLs. A page without a rule is blocked if one of its aliases is
    blocked by a rule and none is allowed by one; else it is allowed.

    Defined cases: a null URL or one without ``://`` has empty host and path, no rule and no
    aliases, and is allowed; null html states no links; repeated rows repeat; other columns are
    not read; an empty table gives no rows.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    members = connected_components(edges, "src", "dst")
    path = F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    action = fitting_rule(F.regexp_extract("node", r"(?s)^([^/?]*)", 1), path, rules)["action"]
    by_class = members.withColumn("action", action).groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    by_node = staged(members.join(by_class, "component").where("blocked and not coalesce(allowed, false)").select("node", F.lit("block").alias("aliases")))
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return own.withColumn("fit", fit).join(by_node, "node", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", "aliases", F.lit("allow")).alias("verdict"))
