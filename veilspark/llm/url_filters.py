"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest that fits a URL decides it.  URLs that no
rule fits take the decision of their aliases: URLs are joined by the canonical links and
refresh redirects in the pages (and by a table of redirects, where one is given) into connected
components, and a component with an explicit allow allows the rest of it, else one with an
explicit block blocks it.  A URL that a rule fits is never overruled by its aliases.

Defined results: a URL that is null or has no "://" has an empty host and path, fits no
rule and has no aliases; what is neither ruled nor linked is allowed; repeated rows are
judged alike; a null html has no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import fresh, lower_ascii, materialize
from veilspark.llm.graph import connected_components

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Up to so many rules are one expression of the projection; more are joined by host.
COMPILED = 200


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What tells pages apart: host, path and query; null for no URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def decide(pairs: DataFrame, rules: Sequence[tuple[str, str, str]], host: str, path: str) -> DataFrame:
    """The table with ``rule`` and ``ruled`` (null where no rule fits) by columns of those names."""
    if len(rules) <= COMPILED:
        longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]))
        h, p = F.col(host), F.col(path)
        fit = lambda r: ((h == r[0]) | h.endswith("." + r[0])) & p.startswith(r[1])
        found = F.lit(None).cast("struct<rule:string,ruled:string>")
        for r in reversed(longest):
            found = F.when(fit(r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("ruled"))).otherwise(found)
        return pairs.withColumns({"rule": found["rule"], "ruled": found["ruled"]})
    spark = pairs.sparkSession
    known = spark.createDataFrame([(a, b, c, len(a + b), len(a)) for a, b, c in rules], "rule_host string, rule_path string, verdict string, n int, m int")
    parts = F.split(F.col(host), "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    seen = pairs.select(host, path).distinct()
    best = (
        seen.withColumn("rule_host", F.explode(ends))
        .join(known, "rule_host")
        .filter(F.col(path).startswith(F.col("rule_path")))
        .groupBy(host, path)
        .agg(F.max(F.struct("n", "m", F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("a"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("ruled"))).alias("best"))
    )
    best = materialize(best.select(host, path, "best.rule", "best.ruled"), "best")
    return pairs.join(best, [host, path], "left")


def page_links(url: Column, html: Column) -> Column:
    """Absolute targets of canonical links and refresh redirects of a page."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b"""))
    href = lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    target = lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*['"]?([^"'>\s]+)""", 1)
    bare = lambda s: F.regexp_replace(s, r"""(?is)^href\s*=\s*["']?|["']$""", "")
    found = F.concat(F.transform(canonical, lambda t: bare(href(t))), F.transform(refresh, target))
    found = F.transform(found, lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&")))
    origin, folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = lambda x: (
        F.when(F.instr(x, "://") > 0, x)
        .when(x.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), x))
        .when(x.startswith("/"), F.concat(origin, x))
        .otherwise(F.concat(origin, folder, x))
    )
    return F.transform(F.filter(found, lambda x: x != ""), whole)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, url_column: str = "url", html_column: str = "html", default: str = "allow") -> DataFrame:
    """Host, path, rule, verdict and ``component`` of every page, beside its other columns but html.

    ``redirects``: a table (src, dst) of URLs.  Columns of the table that bear one of these
    names are replaced.
    """
    url = F.col(f"`{url_column}`")
    links = pages.filter(F.coalesce(F.col(f"`{html_column}`").rlike(r"(?i)canonical|refresh"), F.lit(False))).select(url.alias("src"), F.explode(page_links(url, F.col(f"`{html_column}`"))).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    own = ("host", "path", "rule", "verdict", "component")
    node = fresh(pages, "node")
    edges = materialize(links.select("src", "dst").filter("src is not null and dst is not null").distinct(), "links")
    base = pages.select(*[f"`{c}`" for c in pages.columns if c != html_column and c.lower() not in own], host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias(node))
    base = decide(base, rules, "host", "path")
    parts = connected_components(edges.select(address_of(F.col("src")).alias("a"), address_of(F.col("dst")).alias("b")))
    members = materialize(parts.select("node", "component").union(parts.select(F.col("component").alias("node"), "component").distinct()), "members")
    # Rules also decide aliases that are no page of the table.
    urls = edges.select(F.explode(F.array("src", "dst")).alias("u")).select(address_of(F.col("u")).alias("node"), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    known = decide(urls.distinct(), rules, "host", "path").filter("ruled is not null")
    told = known.join(members, "node").groupBy("component").agg(F.max((F.col("ruled") == "allow").cast("int")).alias("allows"))
    by_node = materialize(
        members.join(materialize(told, "told"), "component", "left").select(F.col("node").alias(node), "component", F.when(F.col("allows") == 1, "allow").when(F.col("allows") == 0, "block").alias("alias")), "by_node"
    )
    # What has no address can't be linked, and stays out of the join: it would meet under one key.
    bare = base.filter(F.col(node).isNull()).withColumns({"component": F.lit(None).cast("string"), "alias": F.lit(None).cast("string")})
    out = base.filter(F.col(node).isNotNull()).join(by_node, node, "left").unionByName(bare)
    return out.withColumn("verdict", F.coalesce("ruled", "alias", F.lit(default))).drop(node, "ruled", "alias")


def verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return judge(pages.select("page_id", "url", "html"), rules).select("page_id", "host", "path", "rule", "verdict")


#: Rules, and aliases by canonical links and refresh redirects; links are read as page_links() reads them.
SQL = r"""
with recursive tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as tag from pages where regexp_matches(html, '(?i)canonical|refresh')),
raw as (
  select url, trim(regexp_replace(regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), '(?is)^href\s*=\s*["'']?|["'']$', '', 'g')) as target
  from tags where regexp_matches(tag, '(?is)^<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
  union all select url, trim(regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^"''>\s]+)', 1)) from tags where regexp_matches(tag, '(?is)^<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b')),
links as (
  select distinct url as src, case when contains(t, '://') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t
      when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
      else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)?', 1), ''), '/') || t end as dst
  from (select url, replace(target, '&amp;', '&') as t from raw) where t <> '' and url is not null),
u as (select distinct url from pages where url is not null
  union select distinct dst from links),
parts as (
  select url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) as rest from u),
named as (select *, case when contains(url, '://') then host || case when rest = '' then '/' when starts_with(rest, '?') then '/' || rest else rest end end as node from parts),
r(h, q, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ruled as (
  select url, host, path, node, max_by(h || q, length(h || q)) as rule, max_by(v, length(h || q)) as ruled
  from named left join r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.q) group by all),
edges as (select a.node as a, b.node as b from links join named a on a.url = src join named b on b.url = dst where a.node is not null and b.node is not null),
sides as (select a, b from edges union select b, a from edges),
reach as (select a as node, a as other from sides union select reach.node, sides.b from reach join sides on sides.a = reach.other),
alias as (
  select reach.node, case when bool_or(k.ruled = 'allow') then 'allow' when bool_or(k.ruled = 'block') then 'block' end as verdict
  from reach left join (select node, ruled from ruled where ruled is not null and url in (select src from links union select dst from links)) k on k.node = reach.other group by 1)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(ruled, verdict, 'allow') as verdict
from pages left join ruled using (url) left join alias using (node)
"""
