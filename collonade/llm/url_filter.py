"""URL filters with redirect equivalence.

Rules (verdict, host, path) decide the URLs that they fit: those of the rule's host
and its subdomains whose path starts with the rule's.  The longest rule wins.  URLs
without a rule take part in a graph of aliases: an edge joins a page's URL with the
target of its canonical link and of its redirect (a refresh in its head, or a row of
a table of redirects).  Connected components over these edges, found by rounds of
joins until nothing changes, are what one document is reachable as.  A component
with an explicitly allowed URL allows the rest of its URLs, else one with an explicitly
blocked URL blocks them; allow has precedence, so that a blocked page can't take an
allowed site's aliases with it by naming that site as its canonical form.  A URL's
own rule is never overruled.  What no rule reaches is allowed.

A node is a host, path and query: the scheme and the fragment name no other
document.  Targets needn't be pages themselves, and carry their rules all the same.
Components are of URLs that have an edge; no URL or component is collected.

All of it is DataFrame and SQL functions.

Defined results: a null URL or one without "://" has the empty host and path, no
rule and no alias; a null html has no edges; relative targets are resolved against the
page's URL; targets that are not http(s) or have no host are left out; repeated rows
and repeated edges are judged alike; an empty table gives no rows; texts are read
whole; only page_id, url and html are read, so other names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import join_sized, keep
from collonade.llm.simhash import components

#: Verdict, host and path, as the query's contract states them.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """host, path and query as one text; null for a URL without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does."""
    kind = "struct<rule:string,verdict:string>"
    found = F.lit(None).cast(kind)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")).cast(kind)).otherwise(found)
    return found


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    start = F.array().cast("array<string>")
    last = F.element_at(F.split(path, "/"), -1)
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(a)
    kept = F.aggregate(F.split(path, "/"), start, lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def resolved(url: Column, target: Column) -> Column:
    """target, which may be relative to url, as http://..., or null if it is no web address."""
    target = F.regexp_replace(F.trim(F.replace(target, F.lit("&amp;"), F.lit("&"))), r"[\t\r\n]", "")
    base, query = F.concat(F.lit("http://"), host_of(url)), F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"(?i)^https?://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(target, F.lit("/")), F.concat(base, without_dots(path), query))
        .when(path == "", F.concat(base, path_of(url), query))
        .otherwise(F.concat(base, without_dots(F.concat(folder, path)), query))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not; empty without one."""
    value = lambda end: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{end}", 1)
    return F.coalesce(*[F.nullif(value(end), F.lit("")) for end in (r'"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))


def targets_of(html: Column) -> Column:
    """The targets of a page's canonical links and refreshes, as they are written; not those in comments."""
    live = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(live, F.lit(r"(?i)(<(?:link|meta)[\s/][^>]*>)"), 1)
    refresh = lambda t: F.regexp_extract(attribute(t, "content"), r"(?is)^[\s0-9.]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
    canonical = lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical")
    found = F.transform(tags, lambda t: F.when(canonical(t), attribute(t, "href")).when(F.lower(attribute(t, "http-equiv")) == "refresh", refresh(t)).otherwise(F.lit("")))
    return F.filter(found, lambda x: x != "")


def edges_of(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): nodes of URLs that are one document, by canonical links, refreshes and rows (source, target) of redirects."""
    named = F.col("html").rlike("(?i)canonical|refresh")  # most pages have neither and are not read further
    given = pages.where(named).select("url", F.explode(targets_of(F.col("html"))).alias("target"))
    if redirects is not None:
        given = given.union(redirects.select("source", "target"))
    return given.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("target"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def aliases(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(node, verdict): what the rules of its component give to each node that has an edge; null if they give nothing."""
    edges = keep(edges_of(pages, redirects), "alias-edges")
    roots = components(edges)
    members = keep(roots.union(roots.select("root", "root")).distinct(), "aliases")
    url = F.concat(F.lit("http://"), F.col("node"))
    own = members.select("root", rule_of(host_of(url), path_of(url), rules)["verdict"].alias("own"))
    told = own.where("own IS NOT NULL").groupBy("root").agg(F.min("own").alias("verdict"))  # allow comes before block
    return keep(members.join(told, "root").select("node", "verdict"), "alias-verdicts")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, by): by tells whether a rule, an alias or the default decided."""
    told = aliases(pages, redirects, rules)
    own = pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = own.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    joined = join_sized(judged, told.withColumnRenamed("verdict", "alias"), "node", "left")
    by = F.when(F.col("_r").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return joined.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "alias", F.lit("allow")).alias("verdict"), by.alias("by"))


def digests(judged: DataFrame) -> DataFrame:
    """What op12 returns."""
    return judged.select("page_id", "host", "path", "rule", "verdict")


#: The same in SQL, for canonical links and refreshes whose targets are written out from their scheme or host.
SQL = r"""
WITH RECURSIVE urls AS (SELECT page_id, html, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query FROM pages),
tags AS (SELECT host || path || query AS a, host, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?i)<(?:link|meta)[\s/][^>]*>')) AS tag FROM urls WHERE host <> '' AND regexp_matches(html, '(?i)canonical|refresh')),
named AS (SELECT a, host, CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*[''"]?([^"''\s>]+)', 1) ELSE '' END AS t FROM tags),
whole AS (SELECT a, CASE WHEN t LIKE '//%' THEN 'http:' || t WHEN t LIKE '/%' THEN 'http://' || host || t ELSE t END AS t FROM named WHERE t <> ''),
edges AS (SELECT a, lower(regexp_extract(t, '^https?://([^/?#]*)', 1)) || regexp_extract(t, '^https?://[^/?#]*([^#]*)', 1) AS b FROM whole WHERE t SIMILAR TO 'https?://[^/?#].*'),
linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a, a AS z FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.z = linked.a),
rules AS (SELECT unnest(['allow', 'block', 'block', 'allow', 'block']) AS verdict, unnest(['org', 'example.org', 'example.org', 'com', 'com']) AS h, unnest(['/', '/es/', '/en/1', '/fr/', '/de/']) AS p),
nodes AS (SELECT DISTINCT z, regexp_extract(z, '^([^/?#]*)', 1) AS host, regexp_extract(z, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
judged AS (SELECT z, arg_max(verdict, length(h || p)) AS own FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY z),
told AS (SELECT a AS node, min(own) AS alias FROM reach JOIN judged USING (z) GROUP BY a),
numbered AS (SELECT row_number() OVER () AS i, * FROM urls),
ruled AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS own FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(own, alias, 'allow') AS verdict FROM numbered LEFT JOIN ruled USING (i) LEFT JOIN told ON told.node = host || path || query"""
