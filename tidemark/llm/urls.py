"""Block and allow rules on URLs, passed on to the other addresses of the same page.

Built-in functions only. Addresses are nodes, redirects and canonical links are
edges, and a blocked address blocks its whole component unless an address of it
is explicitly allowed.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, query, table
from .components import connected_components

#: Fixed values of the contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_HOST = r"://([^/?#]*)"
_PATH = r"://[^/?#]*([^?#]*)"
_QUERY = r"^[^#]*?\?([^#]*)"
_LINK = r"(?i)<link\b[^>]*>"
_IS_CANONICAL = r"(?i)\brel\s*=\s*[\x22']?canonical\b"
_HREF = r"(?i)\bhref\s*=\s*[\x22']?([^\x22'\s>]+)"
_META = r"(?i)<meta\b[^>]*>"
_IS_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\x22']?refresh\b"
_TARGET = r"(?i)\burl\s*=\s*[\x22']?([^\x22'\s>]+)"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def address(url: Column) -> Column:
    """What all spellings of one address share: no scheme, fragment, last slash or campaign parameters. Null without a host."""
    params = F.array_join(F.filter(F.split(F.regexp_extract(url, _QUERY, 1), "&"), lambda p: ~p.startswith("utm_")), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise("")))


def link_targets(url: Column, html: Column) -> Column:
    """Absolute targets of canonical links and refresh redirects in a page."""
    links = F.filter(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: t.rlike(_IS_CANONICAL))
    metas = F.filter(F.regexp_extract_all(html, F.lit(_META), F.lit(0)), lambda t: t.rlike(_IS_REFRESH))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, _HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, _TARGET, 1)))
    site = F.concat(F.regexp_extract(url, r"^([^:]*)://", 1), F.lit("://"), F.regexp_extract(url, _HOST, 1))
    whole = lambda t: F.when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(site, t)).otherwise(t)
    return F.when(html.isNotNull(), F.filter(F.transform(found, whole), lambda t: t.contains("://")))


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Add ``rule`` and ``_verdict`` of the longest rule that fits ``host`` and ``path``; null where none does.

    Rules are looked up once per distinct host, by the host and each of its
    parent domains, so a hot host is one row here.
    """
    spark = df.sparkSession
    given = spark.createDataFrame([(h, p, h + p, v) for v, h, p in rules], "_parent string, _start string, rule string, _verdict string")
    hosts = df.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # The rules are a list the caller holds in memory.
    fitting = hosts.select("host", F.explode(parents).alias("_parent")).join(F.broadcast(given), "_parent")
    best = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "_start", "_verdict")))
    per_host = cut(fitting.groupBy("host").agg(best.alias("_rules")))
    first = F.get(F.filter("_rules", lambda r: F.col("path").startswith(r["_start"])), F.lit(0))
    return df.join(per_host, "host", "left").withColumn("_r", first).select(*df.columns, F.col("_r.rule").alias("rule"), F.col("_r._verdict").alias("_verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, component_rule.

    An address with a rule keeps the rule's verdict. Another is allowed if any
    address of its component is explicitly allowed, else blocked if any is
    blocked, else allowed. Edges join a page's address to the targets of its
    canonical links and refresh redirects, which need not be pages themselves;
    spellings of one address that differ in scheme, fragment, last slash or
    campaign parameters are one node.

    A null url, or one without ``://``, has an empty host and path, no rule, and
    is allowed. A null html has no links. Repeated rows are judged one by one;
    other columns are ignored.
    """
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("_node"), link_targets(url, F.col(html_col)).alias("_targets"))
    slim = cut(slim)
    judged = cut(with_rules(slim.drop("_targets"), rules))
    links = slim.select("_node", F.explode("_targets").alias("_t"))
    links = cut(links.select("_node", address(F.col("_t")).alias("_to"), host_of(F.col("_t")).alias("host"), path_of(F.col("_t")).alias("path")).where("_node IS NOT NULL AND _to IS NOT NULL"))
    decided = judged.where("rule IS NOT NULL AND _node IS NOT NULL").select("_node", "_verdict", "rule")
    parts = None
    if not links.isEmpty():
        named = with_rules(links, rules).where("rule IS NOT NULL").select(F.col("_to").alias("_node"), "_verdict", "rule")
        decided = decided.unionByName(named)
        parts = connected_components(links.select(F.col("_node").alias("a"), F.col("_to").alias("b"))).select(F.col("node").alias("_node"), F.col("component").alias("_c"))
        decided = _in_component(decided, parts)
        judged = _in_component(judged, parts)
    else:
        decided = decided.withColumn("_c", F.col("_node"))
        judged = judged.withColumn("_c", F.col("_node"))
    # One row per component with a decision, counted before the shuffle.
    each = decided.groupBy("_c").agg(F.min(F.struct("_verdict", "rule")).alias("_best"))
    # "allow" sorts before "block", so an explicit allow wins.
    each = cut(each.select("_c", F.col("_best._verdict").alias("_given"), F.col("_best.rule").alias("component_rule")))
    out = judged.join(each, "_c", "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", "_given", F.lit("allow")).alias("verdict"), "component_rule")


def _in_component(df: DataFrame, parts: DataFrame) -> DataFrame:
    return df.join(parts, "_node", "left").withColumn("_c", F.coalesce("_c", "_node"))


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _address_sql(url: str) -> str:
    params = f"array_to_string([p FOR p IN string_split(regexp_extract({url}, '{_QUERY}', 1), '&') IF NOT starts_with(p, 'utm_')], '&')"
    host = f"translate(regexp_extract({url}, '{_HOST}', 1), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_replace(regexp_extract({url}, '{_PATH}', 1), '/+$', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END END"


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    tags = lambda tag, keep, take: f"[regexp_extract(t, '{q(take)}', 1) FOR t IN regexp_extract_all(html, '{q(tag)}') IF regexp_matches(t, '{q(keep)}')]"
    rules = ", ".join(f"('{v}', '{h}', '{p}', '{h + p}')" for v, h, p in RULES)
    fit = lambda host, path: f"({host} = r.h OR ends_with({host}, '.' || r.h)) AND starts_with({path}, r.p)"
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '{_HOST}', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '{_PATH}', 1), '')"
    return f"""
    WITH RECURSIVE rules(v, h, p, rule) AS (VALUES {rules}),
    p AS (SELECT row_number() OVER () AS n, page_id, url, html, {host('url')} AS host, {path('url')} AS path, {_address_sql('url')} AS node FROM pages),
    j AS (SELECT p.n, page_id, node, host, path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.v, length(r.rule)) AS v
          FROM p LEFT JOIN rules r ON {fit('host', 'path')} GROUP BY ALL),
    found AS (SELECT node, url, unnest(list_concat({tags(_LINK, _IS_CANONICAL, _HREF)}, {tags(_META, _IS_REFRESH, _TARGET)})) AS t FROM p),
    whole AS (SELECT node, CASE WHEN starts_with(t, '//') THEN 'http:' || t
                                WHEN starts_with(t, '/') THEN regexp_extract(url, '^([^:]*)://', 1) || '://' || regexp_extract(url, '{_HOST}', 1) || t
                                ELSE t END AS t FROM found),
    e AS (SELECT DISTINCT node, {_address_sql('t')} AS target, {host('t')} AS host, {path('t')} AS path FROM whole WHERE contains(t, '://')),
    given AS (SELECT node, v, rule FROM j WHERE rule IS NOT NULL AND node IS NOT NULL
              UNION SELECT target, arg_max(r.v, length(r.rule)), arg_max(r.rule, length(r.rule)) FROM e JOIN rules r ON {fit('e.host', 'e.path')} GROUP BY target, e.host, e.path),
    both_ways AS (SELECT node AS a, target AS b FROM e UNION SELECT target, node FROM e),
    reach(a, b) AS (SELECT DISTINCT node, node FROM p WHERE node IS NOT NULL UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
    best AS (SELECT a, min({{'v': v, 'rule': rule}}) AS m FROM reach JOIN given ON b = given.node GROUP BY a)
    SELECT page_id, host, path, rule, coalesce(v, m.v, 'allow') AS verdict, m.rule AS component_rule
    FROM j LEFT JOIN best ON j.node = best.a
    """


@query("op2_url_filters", _sql())
def op2_url_filters(spark, sf):
    return judge_urls(table(spark, sf, "pages"))
