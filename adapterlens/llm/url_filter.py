"""URL filtering with redirect equivalence, in DataFrame functions only.

Addresses joined by redirects and canonical links form one class (distributed connected
components). A rule decides for the addresses it fits; its block spreads to the aliases in the
class, unless an explicit allow rule fits the alias itself or any other member of the class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import ascii_lower, broadcast_if_small, connected_components, cut, join_counted, table

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Up to this many rules are held in the expression; more are joined on the host's suffixes.
RULES_INLINE = 200

# A tag ends before the next one begins, so that a scan of a page never goes over a place twice.
LINK, CANONICAL = r"(?i)<link\b[^<>]*>", r"""(?i)\brel\s*=\s*["']?canonical\b"""
META, REFRESH = r"(?i)<meta\b[^<>]*>", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?i)\burl\s*=\s*['"]?([^"'\s>;]+)"""


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and node of the address in column `url`.

    host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there
    up to `?`, `#` or the end; both empty without `://`. node names the address: host, path and
    query (scheme and fragment do not matter); null without a host.
    """
    at = F.instr(url, "://")
    df = df.withColumn("_rest", F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(""))
    df = df.withColumn("host", ascii_lower(F.regexp_extract("_rest", r"^([^/?#]*)", 1)))
    df = df.withColumn("_tail", F.regexp_extract("_rest", r"^[^/?#]*([^#]*)", 1))
    return df.withColumn("path", F.regexp_extract("_tail", r"^([^?]*)", 1)).withColumn(
        "node", F.when(F.col("host") != "", F.concat("host", F.when(F.col("_tail") == "", "/").otherwise(F.col("_tail"))))
    ).drop("_rest", "_tail")


def _edges(df: DataFrame) -> DataFrame:
    """Rows a, b with both ends known. The generator keeps filters from being copied into the address functions."""
    return df.select(F.inline(F.array(F.struct("a", "b")))).where("a is not null and b is not null")


def page_links(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges of pages: a, b are node names.

    Of each kind, a page's first link counts. Relative targets are read from the page's folder.
    """
    html = F.coalesce("html", F.lit(""))
    first = lambda tag, kind: F.get(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.rlike(t, F.lit(kind))), F.lit(0))
    tags = F.array(
        F.struct(F.coalesce(first(LINK, CANONICAL), F.lit("")).alias("tag"), F.lit(HREF).alias("at")),
        F.struct(F.coalesce(first(META, REFRESH), F.lit("")).alias("tag"), F.lit(REFRESH_URL).alias("at")),
    )
    found = pages.select("url", F.explode(tags).alias("t")).where("t.tag <> ''")
    found = found.select("url", F.expr("regexp_replace(regexp_extract(t.tag, t.at, 1), '&amp;', '&')").alias("target")).where("target <> ''")
    source = with_parts(found).withColumn("base", F.concat(F.lit("http://"), F.col("host")))
    target, folder = F.col("target"), F.regexp_replace("path", r"[^/]*$", "")
    whole = (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat("base", target))
        .otherwise(F.concat("base", F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), target))
    )
    ends = source.select(F.col("node").alias("a"), whole.alias("whole"))
    return _edges(with_parts(ends, "whole").select("a", F.col("node").alias("b")))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict); null if none does."""
    table = F.array(
        *[
            F.when(
                ((host == h) | host.endswith("." + h)) & path.startswith(p),
                F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
            )
            for v, h, p in rules
        ]
    )
    return F.array_max(table)


def resolved(rules: list | DataFrame) -> list | DataFrame:
    """The rules with each (host, path) once: of equal ones with both verdicts, allow holds."""
    if isinstance(rules, DataFrame):
        return rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select("verdict", "host", "path")
    return [(v, h, p) for (h, p), v in dict(sorted({((h, p), v) for v, h, p in rules}, key=lambda r: r[1], reverse=True)).items()]


def join_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """For large rule sets: add column `rule` as above to df(node, host, path, ...).

    rules: verdict, host, path, each (host, path) once. Each address offers the suffixes of its host,
    and for each suffix that has rules the prefixes of its path of the lengths that they have; one row
    per node comes back.
    """
    rules = cut(rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = cut(rules.groupBy(F.col("host").alias("_h")).agg(F.collect_set(F.length("path")).alias("_lengths")))
    keyed = df.select("node", F.explode(suffixes).alias("_h"), "path").join(broadcast_if_small(hosts, hosts.count()), "_h")
    fitting = F.filter("_lengths", lambda n: n <= F.length("path"))
    keyed = keyed.select("node", "_h", F.explode(F.transform(fitting, lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("_p"))
    best = F.max(F.struct(F.length(F.concat("_h", "_p")).alias("size"), F.concat("_h", "_p").alias("rule"), "verdict"))
    named = broadcast_if_small(rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict"), rules.count())
    return df.join(keyed.join(named, ["_h", "_p"]).groupBy("node").agg(best.alias("rule")), "node", "left")


def _judged(nodes: DataFrame, rules: list | DataFrame) -> DataFrame:
    """node -> node, rule struct."""
    parts = nodes.select("node", F.regexp_extract("node", r"^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    if isinstance(rules, DataFrame):
        return join_rules(parts, rules).select("node", "rule")
    return parts.select("node", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"))


def judge_urls(pages: DataFrame, rules: list | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every row of pages(page_id, url, html).

    rules: list of (verdict, host, path prefix), or a DataFrame of them when there are over
    `RULES_INLINE`; of equal ones with both verdicts, allow holds. redirects: further edges src, dst as addresses. Returns page_id, host, path,
    rule, verdict, decided_by (`rule`, `class` or `default`), one row per row of `pages`.

    Null urls and urls without `://` have an empty host and path, fit no rule, belong to no class
    and are allowed. A null html has no links. Repeated rows are judged alike. Further columns of
    `pages` are ignored. An empty table gives an empty result.
    """
    if isinstance(rules, list) and len(rules) > RULES_INLINE:
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = resolved(rules)
    edges = page_links(pages)
    if redirects is not None:
        known = with_parts(with_parts(redirects.select("src", "dst"), "src").withColumnRenamed("node", "a").drop("host", "path"), "dst")
        edges = edges.unionByName(_edges(known.select("a", F.col("node").alias("b"))))
    linked = connected_components(edges)
    members = cut(linked.unionByName(linked.select(F.col("root").alias("node"), "root")).distinct())
    ruled = members.join(_judged(members.select("node").distinct(), rules), "node")
    verdict = F.col("rule.verdict")
    classes = cut(ruled.groupBy("root").agg(F.max(verdict == "block").alias("blocked"), F.max(verdict == "allow").alias("allowed"), F.count("*").alias("n")))
    # A class may hold a third of all addresses: members of large ones do not meet on the root.
    by_class = join_counted(members, classes, ["root"], members.count()).select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("spread"))

    rows = with_parts(pages.select("page_id", "url")).drop("url")
    if isinstance(rules, DataFrame):
        rows = rows.join(_judged(rows.select("node").where("node is not null").distinct(), rules), "node", "left")
    else:
        rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(by_class, "node", "left")
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("rule.rule").alias("rule"),
        F.coalesce("rule.verdict", "spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("spread").isNotNull(), "class").otherwise("default").alias("decided_by"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url. Nulls, repeats, further columns: as `judge_urls` says."""
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql_url(url: str) -> dict[str, str]:
    rest = f"(case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end)"
    ascii_ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    host = f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), {ascii_}), '')"
    tail = f"regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"
    path = f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"
    node = f"case when {host} <> '' then {host} || case when {tail} = '' then '/' else {tail} end end"
    return {"host": host, "path": path, "node": node}


def _sql_rule(host: str, path: str) -> str:
    cases = []
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        cases.append(f"when ({host} = '{h}' or {host} like '%.{h}') and starts_with({path}, '{p}') then '{v} {h}{p}'")
    return "case " + " ".join(cases) + " end"


def op4_sql() -> str:
    u, t = _sql_url("url"), _sql_url("target")
    quote = lambda x: x.replace("'", "''")
    return f"""
with recursive raw as (
  select url, unnest([
    regexp_extract(list_filter(regexp_extract_all(coalesce(html, ''), '{quote(LINK)}'), lambda t: regexp_matches(t, '{quote(CANONICAL)}'))[1], '{quote(HREF)}', 1),
    regexp_extract(list_filter(regexp_extract_all(coalesce(html, ''), '{quote(META)}'), lambda t: regexp_matches(t, '{quote(REFRESH)}'))[1], '{quote(REFRESH_URL)}', 1)]) as link
  from pages),
whole as (
  select url, case when contains(l, '://') then l
    when starts_with(l, '//') then 'http:' || l
    when starts_with(l, '/') then 'http://' || {u['host']} || l
    else 'http://' || {u['host']} || coalesce(nullif(regexp_replace({u['path']}, '[^/]*$', ''), ''), '/') || l end as target
  from (select url, replace(link, '&amp;', '&') as l from raw where link <> '')),
edge as (select distinct {u['node']} as a, {t['node']} as b from whole),
both_ways as (select a, b from edge where a is not null and b is not null union select b, a from edge where a is not null and b is not null),
reach(node, other) as (
  select a, a from both_ways
  union select r.node, e.b from reach r join both_ways e on e.a = r.other),
ruled as (
  select node, other, {_sql_rule("regexp_extract(other, '^([^/?]*)', 1)", "regexp_extract(other, '^[^/?]*([^?]*)', 1)")} as rule from reach),
spread as (
  select node, case when bool_or(rule like 'allow %') then 'allow' when bool_or(rule like 'block %') then 'block' end as verdict
  from ruled group by node),
p as (select page_id, {u['host']} as host, {u['path']} as path, {u['node']} as node from pages),
q as (select p.*, {_sql_rule('host', 'path')} as own from p)
select q.page_id, q.host, q.path, substr(own, 7) as rule,
  coalesce(substr(own, 1, 5), s.verdict, 'allow') as verdict,
  case when own is not null then 'rule' when s.verdict is not null then 'class' else 'default' end as decided_by
from q left join spread s on s.node = q.node
"""
