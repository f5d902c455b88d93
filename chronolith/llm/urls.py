r"""URL filters with redirect equivalence, JVM-side.

Rules block or allow a host with its subdomains below a path prefix; the longest wins. Pages that no rule fits take the
verdict of their aliases: urls joined by redirects (meta refresh), canonical links or the same normal form (without scheme,
fragment, tracking parameters and trailing slash) are one component. An explicit allow in it stops the block that
another alias's rule would propagate; otherwise one block blocks all.

Defined results: a null url or one without "://" has an empty host and path, no aliases, and is allowed unless a rule fits;
null html has no links; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace
from chronolith.llm.graph import components

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
GOES = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def normal(url: Column) -> Column:
    """What equal addresses share; null without a host."""
    host, path = parts(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(base: Column, link: Column) -> Column:
    """An absolute url of a link on a page."""
    scheme = F.regexp_extract(base, "^[^:/?#]*", 0)
    root = F.regexp_extract(base, "^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    full = F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), link))
    return F.when(link != "", full)


def fits(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its action. The rules are a constant list, folded into the expression."""
    rule = action = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fit = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fit, h + p).otherwise(rule), F.when(fit, verdict).otherwise(action)
    return rule, action


def judge(pages: DataFrame, id_col: str, url_col: str, html_col: str, ws: Workspace, rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict, component) per page."""
    url = F.col("url")
    host, path = parts(url)
    rule, action = fits(F.col("host"), F.col("path"), rules)
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.regexp_extract(F.regexp_extract(html, LINK, 0), HREF, 1).alias("canonical"), F.regexp_extract(F.regexp_extract(html, META, 0), GOES, 1).alias("redirect"))
    base = base.withColumns({"host": host, "path": path, "node": normal(url)}).withColumns({"rule": rule, "action": action, "to1": resolve(url, F.col("canonical")), "to2": resolve(url, F.col("redirect"))})
    base = ws.save(base.select("id", "host", "path", "node", "rule", "action", "to1", "to2"), "pages")
    links = base.where("node is not null and (to1 is not null or to2 is not null)").select("node", F.explode(F.array_compact(F.array("to1", "to2"))).alias("url"))
    host, path = parts(url)
    goal = links.withColumns({"host": host, "path": path, "goal": normal(url)}).withColumn("action", fits(F.col("host"), F.col("path"), rules)[1]).where("goal is not null")
    said = base.where("node is not null").select("node", "action").unionByName(goal.select(F.col("goal").alias("node"), "action"))
    marks = said.groupBy("node").agg(F.max(F.col("action") == "block").alias("block"), F.max(F.col("action") == "allow").alias("allow"))
    edges = goal.select(F.col("node").alias("a"), F.col("goal").alias("b"))
    cc = components(edges, ws, "aliases")
    named = marks.join(cc, "node", "left").select("node", "block", "allow", F.coalesce("component", "node").alias("component"))
    whole = named.groupBy("component").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    marks = named.select("node", "component").join(whole, "component")
    free = F.when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow")
    # Only pages that no rule fits need their aliases; the others skip the join.
    done = base.where("rule is not null").select("id", "host", "path", "rule", F.col("action").alias("verdict"))
    rest = base.where("rule is null").select("id", "host", "path", "rule", "node").join(marks, "node", "left")
    return done.unionByName(rest.select("id", "host", "path", "rule", free.alias("verdict")))


def op6(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, "page_id", "url", "html", Workspace(spark, "urls")).withColumnRenamed("id", "page_id")


def _sql() -> str:
    def parts_of(u: str) -> str:
        rest = f"case when strpos({u}, '://') > 0 then substr({u}, strpos({u}, '://') + 3) else '' end"
        raw = f"regexp_extract({rest}, '^[^/?#]*')"
        return f"translate({raw}, '{UPPER}', '{LOWER}') as host, regexp_extract(substr({rest}, length({raw}) + 1), '^[^?#]*') as path"

    rule = act = "null"
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fit = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        rule, act = f"case when {fit} then '{h}{p}' else {rule} end", f"case when {fit} then '{v}' else {act} end"
    query = f"regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '{TRACKING}', '', 'g'), '^&', '')"
    node = f"case when host <> '' then host || regexp_replace(path, '/+$', '') || case when {query} <> '' then '?' || {query} else '' end end"

    def to(link: str) -> str:
        root, folder = "regexp_extract(url, '^[^:/?#]*://[^/?#]*')", "regexp_extract(url, '^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
        return f"case when {link} = '' then null when contains({link}, '://') then {link} when starts_with({link}, '//') then regexp_extract(url, '^[^:/?#]*') || ':' || {link} when starts_with({link}, '/') then {root} || {link} else {folder} || case when ends_with({folder}, '/') then '' else '/' end || {link} end"

    q = lambda s: s.replace("'", "''")
    return f"""
with recursive p0 as (select page_id, coalesce(url, '') as url, regexp_extract(regexp_extract(coalesce(html, ''), '{q(LINK)}'), '{q(HREF)}', 1) as c, regexp_extract(regexp_extract(coalesce(html, ''), '{q(META)}'), '{q(GOES)}', 1) as r from pages),
p1 as (select *, {parts_of("url")}, {to("c")} as to1, {to("r")} as to2 from p0),
p as (select *, {rule} as rule, {act} as action, {node} as node from p1),
g0 as (select node as a, unnest([to1, to2]) as url from p where node is not null),
g1 as (select a, url, {parts_of("url")} from g0 where url is not null),
g as (select a, {node} as b, {act} as action from g1),
e as (select a, b from g where b is not null union select b, a from g where b is not null),
said as (select node, action from p where node is not null union all select b, action from g where b is not null),
reach(s, t) as (select distinct node, node from said union select s, b from reach join e on t = a),
comp as (select s as node, min(t) as component from reach group by 1),
marks as (select component, max(action = 'block') as block, max(action = 'allow') as allow from said join comp using (node) group by 1)
select page_id, host, path, rule,
  case when rule is not null then action when allow then 'allow' when block then 'block' else 'allow' end as verdict
from p left join comp using (node) left join marks using (component)"""


QUERIES = {"op6_url_filter": op6}
SQL = {"op6_url_filter": _sql()}
