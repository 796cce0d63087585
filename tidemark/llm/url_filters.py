"""URL filters with redirect equivalence: a block decision reaches every alias of a blocked url."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept
from .components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, allow) of the longest rule that fits, null if none does; of equal rules an allowing one wins.

    The host's suffixes look up a literal map, so the cost does not grow with the number of rules.
    """
    by_host: dict[str, list[Rule]] = {}
    for r in sorted(set(rules), key=lambda r: (r.host, r.path, not r.allow)):
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<len:int,allow:boolean,rule:string>")
    as_struct = lambda r: F.struct(F.lit(len(r.name)).alias("len"), F.lit(r.allow).alias("allow"), F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"))
    table = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*map(as_struct, own)))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda h: F.try_element_at(table, h)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow"), r["rule"].alias("rule"))))
    return best


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    single = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 2)
    bare = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 3)
    return F.trim(F.concat(quoted, single, bare))


def _unescaped(x: Column) -> Column:
    """``x`` with numeric character references and those of ``& < > " '`` undone, each once."""
    named = F.create_map(*[F.lit(y) for pair in {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.items() for y in pair])

    def part(y: Column, i: Column) -> Column:
        name = F.regexp_extract(y, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", 1)
        after = F.substring(y, F.length(name) + 2, F.length(y))
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 7)).cast("int")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNull(), F.try_element_at(named, name))
        return F.when(i == 0, y).when(char.isNotNull(), F.concat(char, after)).otherwise(F.concat(F.lit("&"), y))

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "&", -1), part), "")).otherwise(x)


def _without_dots(rest: Column) -> Column:
    """Path and query with the path's ``.`` and ``..`` segments resolved; ``rest`` starts with ``/``."""
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    names = F.split(path, "/", -1)
    names = F.slice(names, F.lit(2), F.size(names))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    kept_ = F.aggregate(names, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    folder = F.element_at(names, -1).isin(".", "..") & (F.size(kept_) > 0)
    plain = F.concat(F.lit("/"), F.array_join(kept_, "/"), F.when(folder, "/").otherwise(""), F.substring(rest, F.length(path) + 1, F.length(rest)))
    return F.when(F.contains(path, F.lit("/.")), plain).otherwise(rest)


def normal_url(url: Column) -> Column:
    """The name of a url in the alias graph: without fragment, scheme and host lower-cased, an empty path as ``/``, dot segments resolved; null without ``://``."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.contains(bare, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(bare), _without_dots(rest)))


def _resolved(target: Column, base: Column) -> Column:
    """The url that a link on a page at ``base`` leads to (RFC 3986, 5.2, dot segments aside); null for an empty link, a
    mere fragment, another scheme without ``//`` or a base without ``://``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when((target == "") | F.startswith(target, F.lit("#")) | ~F.contains(base, F.lit("://")), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: what a generator makes is not written out again in each place that uses it."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): normal urls joined by a page's canonical link or immediate redirect (meta refresh), resolved against the
    page's url, or its first ``<base>``. Null or plain html has none."""
    # a tag without end is taken to the end of the page and dropped, so that it is read once
    tags = F.filter(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*+(?:>|\z))"), F.lit(1)), lambda t: F.endswith(t, F.lit(">")))
    of = lambda kind: F.filter(F.col("tags"), lambda t: t.rlike(rf"(?i)^<{kind}\b"))
    is_canonical = lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")
    canonical = F.transform(F.filter(of("link"), is_canonical), lambda t: _attribute(t, "href"))
    refresh = F.transform(
        F.filter(of("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*[\d.]+\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)),
    )
    base = F.get(F.filter(F.transform(of("base"), lambda t: _attribute(t, "href")), lambda h: h != ""), F.lit(0))
    found = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?\s*refresh"))
    found = _once(found.select("url", tags.alias("tags")), F.concat(canonical, refresh).alias("targets"), base.alias("base"))
    found = _once(found.select("url", "base", F.explode("targets").alias("target")), _unescaped(F.col("target")).alias("to"), _unescaped(F.col("base")).alias("from"))
    found = _once(found, F.coalesce(_resolved(F.col("from"), F.col("url")), F.col("url")).alias("page"))
    found = _once(found, _resolved(F.col("to"), F.col("page")).alias("link"))
    return _once(found, normal_url(F.col("url")).alias("u"), normal_url(F.col("link")).alias("v")).select("u", "v").where("u is not null and v is not null and u <> v")


def judge(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, in_alias_group.

    The longest fitting rule decides. A url that no rule fits is blocked if its alias component - connected by redirects
    (``redirects(u, v)``), meta refreshes and canonical links - holds a url that a rule blocks, and else allowed. A url
    with its own allowing rule stays allowed there. Null urls and urls without ``://`` have empty host and path, no rule
    and no alias, so they are allowed. Repeated pages each get their row; other columns take no part.
    """
    mine = pages.select(F.col(id_column).alias(id_column), F.col(url).alias("url"), *([F.col(html).alias("html")] if html else []))
    judged = mine.select(id_column, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), normal_url(F.col("url")).alias("node"))
    judged = judged.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = alias_edges(mine) if html else None
    if redirects is not None:
        told = redirects.select(normal_url(F.col("u")).alias("u"), normal_url(F.col("v")).alias("v")).where("u is not null and v is not null and u <> v")
        edges = told if edges is None else edges.union(told)
    if edges is None:
        blocked = None
    else:
        with Scratch(pages.sparkSession) as scratch:
            edges = scratch.table(edges.distinct())
            groups = scratch.table(components(edges, scratch))
            own = groups.select("component", "node", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules).alias("fit"))
            bad = scratch.table(own.where(~F.col("fit.allow")).select("component").distinct())
            blocked = kept(groups.join(bad.withColumn("bad", F.lit(True)), "component", "left").select("node", F.coalesce("bad", F.lit(False)).alias("bad")))
    if blocked is not None:
        judged = judged.join(blocked, "node", "left")
    else:
        judged = judged.withColumn("bad", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("fit").isNotNull(), F.when(F.col("fit.allow"), "allow").otherwise("block")).when(F.col("bad"), "block").otherwise("allow")
    return judged.select(id_column, "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.col("bad").isNotNull().alias("in_alias_group"))


RULES = [
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
]


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = r"""
with recursive parts as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path,
    html
  from pages
), rules(rh, rp, allow) as (
  values ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)
), best as (
  select p.page_id, p.url, max(struct_pack(len := length(rh) + length(rp), allow := allow, rule := rh || rp)) as fit
  from parts p join rules r on (p.host = r.rh or p.host like '%.' || r.rh) and starts_with(p.path, r.rp)
  group by all
), nodes as (
  select distinct p.page_id, regexp_replace(p.url, '#.*$', '', 's') as node, b.fit from parts p left join best b on p.page_id is not distinct from b.page_id and p.url is not distinct from b.url
), edges as (
  select regexp_replace(url, '#.*$', '', 's') as u, regexp_replace(regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1), '#.*$', '', 's') as v
  from pages where html ilike '%rel="canonical"%'
), both_ways as (select u, v from edges union select v, u from edges),
reach(node, start) as (
  select node, node from nodes where fit is not null and not fit.allow
  union
  select b.v, r.start from reach r join both_ways b on b.u = r.node
), bad as (select distinct node from reach)
select n.page_id, p.host, p.path, n.fit.rule as rule,
  case when n.fit is not null then case when n.fit.allow then 'allow' else 'block' end when n.node in (select node from bad) then 'block' else 'allow' end as verdict,
  n.node in (select u from both_ways) as in_alias_group
from nodes n join parts p on p.page_id is not distinct from n.page_id and regexp_replace(p.url, '#.*$', '', 's') is not distinct from n.node
"""
