"""URL verdicts with redirect equivalence, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the URL's path begins with the rule's; the longest decides.
URLs that redirects or canonical links connect are aliases: where no rule fits a page, its aliases' rules decide, and
an explicit allow among them goes before any block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import materialise
from tallyforge.llm.components import components

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
#: Rules are laid out in the plan; more of them belong in a table.
MOST_RULES = 1000

CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"'\s/>][^>]*>|<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
BASE = r"(?i)<base\b[^>]*\bhref\s*=[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty without ``://``."""
    found = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.substr(url, at + 3))


def _key(url: Column) -> Column:
    """What names the resource: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(_after(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), rest))


def rule_for(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _absolute(link: Column, url: Column) -> Column:
    """A link's URL: absolute, or resolved against ``url``; null for other schemes and empty links."""
    link = F.replace(F.nullif(link, F.lit("")), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(url, "://", 1)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("#"), F.substring_index(url, "#", 1))
        .otherwise(F.concat(scheme, F.lit("://"), host(url), _resolved(link, path(url))))
    )


def _resolved(link: Column, base: Column) -> Column:
    """Path and query of a link that is relative to the path ``base``, without ``.`` and ``..``."""
    folder = F.concat(F.when(base.startswith("/"), F.lit("")).otherwise(F.lit("/")), F.regexp_extract(base, r"^(.*/)?", 0))
    own, rest = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    whole = F.when(own == "", base).when(own.startswith("/"), own).otherwise(F.concat(folder, own))

    def step(acc, part):
        up = F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))  # the first part is what stands before the first slash
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    parts = F.split(F.regexp_replace(whole, r"/(\.\.?)$", "/$1/"), "/", -1)
    plain = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.concat(F.when(whole.contains("/."), plain).otherwise(whole), rest)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, other) for every canonical link and every redirect that a page states of itself."""
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    base = F.coalesce(_absolute(F.regexp_extract(F.regexp_extract(html, BASE, 0), HREF, 1), url), url)
    links = F.array(
        _absolute(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), base),
        _absolute(F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1), base),
    )
    stated = pages.where(F.instr("url", "://") > 0).where(html.rlike(CANONICAL) | html.rlike(REFRESH))
    return stated.select("url", F.explode(F.array_compact(links)).alias("other"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``redirects``: further (url, other) edges.

    Null URLs and those without ``://`` have an empty host and path, no rule and no alias. Where neither a rule nor an
    alias decides, the verdict is allow. Null html states no link. Repeated rows keep their rows; other columns are
    ignored; an empty table gives no rows.
    """
    url = F.col("url")
    own = rule_for(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", host(url).alias("host"), path(url).alias("path"), F.unhex(F.md5(_key(url))).alias("node"))
        .withColumn("own", own)
    )
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "other").where((F.instr("url", "://") > 0) & (F.instr("other", "://") > 0)))
    edges = materialise(edges, "aliases")
    node = lambda c: F.unhex(F.md5(_key(F.col(c))))
    roots = components(edges.select(node("url").alias("a"), node("other").alias("b")))
    ends = edges.select(F.explode(F.array("url", "other")).alias("url"))
    told = ends.select(F.unhex(F.md5(_key(url))).alias("node"), rule_for(host(url), path(url), rules)["verdict"].alias("told")).where("told is not null").distinct()
    by_root = roots.join(told, "node").groupBy("root").agg(F.min("told").alias("alias"))  # allow sorts before block
    decided = roots.join(by_root, "root").select("node", "alias")
    return judged.join(decided, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict"),
    )


def _sql() -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''").replace('\\"', '"') + "'"
    after = lambda u: f"case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end"
    at_host = lambda u: f"translate(regexp_extract({after(u)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    at_path = lambda u: f"regexp_extract({after(u)}, '^[^/?#]*([^?#]*)', 1)"
    key = lambda u: f"case when instr({u}, '://') > 0 then {at_host(u)} || regexp_extract({after(u)}, '^[^/?#]*([^#]*)', 1) end"

    def absolute(link: str, u: str) -> str:
        link = f"replace(nullif({link}, ''), '&amp;', '&')"
        scheme = f"split_part({u}, '://', 1)"
        return f"case when instr({link}, '://') > 0 then {link} when starts_with({link}, '//') then {scheme} || ':' || {link} when starts_with({link}, '/') then {scheme} || '://' || {at_host(u)} || {link} end"

    canonical = absolute(f"regexp_extract(regexp_extract(html, {q(CANONICAL)}), {q(HREF)}, 1)", "url")
    refresh = absolute(f"regexp_extract(regexp_extract(html, {q(REFRESH)}), {q(TARGET)}, 1)", "url")
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return f"""
with recursive rules(verdict, rule, host, path) as (values {rules}),
stated as (select url, unnest([{canonical}, {refresh}]) as other from pages where instr(url, '://') > 0),
edges as (select {key("url")} as a, {key("other")} as b, url, other from stated where other is not null),
urls as (select page_id, true as page, url from pages union all select null, false, url from edges union all select null, false, other from edges),
parts as (select row_number() over () as id, page_id, page, {key("url")} as node, {at_host("url")} as host, {at_path("url")} as path from urls),
fits as (select p.*, r.rule, r.verdict, row_number() over (partition by p.id order by length(r.rule) desc nulls last) as nth
  from parts p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)),
own as (select * from fits where nth = 1),
pairs as (select a, b from edges union select b, a from edges),
reach(a, b) as (select a, a from pairs union select r.a, e.b from reach r join pairs e on r.b = e.a),
alias as (select r.a as node, min(o.verdict) as verdict from reach r join own o on o.node = r.b where o.verdict is not null group by 1)
select o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, a.verdict, 'allow') as verdict
from own o left join alias a on o.node = a.node where o.page
"""


SQL = _sql()
