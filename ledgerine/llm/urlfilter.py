"""URL filters by redirect equivalence, in DataFrame functions only.

Rules name a host and a path prefix and allow or block; the longest that fits a URL decides. URLs joined by redirects and canonical
links are one resource under several names: connected components over these links, found by distributed star contraction, carry
decisions to names without a rule of their own. In a component an explicit allow goes before any block; with neither, the URL is
allowed. A page with a rule always keeps that rule's verdict.

Links come from the pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``) and, if given, from a table of redirects
(source, target). All such tags of a page count, but not what looks like one inside a comment, a script or another element of raw text,
a template or the value of an attribute. Names are URLs without their fragment, with scheme and host in lower case and dot segments
collapsed.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule, is the alias of nothing and is allowed, whatever
its page or a redirect says; null html has no links; links to itself and null links are ignored; equal pages are separate rows; an empty table gives an empty result; extra columns are
carried through, result names replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are one expression; beyond it they are joined by host suffix.
INLINE = 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def with_rule(pages: DataFrame, url: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and the rule's verdict (null without one). Of rules of equal length an allow wins, then the smallest name."""
    host, path = host_and_path(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    if len(rules) > INLINE:
        return _joined(out, rules)
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r[0] + r[1]))
    pick, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(best):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        pick, verdict = F.when(fits, F.lit(h + p)).otherwise(pick), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumns({"rule": pick, "rule_verdict": verdict})


def _joined(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The same for long lists: each distinct (host, path) meets the rules of its host's suffixes in an equi-join."""
    table = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, v string")
    spots = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    spots = spots.withColumn("rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    found = spots.join(table, "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    found = found.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), "v", rule.alias("r"))).alias("b"))
    return pages.join(found.select("host", "path", F.col("b.r").alias("rule"), F.col("b.v").alias("rule_verdict")), ["host", "path"], "left")


def name_of(url: Column) -> Column:
    """Without fragment, scheme and host in lower case, dot segments of the path collapsed."""
    url = F.regexp_replace(url, r"(?s)#.*$", "")
    origin = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    rest = F.substr(url, F.length(origin) + 1)
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    parts = F.split(path, "/")

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))

    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    flat = F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)
    return F.when(origin == "", url).otherwise(F.concat(F.translate(origin, UPPER, LOWER), flat, F.substr(rest, F.length(path) + 1)))


def resolved(base: Column, link: Column) -> Column:
    """An absolute URL for a link on a page."""
    link = F.replace(F.btrim(link), F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*(/(?:[^?#]*/)?)?", 0)
    return (
        F.when((link == "") | origin.isNull() | (origin == ""), F.when(F.contains(link, F.lit("://")), link))
        .when(F.contains(F.regexp_extract(link, r"^[^/?#]*", 0), F.lit(":")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^[^:/?#]+:", 0), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


#: Comments, and elements whose content is no markup of the page; one that does not end goes on to the end.
HIDDEN = r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|xmp|iframe|noembed|noframes|template)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\b[^>]*>|\z)"
TAG = r"""(?i)<[a-z](?:"[^"]*"|'[^']*'|[^>"'])*+>"""
#: Names of attributes with their values, which may hold what looks like others.
ATTRIBUTE = r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of the first attribute of a name in a tag; null without one."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(own, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.when(value.rlike(r"""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): names that a page declares to be the same resource."""
    seen = pages.where(F.contains(F.col(url), F.lit("://")) & F.col(html).rlike(r"(?i)canonical|http-equiv"))
    tags = F.filter(F.regexp_extract_all(F.regexp_replace(F.col(html), HIDDEN, ""), F.lit(TAG), F.lit(0)), lambda t: t.rlike(r"(?i)^<(?:link|meta)\b"))
    tag = seen.select(F.col(url).alias("u"), F.explode(tags).alias("t"))
    rel = F.split(F.lower(F.btrim(attribute(F.col("t"), "rel"))), r"\s+")
    canonical = F.when(F.col("t").rlike(r"(?i)^<link\b") & F.array_contains(rel, "canonical"), attribute(F.col("t"), "href"))
    refresh = F.when(F.col("t").rlike(r"(?i)^<meta\b") & (F.lower(F.btrim(attribute(F.col("t"), "http-equiv"))) == "refresh"), F.regexp_extract(attribute(F.col("t"), "content"), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1))
    links = tag.select("u", F.coalesce(canonical, refresh).alias("l")).where("l <> ''")
    return links.select(name_of(F.col("u")).alias("a"), name_of(resolved(F.col("u"), F.col("l"))).alias("b")).where("b is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """The columns of ``pages`` (without the html) and host, path, rule, verdict and inherited (true where the component decided)."""
    rules = RULES if rules is None else rules
    links = page_links(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.toDF("a", "b").where(F.contains("a", F.lit("://")) & F.contains("b", F.lit("://"))).select(name_of(F.col("a")).alias("a"), name_of(F.col("b")).alias("b"))
        links = more if links is None else links.unionByName(more)
    names = [n for n in pages.columns if n not in (html, "host", "path", "rule", "rule_verdict", "verdict", "inherited", "_name", "_found")]
    out = with_rule(pages.select(*[F.col(f"`{n}`") for n in names]), url, rules).withColumn("_name", F.when(F.contains(F.col(url), F.lit("://")), name_of(F.col(url))))
    if links is None:
        out = out.withColumn("_found", F.lit(None).cast("string"))
    else:
        member = components(written(links))
        own = with_rule(member.select("node", "root"), "node", rules)
        flags = own.groupBy("root").agg(F.min("rule_verdict").alias("_found")).where(F.col("_found").isNotNull())
        found = member.join(flags, "root").select(F.col("node").alias("_name"), "_found")
        out = out.join(found, "_name", "left")
    verdict = F.coalesce("rule_verdict", "_found", F.lit("allow"))
    return out.select(*names, "host", "path", "rule", verdict.alias("verdict"), (F.col("rule_verdict").isNull() & F.col("_found").isNotNull()).alias("inherited"))
