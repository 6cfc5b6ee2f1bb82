"""URL filters with redirect equivalence.

Pages that name each other by ``<link rel=canonical>`` or ``<meta
http-equiv=refresh>`` are aliases: connected components over these links. A
block decision of any member holds for all its aliases, except those that a
rule allows explicitly.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no aliases; null html has no links; a link to itself, to a fragment or to
another scheme gives no edge; of equally long rules allow wins, then the
smaller rule string; repeated rows are judged row by row; a long page is searched by
one task, in time in proportion to its length; other columns aren't read, so their names don't matter; an empty
table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, q, small
from .components import connected_components

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Up to this many hosts with rules are broadcast: some 20 MB for short lists of rules.
BROADCAST_HOSTS = 50_000


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; written out in every place, nested expressions would grow without end."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    up = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda held, part: F.when(part == "..", up(held)).when(part == ".", held).otherwise(
        F.concat(held, F.array(part))))
    end = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    whole = let(resolved, lambda kept: F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, end).otherwise("")))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), whole).otherwise(path)


def node_of(url: Column) -> Column:
    """Host, path and query: the name by which aliases are compared (no scheme, no fragment, dot segments resolved)."""
    rest = _rest(url)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "^$", "/")
    return F.when(host != "", F.concat(host, let(path, without_dots), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)))


#: What isn't markup of the page: comments, and elements whose content is text.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
#: A tag up to its end; a quoted value may hold a ``>``.
LINK_TAG, META_TAG, BASE_TAG = (rf"(?i)<{name}(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>" for name in ("link", "meta", "base"))
ATTRIBUTE = r"[^\s\"'>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"


def decoded(text: Column) -> Column:
    """Character references of numbers, and those of the markup's own characters."""
    number = r"^(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));?"
    code = lambda p: F.coalesce(F.conv(F.nullif(F.regexp_extract(p, number, 1), F.lit("")), 16, 10),
                                F.regexp_extract(p, number, 2)).try_cast("int")
    known = lambda c: c.between(32, 0x10FFFF) & ~c.between(0xD800, 0xDFFF)
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
    rest = lambda parts: F.transform(F.slice(parts, 2, 1 << 20), lambda p: let(code(p), lambda c: F.when(
        known(c), F.concat(char(c), F.regexp_replace(p, number, ""))).otherwise(F.concat(F.lit("&#"), p))))
    out = let(F.split(text, "&#"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(rest(parts), "")))
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of a name; null without one."""
    first = F.get(F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda x: F.lower(x).rlike(rf"^{name}\s*=")), F.lit(0))
    return F.btrim(decoded(F.regexp_replace(F.regexp_extract(first, r"(?s)^[^=]*=\s*(.*)$", 1), "^[\"']|[\"']$", "")), F.lit(" \t\n\r\f"))


def link_targets(html: Column) -> Column:
    """Raw targets of the canonical and refresh tags; comments, scripts and the like aside."""
    seen = F.when(F.lower(html).rlike("canonical|refresh"), F.regexp_replace(html, HIDDEN, " "))
    tags = lambda pattern: F.regexp_extract_all(seen, F.lit(pattern), F.lit(0))
    rel = lambda t: F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), r"\s+")
    links = F.transform(F.filter(tags(LINK_TAG), lambda t: F.array_contains(rel(t), "canonical")), lambda t: attribute(t, "href"))
    metas = F.transform(F.filter(tags(META_TAG), lambda t: F.lower(attribute(t, "http-equiv")) == "refresh"),
                        lambda t: F.regexp_extract(attribute(t, "content"), r"(?i)(?:^|[;,\s])url\s*=\s*[\"']?([^\"']*)", 1))
    return F.filter(F.concat(links, metas), lambda t: t.isNotNull())


def base_of(html: Column) -> Column:
    """Raw target of the first base tag, where the page has links that count; null without one."""
    seen = F.when(F.lower(html).rlike("canonical|refresh") & F.lower(html).contains("<base"), F.regexp_replace(html, HIDDEN, " "))
    found = F.transform(F.regexp_extract_all(seen, F.lit(BASE_TAG), F.lit(0)), lambda t: attribute(t, "href"))
    return F.get(F.filter(found, lambda t: t.isNotNull()), F.lit(0))


def resolve(host: Column, path: Column, target: Column) -> Column:
    """Absolute form of a target on a page; null where it names no other page."""
    root = F.concat(F.lit("http://"), host)
    folder = F.regexp_replace(path, "[^/]*$", "")
    return (F.when(target.rlike("(?i)^https?://"), target)
            .when(target.rlike("^(#|$|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None))
            .when(target.startswith("//"), F.concat(F.lit("http:"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?"), F.concat(root, path, target))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target)))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host``, ``path``) and ``rule``, ``rule_verdict`` of the longest rule that fits.

    Rules are looked up once per distinct host, by its parent domains; a url
    then tries the rules of its host.
    """
    rules = rules.select(F.lower("verdict").alias("v"), "rule_host", F.coalesce("rule_path", F.lit("")).alias("p"),
                         F.concat("rule_host", F.coalesce("rule_path", F.lit(""))).alias("r")).where("r IS NOT NULL")
    hosts = urls.where("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per = hosts.select("host", F.explode(ups).alias("up")).join(rules, F.col("up") == F.col("rule_host"))
    # the best rule comes last
    order = F.struct(F.length("r").alias("n"), (F.col("v") == "allow").alias("a"), "r", "p", "v")
    per = small(cut(per.groupBy(F.col("host").alias("_rh")).agg(F.sort_array(F.collect_set(order), asc=False).alias("_rules"))), BROADCAST_HOSTS)
    found = F.get(F.filter("_rules", lambda x: F.startswith(F.col("path"), x["p"])), F.lit(0))
    return urls.join(per, F.col("host") == F.col("_rh"), "left").withColumn("_hit", found).withColumns(
        {"rule": F.col("_hit")["r"], "rule_verdict": F.col("_hit")["v"]}).drop("_rh", "_rules", "_hit")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(u, v)`` node names of a page and of what it names as its canonical or redirect place."""
    of = pages.select(node_of(q(url)).alias("u"), host_of(q(url)).alias("host"), path_of(q(url)).alias("path"),
                      base_of(q(html)).alias("base"), F.explode(link_targets(q(html))).alias("target"))
    base = resolve(F.col("host"), F.col("path"), F.col("base"))
    place = lambda b: F.struct(F.when(b.isNotNull(), host_of(b)).otherwise(F.col("host")).alias("host"),
                               F.when(b.isNotNull(), path_of(b)).otherwise(F.col("path")).alias("path"))
    of = of.select("u", "target", F.explode(F.array(let(base, place))).alias("at"))
    to = of.select("u", F.explode(F.array(resolve(F.col("at.host"), F.col("at.path"), F.col("target")))).alias("to"))
    return to.select("u", node_of(F.col("to")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
               default: str = "allow") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_group`` (smallest
    node name of the page's aliases; null without any)."""
    groups = connected_components(alias_edges(pages, url, html))
    parts = F.concat(F.lit("http://"), F.col("node"))
    nodes = groups.select("node", "root", host_of(parts).alias("host"), path_of(parts).alias("path"))
    blocked = cut(match_rules(nodes, rules).groupBy("root").agg(
        F.max((F.col("rule_verdict") == "block").cast("int")).alias("_blocked")).select(
        F.col("root").alias("_root"), F.coalesce("_blocked", F.lit(0)).alias("_blocked")))
    alias = groups.join(blocked, F.col("root") == F.col("_root")).select(
        F.col("node").alias("_node"), F.col("root").alias("alias_group"), "_blocked")
    urls = pages.select(q(id_col).alias(id_col), host_of(q(url)).alias("host"), path_of(q(url)).alias("path"),
                        node_of(q(url)).alias("_of"))
    out = match_rules(urls, rules).join(alias, F.col("_of") == F.col("_node"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("_blocked") == 1, F.lit("block")), F.lit(default))
    return out.select(q(id_col), "host", "path", "rule", verdict.alias("verdict"), "alias_group")
