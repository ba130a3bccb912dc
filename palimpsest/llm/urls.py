"""URL filters with redirect equivalence; DataFrame functions only.

A rule (host, path) fits its host and subdomains where the URL's path starts with the rule's path; the longest
fitting rule decides. Pages that name another address by `<link rel="canonical">` or a `<meta>` refresh are aliases of it:
connected components over these edges carry decisions to members without a rule of their own. A page's
own rule comes first; in a component, an explicit allow comes before any block; without either, the default is allow.

Links are resolved as RFC 3986 says: absolute, without scheme, without host, query only, or relative to the page's
folder, dot segments removed; character references of markup are decoded first, and `rel` may list several words. Links
within the page or to other schemes (`mailto:`) are none. Addresses are compared by host, path (empty: `/`) and query,
without scheme and fragment. Components are found with distributed
star rounds; pages without such a link take no part in them.

Defined cases. Null url or one without `://`: host and path empty, no rule, allow. Null html: no link. Repeated
rows: each is judged. Links to addresses outside the table join components and their rules count. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (UrlRule("allow", "org", "/"), UrlRule("block", "example.org", "/es/"), UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"), UrlRule("block", "com", "/de/"))

_CANONICAL = r"""(?i)<link\b[^>]*[\s"']rel\s*=\s*(?:(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?')[^>]*>|canonical(?:[\s/][^>]*)?>)"""
_REFRESH = r"""(?i)<meta\b[^>]*[\s"']http-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
#: Character references that addresses hold; the ampersand last.
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """The query with its mark; empty where there is none."""
    return F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)


def _rooted(path: Column) -> Column:
    return F.when(path == "", F.lit("/")).otherwise(path)


def address_of(url: Column) -> Column:
    """Host in lower case, path and query; null for a URL without `://`."""
    return F.when(F.locate("://", url) > 0, F.concat(host_of(url), _rooted(path_of(url)), query_of(url)))


def without_dots(path: Column) -> Column:
    """A rooted path less its dot segments."""
    segments = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), lambda own, x: F.when(x == "..", F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))).when(x == ".", own).otherwise(F.concat(own, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, link: Column) -> Column:
    """The address that a link on the page of url leads to, as `address_of` gives it; null where it is none."""
    link = F.trim(F.regexp_replace(link, "#.*$", ""))
    absolute, schemed = link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    full = F.when(absolute, link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("x:"), link))
    own = F.regexp_extract(link, r"^([^?]*)", 1)
    folder = F.regexp_replace(_rooted(path_of(url)), "[^/]*$", "")
    path = F.when(own == "", _rooted(path_of(url))).when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    here = F.concat(host_of(url), without_dots(path), F.regexp_extract(link, r"^[^?]*(\?.*)", 1))
    there = F.concat(host_of(full), without_dots(_rooted(path_of(full))), query_of(full))
    return F.when(full.isNotNull(), there).when((link != "") & ~schemed, here)


def fitting_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict); null where none fits."""
    found = [F.when(((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    return F.coalesce(*found)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: a page and the one that it redirects or canonically links to."""
    linked = pages.select("url", "html").filter(F.col("html").rlike(_CANONICAL) | F.col("html").rlike(_REFRESH))
    target = F.regexp_replace(F.regexp_extract(F.regexp_extract("html", _CANONICAL, 0), _HREF, 1), "^[\"']|[\"']$", "")
    targets = F.array(target, F.regexp_extract(F.regexp_extract("html", _REFRESH, 0), _TARGET, 1))
    link = F.col("link")
    for name, character in REFERENCES:
        link = F.replace(link, F.lit(name), F.lit(character))
    edges = linked.select("url", F.explode(targets).alias("link")).filter("link <> '' and locate('://', url) > 0")
    return edges.select(address_of(F.col("url")).alias("src"), resolved(F.col("url"), link).alias("dst"))


def judge_pages(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, by_alias; one row per row of pages."""
    node_rule = fitting_rule(host_of(F.concat(F.lit("x://"), F.col("node"))), path_of(F.concat(F.lit("x://"), F.col("node"))), rules)
    parts = connected_components(alias_edges(pages))
    decided = parts.withColumn("own", node_rule["verdict"]).groupBy("component").agg(F.min("own").alias("shared"))  # allow sorts before block
    aliases = parts.join(decided, "component").filter("shared is not null").select(F.col("node").alias("_node"), "shared")
    url = pages["url"]
    judged = pages.select(pages["page_id"].alias("page_id"), host_of(F.coalesce(url, F.lit(""))).alias("host"), path_of(F.coalesce(url, F.lit(""))).alias("path"), address_of(url).alias("_address"))
    judged = judged.withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    both = judged.join(aliases, F.col("_address") == F.col("_node"), "left")
    return both.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "shared", F.lit("allow")).alias("verdict"),
        (F.col("own").isNull() & F.col("shared").isNotNull()).alias("by_alias"),
    )
