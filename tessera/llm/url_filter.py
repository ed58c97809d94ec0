"""URL filters by redirect equivalence.

Rules judge a URL by its host (and all subdomains) and path prefix. URLs that a redirect
or a canonical link joins are one resource: connected components over these edges carry
block decisions to every alias that no rule fits. Explicit allows take precedence, for
the URL itself and for its aliases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import materialise
from .skew import attach

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
_TRACKING = r"(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no scheme."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones, an allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical_form(url: Column) -> Column:
    """The URL that web servers commonly redirect its variants to.

    https for http; no ``www.`` or ``m.`` before the host, fragment, tracking parameters,
    ``.html`` or trailing slash.
    """
    host, path = F.regexp_replace(host_of(url), r"^(?:www|m)\.", ""), F.regexp_replace(path_of(url), r"(?:\.html?|/)+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), _TRACKING, ""), r"[?&]$", "")
    return F.when(host == "", F.lit(None)).otherwise(F.concat(F.lit("https://"), host, path, query))


def _absolute(link: Column, url: Column) -> Column:
    """``link`` as found in the page ``url``; null if it names no other resource with a host."""
    scheme, path = F.regexp_extract(url, r"^([^:/?#]+:)//[^/?#]", 1), path_of(url)
    root = F.concat(scheme, F.lit("//"), host_of(url))
    folder = F.concat(root, F.regexp_replace(F.regexp_extract(path, r"^(.*/)?", 1), r"^$", "/"))
    out = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
    out = out.when(link.rlike(r"^(?:$|#|[A-Za-z][A-Za-z0-9+.\-]*:)") | (scheme == ""), F.lit(None))
    out = out.when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
    return out.when(link.startswith("?"), F.concat(root, path, link)).otherwise(F.concat(folder, link))


def _without_dots(url: Column) -> Column:
    """The URL with the path's segments ``.`` and ``..`` carried out."""
    path = path_of(url)
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    # A path that ends in such a segment names a folder.
    parts = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/", -1)
    plain = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step), "/")
    head, tail = F.regexp_extract(url, r"^([^?#]*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(head, F.lit("/"), plain, tail)).otherwise(url)


def _edges(rows: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    found = rows.select(F.explode(F.array(*[F.struct(a.alias("url"), b.alias("target")) for a, b in pairs])).alias("e")).select("e.url", "e.target")
    return found.where("url is not null and target is not null and url != target").distinct()


def _target_edges(target: Column, variants: bool) -> list[tuple[Column, Column]]:
    """A target is joined to itself without dot segments, and both to their canonical forms, as page URLs are."""
    plain = _without_dots(target)
    return [(target, plain), *([(target, canonical_form(target)), (plain, canonical_form(plain))] if variants else [])]


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", variants: bool = True) -> DataFrame:
    """``url, target``: each page's canonical form, its canonical links and refresh redirects, and the canonical forms of these.

    Without ``variants`` no canonical form is taken: only links that pages state are edges.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = [F.regexp_extract_all(html, F.lit(pattern), F.lit(1)) for pattern in (_CANONICAL, _REFRESH)]
    # The null stands for the page itself.
    found = pages.select(F.col(url_col).alias("url"), F.explode(F.concat(F.array(F.lit(None).cast("string")), *links)).alias("link"))
    found = found.select("url", F.when(F.col("link").isNotNull(), _absolute(F.col("link"), F.col("url"))).alias("target"))
    url, target = F.col("url"), F.col("target")
    return _edges(found, (url, target), *_target_edges(target, variants), *([(url, canonical_form(url))] if variants else []))


def redirect_edges(redirects: DataFrame, variants: bool = True) -> DataFrame:
    """``url, target``: the given redirects and the canonical forms of both ends."""
    url, target, whole = F.col("url"), F.col("target"), F.col("whole")
    given = redirects.select("url", "target", _absolute(target, url).alias("whole"))
    return _edges(given, (url, target), (url, whole), *_target_edges(url, variants), *_target_edges(whole, variants))


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html", variants: bool = True) -> DataFrame:
    """The pages' columns plus ``host, path, rule, verdict``.

    A rule that fits the URL decides. Else its aliases do: allow if a rule allows one of
    them, block if a rule blocks one, allow otherwise. ``redirects`` (url, target) adds
    edges known from a crawl; their targets, like links of pages, may be relative.
    ``variants`` also counts the spellings of a URL that servers commonly redirect to one
    form as aliases (see :func:`canonical_form`), though nobody saw these redirects; without
    it only stated links and redirects carry verdicts.

    Null URLs and those without a scheme have an empty host and path, no aliases and the
    verdict allow. Null html has no links; html of any length is searched whole. Repeated
    pages each get a row; of equally long rules an allow wins. Result columns replace input
    columns of the same name, other names are free but for those that begin with two
    underscores. Without an html column there are no page links; an empty table gives none.
    """
    pages = pages if html_col in pages.columns else pages.withColumn(html_col, F.lit(None).cast("string"))
    edges = alias_edges(pages, url_col, html_col, variants)
    if redirects is not None:
        edges = edges.unionByName(redirect_edges(redirects, variants))
    # Nodes are 128-bit digests of URLs: components then moves fixed-width rows only.
    node = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    edges = materialise(edges.select("url", "target", node("url").alias("u"), node("target").alias("v")))
    fit = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"]
    named = edges.select("url").union(edges.select(F.col("target").alias("url"))).distinct().select("url", node("url").alias("node"), fit.alias("own"))
    groups = components(edges, "u", "v")
    known = materialise(named.join(groups, "node").select("url", "component", "own"))
    says = known.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"), F.count(F.lit(1)).alias("size"))
    told = materialise(says.where("blocked and not coalesce(allowed, false)").select("component", "size", F.lit(True).alias("told")))
    blocked = attach(known.where("own is null"), told, "component", "size", known.count()).where("told").select("url")
    # Neither a resource of very many aliases nor a very common URL is one task.
    often = pages.groupBy(F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("__often"))
    blocked = materialise(blocked.join(often, "url").select(F.col("url").alias("__url"), "__often", F.lit(True).alias("__blocked")))
    own = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = own.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    out = attach(own.withColumn("__url", F.col(url_col)), blocked, "__url", "__often", pages.count())
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__blocked"), F.lit("block")), F.lit("allow"))
    return out.select(*[c for c in own.columns if c != "__rule"], F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))
