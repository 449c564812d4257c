"""URL filters with redirect equivalence.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides.  Urls
without a rule take the decision of their aliases: redirect and canonical-link edges are closed to
connected components, and a block anywhere in a component reaches all its urls, unless one of them
is explicitly allowed.  Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require
from .components import connected_components

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: What no tag stands in: comments, scripts, styles and the like, closed or not.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea|title)\b.*?(?:</\1\b|\z)"
_TAGS = r"(?is)<(?:link|meta|base)\b[^>]*>"
_CANONICAL = r"""(?is)^<link\b.*(?<![\w-])rel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_REFRESH = r"""(?is)^<meta\b.*(?<![\w-])http-equiv\s*=\s*["']?\s*refresh\b"""
_HREF = r"""(?is)(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
_REFRESH_URL = r"""(?is)[;,\s"']url\s*=\s*["']?([^"'\s>]+)"""


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return _part(url, 2)


def url_key(url: Column) -> Column:
    """One spelling for each resource: no scheme, no fragment, host in lower case, path at least / and
    without dot segments.

    Null for what has no host.  It starts with ``://``, so host() and path() read it too.
    """
    at = _plain_path(path(url))
    key = F.concat(F.lit("://"), host(url), F.when(at == "", "/").otherwise(at), _part(url, 3))
    return F.when(host(url) != "", key)


def rule_of(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null where none does.

    Length counts host and path together; of equal ones the longer host wins, then allow.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _plain_path(path_: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path_, "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", up(kept)).otherwise(F.concat(kept, F.array(s)))
    walked = F.array_join(F.aggregate(parts, F.slice(parts, 1, 0), step), "/")
    plain = F.when(path_.rlike(r"/\.\.?$"), F.concat(walked, F.lit("/"))).otherwise(walked)
    return F.when(path_.rlike(r"(^|/)\.\.?(/|$)"), plain).otherwise(path_)


def _absolute(href: Column, base: Column) -> Column:
    """``href`` against a base url; null where it names no page: empty, a fragment, another scheme's."""
    plain = F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))
    top = F.concat(F.lit("://"), host(base))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    return (
        F.when((plain == "") | F.startswith(plain, F.lit("#")), None)
        .when(plain.rlike(_SCHEME), F.when(plain.rlike("(?i)^https?://"), plain))
        .when(F.startswith(plain, F.lit("//")), F.concat(F.lit(":"), plain))
        .when(F.startswith(plain, F.lit("/")), F.concat(top, plain))
        .when(F.startswith(plain, F.lit("?")), F.concat(top, path(base), plain))
        .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), plain))
    )


def _href(tag: Column) -> Column:
    found = [F.regexp_extract(tag, _HREF, g) for g in (1, 2, 3)]
    return F.coalesce(F.concat(*found), F.lit(""))


def page_edges(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges (src, dst) between url keys, read from whole pages.

    All canonical links and refreshes of a page count, but for those in comments and scripts; hrefs
    are resolved against the first base element's, or the page's url.  A ``>`` within an attribute
    ends its tag.  Null urls and pages give no edge, repeated rows repeated edges.
    """
    require(pages, "url", "html")
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).select("url", "html")
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAGS), 0)
    based = F.get(F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?is)^<base\\b")), _href), lambda h: h != ""), F.lit(0))
    found = some.select("url", tags.alias("tags"))
    found = found.select("url", "tags", F.coalesce(_absolute(based, F.col("url")), F.col("url")).alias("base"))
    said = F.when(F.col("tag").rlike(_CANONICAL), _href(F.col("tag"))).when(F.col("tag").rlike(_REFRESH), F.regexp_extract(F.replace("tag", F.lit("&quot;"), F.lit('"')), _REFRESH_URL, 1))
    hrefs = found.select("url", "base", F.explode("tags").alias("tag")).select("url", "base", said.alias("href")).where("href <> ''")
    edges = hrefs.select(url_key(F.col("url")).alias("src"), url_key(_absolute(F.col("href"), F.col("base"))).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url).

    ``edges`` holds (src, dst) url keys, as from page_edges or a redirect log.  A url with a rule has
    its rule's verdict; others are blocked when a url of their component is blocked by a rule and
    none is allowed by one; the rest is allowed.  Null urls and urls without ``://`` have an empty
    host and path and are allowed.  Repeated rows each get a row; extra columns are ignored.
    """
    require(pages, "page_id", "url")
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    parts = parts.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    nodes = connected_components(edges)
    decided = nodes.withColumn("said", rule_of(host(F.col("node")), path(F.col("node")), rules)["verdict"])
    verdicts = decided.groupBy("component").agg(F.min("said").alias("spread")).where("spread is not null")
    spread = materialize(decided.where("said is null").join(verdicts, "component").select("node", "spread"), "spread")
    joined = parts.join(spread, parts.key == spread.node, "left")
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "spread", F.lit("allow")).alias("verdict"))
