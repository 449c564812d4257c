"""Main text of HTML pages: page structure, then a suffix array over the pages of a host.

A page becomes a list of text blocks.  Structure settles the clear cases: blocks in menus, headers,
footers, sidebars, notices, adverts, forms, comments and hidden parts go.  The blocks of a host's
pages that stand outside an article, or on pages without an article element, are concatenated as
one token stream.  Its suffix array and the common prefixes of neighbours in it give the long
substrings that stand on distinct pages; a block that they cover goes, unique runs stay.  Where
most of a page itself repeats on a few others, as near copies of an article do, only what stands on
still more pages counts.  A block within an article goes only when runs that stand on nearly all
pages of a host cover it, as they do a site-wide notice, also one with a date or a number of its
own: an article that two pages share is still an article.  Such a notice goes outside an article too,
on however few pages it stands there.

All pages with all their blocks are first brought together by host, and suffix arrays over them give
the site-wide runs.  A large host's pages are dealt into shards, one suffix array each, so no task
holds a host.  A run on that share of a host's pages is on that share of some shard's, so shards
report only such; where the reports leave open whether a run reaches the share, it is counted on all
pages.  A second pass over the pages drops what site-wide runs cover and settles pages with nothing
outside an article; the others are brought together by host, and their shards tell each other on how
many of their pages each of their runs stands.  So counts are of the whole host, whatever the size
of a shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, require
from .urlfilter import host

#: Tokens of a repeated run, at least; share of a block that runs must cover.
MIN_RUN = 6
COVERED = 0.8
#: Share of a page that repeats on as many pages as its near copies are.
NEAR = 0.6
#: A run is site-wide from so many pages and this share of the pages.
WIDE_PAGES, WIDE_SHARE = 10, 0.8
#: Characters of text of one host that a shard takes; the result does not depend on it.
SHARD_CHARS = 1_000_000

# Element names and words of class, id and role values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
DROPPED = frozenset("nav footer aside form script style noscript template textarea title iframe button select input dialog menu svg canvas object audio video head datalist search noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets footer banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations comments comment commentlist respond disqus replies reply pagination pager login masthead paywall toolbar disclaimer".split()
)
HEADER_WORDS = frozenset("header topbar".split())
MAIN_WORDS = frozenset("articlebody article-body article-content post-content post-body entry-content story-body main-content".split())

_LEX = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEP, _DROP, _MAIN = 0, 1, 2


def _kind(tag: str, attrs: str, in_main: bool) -> int:
    if tag in DROPPED:
        return _DROP
    kind = _MAIN if tag in ("article", "main") else _KEEP
    if tag == "header" and not in_main:
        return _DROP
    if not attrs or attrs == "/":
        return kind
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return _DROP
        if name == "role":
            if value in DROPPED_ROLES:
                return _DROP
            if value in ("main", "article"):
                kind = _MAIN
        elif name in ("class", "id"):
            words = set(_WORD.findall(value))
            if words & DROPPED_WORDS and tag not in ("html", "body", "article", "main"):
                return _DROP
            if words & HEADER_WORDS and not in_main and tag not in ("html", "body"):
                return _DROP
            if tag in ("article", "main") and words & {"comment", "comments", "reply"}:
                return _DROP
            if MAIN_WORDS & set(value.split()):
                kind = _MAIN
        elif name == "itemprop" and value == "articlebody":
            kind = _MAIN
        elif name == "itemprop" and value == "comment":
            return _DROP
    return kind


def page_blocks(html: str) -> list[tuple[bool, str]]:
    """(within the article, text) of the blocks that structure does not rule out, in page order.

    Character references are decoded, white space within a block is one space, empty blocks go.
    Unclosed and misnested elements are tolerated; markup cut off at the end is dropped.  The time
    is in proportion to the page's length, whatever its markup.
    """
    blocks: list[tuple[bool, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}  # open elements of each name
    outer: list[int] = []  # places of the block elements in the stack
    dropped = mains = 0

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append((mains > 0, text))

    def close(down_to: int) -> None:
        nonlocal dropped, mains
        for name, kind in stack[down_to:]:
            dropped -= kind == _DROP
            mains -= kind == _MAIN
            opened[name] -= 1
        del stack[down_to:]
        while outer and outer[-1] >= down_to:
            outer.pop()

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            parts.append(html[at:lt])
        if lt == n:
            break
        m = _LEX.match(html, lt)
        if m is None:
            if not dropped:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            if opened.get(tag):
                # the walk passes only elements that it then closes
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            gone = _CLOSES.get(tag)
            if gone or (tag in BLOCK and tag not in ("td", "th")):
                for k in reversed(outer):
                    name = stack[k][0]
                    if gone and name in gone or name == "p":
                        close(k)
                        break
                    if name in BLOCK and name not in _CLOSES:
                        break
        if tag in VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        if attrs and attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        kind = _kind(tag, attrs.strip() if attrs else "", mains > 0)
        if kind == _DROP or kind == _MAIN:
            flush()
        if tag in BLOCK:
            outer.append(len(stack))
        stack.append((tag, kind))
        opened[tag] = opened.get(tag, 0) + 1
        dropped += kind == _DROP
        mains += kind == _MAIN
    flush()
    return blocks


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): all suffixes in order, and the tokens each shares with the one before it.

    Prefix doubling: suffixes alike in 2^k tokens are ordered by the place of what follows those;
    only groups of several are looked at again.  Places to every depth then give common prefixes.
    """
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.searchsorted(np.sort(tokens), tokens).astype(np.int64)
    levels, width = [place], 1
    while True:
        sizes = np.bincount(place, minlength=n)
        open_ = np.flatnonzero(sizes[place] > 1)
        if not len(open_):
            break
        ahead = np.full(len(open_), -1, np.int64)
        inside = open_ + width < n
        ahead[inside] = place[open_[inside] + width]
        sort = np.lexsort((ahead, place[open_]))
        rows, group, ahead = open_[sort], place[open_][sort], ahead[sort]
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        changes = starts | np.concatenate([[True], ahead[1:] != ahead[:-1]])
        at = np.arange(len(rows))
        group_at = np.maximum.accumulate(np.where(starts, at, 0))
        place = place.copy()
        place[rows] = group + np.maximum.accumulate(np.where(changes, at, 0)) - group_at
        levels.append(place)
        width *= 2
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        same = (i < n) & (j < n)
        same[same] = levels[k][i[same]] == levels[k][j[same]]
        common += same * (1 << k)
    return order, np.concatenate([[0], common])


def run_classes(tokens: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """For each token a number that tokens share when the ``min_run`` tokens from them on are equal.

    Suffixes that share so many tokens stand together in the suffix array.
    """
    order, common = suffix_array(tokens)
    classes = np.empty(len(tokens), np.int64)
    classes[order] = np.cumsum(common < min_run) - 1
    return classes


def run_support(classes: np.ndarray, page_of: np.ndarray) -> np.ndarray:
    """For each class the distinct pages that it stands on."""
    pages = int(page_of.max()) + 1
    return np.bincount(np.unique(classes * pages + page_of) // pages, minlength=int(classes.max()) + 1)


def spread_over(support: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """For each token the largest support of a run over it; ``support`` is of the run from it on."""
    n = len(support)
    spread = np.ones(n, np.int64)
    for k in range(min(min_run, n)):
        np.maximum(spread[k:], support[: n - k], out=spread[k:])
    return spread


def repeated_runs(tokens: np.ndarray, page_of: np.ndarray, min_run: int = MIN_RUN) -> np.ndarray:
    """For each token the most distinct pages that share a run of ``min_run`` tokens over it.

    ``page_of`` must fall in one page for each run: the last token of a page is unique to it.
    """
    classes = run_classes(tokens, min_run)
    return spread_over(run_support(classes, page_of)[classes], min_run)


Blocks = list[tuple[bool, str]]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: More than the rounding of a share of pages, less than a page.
_SLACK = 1e-3


def run_hashes(tokens: np.ndarray, words: dict[str, int], ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the MIN_RUN tokens from each token on; 0 where a page ends before that.

    ``words`` numbers the words from 1 on in its own order; ``ends`` says for each token where its page ends.
    """
    known = np.array([1, *(xxhash.xxh64_intdigest(w) for w in words)], np.uint64)
    each = known[np.maximum(tokens, 0)]
    n, out = len(each), np.zeros(len(each), np.uint64)
    for k in range(min(MIN_RUN, n)):
        out[: n - k] = (out[: n - k] + each[k:]) * _FACTOR
    out[np.arange(n) + MIN_RUN >= ends] = 0
    return out.view(np.int64)


def counted_runs(classes: np.ndarray, page_of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, pages): the hash of each run and the distinct pages that it stands on."""
    support = run_support(classes, page_of)
    _, at = np.unique(classes, return_index=True)
    at = at[hashes[at] != 0]
    return hashes[at], support[classes[at]]


def site_stream(page: list[str], words: dict[str, int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Tokens of a page's blocks, and the place of each block in them.

    Zeros before and after a block, more of them after a short one, make a run of every whole block.
    """
    tokens: list[int] = []
    spans = []
    for text in page:
        tokens.append(0)
        start = len(tokens)
        tokens += [words.setdefault(w, len(words) + 1) for w in text.split(" ")]
        spans.append((start, len(tokens)))
        tokens += [0] * max(1, MIN_RUN - 1 - (len(tokens) - start))
    return tokens, spans


def site_runs(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(run, pages) of the runs within the given pages' blocks, from the pages' suffix array."""
    words: dict[str, int] = {}
    tokens: list[int] = []
    ends = []
    for p, page in enumerate(pages):
        tokens += site_stream(page, words)[0]
        tokens.append(-1 - p)
        ends.append(len(tokens))
    sizes = np.diff([0, *ends])
    stream = np.array(tokens, np.int64)
    return counted_runs(run_classes(stream), np.repeat(np.arange(len(ends)), sizes), run_hashes(stream, words, np.repeat(ends, sizes)))


def site_wide(page: Blocks, wide: np.ndarray) -> list[bool]:
    """Whether each block of a page goes as a site-wide one; ``wide`` are the host's site-wide runs.

    It goes when they cover it.  Where most of the page's article is site-wide, it is a near copy of
    an article on nearly all pages, and a block with words of its own stays.  Outside an article a
    block goes only if it holds a whole run and most of the page is not site-wide.
    """
    if not len(wide) or not page:
        return [False] * len(page)
    words: dict[str, int] = {}
    tokens, spans = site_stream([text for _, text in page], words)
    stream = np.array([*tokens, -1], np.int64)
    hashes = run_hashes(stream, words, np.full(len(stream), len(stream)))
    covered = spread_over(1 + (np.isin(hashes, wide) & (hashes != 0))) > 1
    within = [covered[a:b] for (inside, _), (a, b) in zip(page, spans) if inside]
    near = bool(within) and np.concatenate(within).mean() >= NEAR
    most = np.concatenate([covered[a:b] for a, b in spans]).mean() >= NEAR
    return [bool(covered[a:b].mean() >= (1 if near else COVERED)) if inside else bool(covered[a:b].mean() >= COVERED and b - a >= MIN_RUN and not most) for (inside, _), (a, b) in zip(page, spans)]


class HostShard:
    """Pages of one host, alike ones once, with their token stream and its runs."""

    def __init__(self, pages: list[Blocks]):
        self.first: dict[tuple, int] = {}
        self.which = [self.first.setdefault(tuple(blocks), len(self.first)) for blocks in pages]
        self.pages = list(self.first)
        words: dict[str, int] = {}
        tokens: list[int] = []
        ends: list[int] = []
        self.spans: list[list[tuple[int, int] | None]] = []
        for p, blocks in enumerate(self.pages):
            spans: list[tuple[int, int] | None] = []
            for inside, text in blocks:
                if inside:
                    spans.append(None)
                    continue
                start = len(tokens)
                tokens += [words.setdefault(w, len(words) + 1) for w in text.split(" ")]
                spans.append((start, len(tokens)))
                tokens.append(0)
            self.spans.append(spans)
            tokens.append(-1 - p)
            ends.append(len(tokens))
        self.tokens = np.array(tokens, np.int64)
        self.page_of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
        self.classes = run_classes(self.tokens)
        self.words = words
        self.ends = ends

    def run_hashes(self) -> np.ndarray:
        return run_hashes(self.tokens, self.words, np.array(self.ends)[self.page_of])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(run, pages) of this shard's runs."""
        return counted_runs(self.classes, self.page_of, self.run_hashes())

    def texts(self, wide: np.ndarray, runs: np.ndarray | None = None, sums: np.ndarray | None = None) -> list[str]:
        """The main text of each page; ``wide`` are the host's site-wide runs.

        ``runs`` and ``sums`` say on how many pages of all shards a run stands, where that is more
        than on this shard's.
        """
        support = run_support(self.classes, self.page_of)[self.classes]
        if runs is not None and len(runs):
            order = np.argsort(runs)
            hashes = self.run_hashes()
            place = np.minimum(np.searchsorted(runs[order], hashes), len(runs) - 1)
            found = (runs[order][place] == hashes) & (hashes != 0)
            support = np.where(found, np.maximum(support, sums[order][place]), support)
        spread = spread_over(support)
        kept = []
        for page, spans in zip(self.pages, self.spans):
            own = [spread[s[0] : s[1]] for s in spans if s]
            level = 0
            if own:
                flat = np.sort(np.concatenate(own))
                level = flat[min(len(flat) - 1, int((1 - NEAR) * len(flat)))]
            texts = []
            for (inside, text), s, covered in zip(page, spans, site_wide(page, wide)):
                if not covered and (inside or (spread[s[0] : s[1]] > level).mean() < COVERED):
                    texts.append(text)
            kept.append("\n".join(texts))
        return [kept[w] for w in self.which]


def main_texts(pages: list[Blocks]) -> list[str]:
    """The main text of each page of a host, given the blocks of all."""
    shard = HostShard(pages)
    runs, n = site_runs([[text for _, text in page] for page in shard.pages])
    return shard.texts(runs[n >= max(WIDE_PAGES, WIDE_SHARE * len(shard.pages))])


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _pages(group: pa.Table) -> list[Blocks]:
    return [[(f == "b", t) for f, t in zip(flags, texts.split("\n"))] for flags, texts in zip(group.column("flags").to_pylist(), group.column("texts").to_pylist())]


def extract(pages: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """page_id, url, the main text and its number of code points, for every page.

    A null or empty html, and a page without main text, give an empty text.  Pages alike in all
    blocks count as one page when repeats are sought.  Null and host-less urls form a host of their
    own.  Repeated rows each get a row; extra columns are ignored; an empty table gives no rows.  A
    host with more html, or text on pages with blocks outside an article, than ``shard_chars`` is dealt
    into shards by the pages' contents, so pages alike share one; that bounds a task and changes no text.
    """
    require(pages, "page_id", "url", "html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("h"))

    wide, some_outside = _site_wide(rows, shard_chars)
    if wide.isEmpty():
        told = rows.withColumn("wide", F.array().cast("array<long>"))
    else:
        told = rows.join(wide, "h", "left").select(*rows.columns, F.coalesce("wide", F.array().cast("array<long>")).alias("wide"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags: list[str | None] = []
            texts: list[str] = []
            for html, gone in zip(batch.column(2), batch.column(4)):
                blocks = page_blocks(html.as_py())
                if all(inside for inside, _ in blocks):
                    flags.append(None)
                    texts.append("\n".join(t for (_, t), covered in zip(blocks, site_wide(blocks, gone.values.to_numpy())) if not covered))
                else:
                    flags.append("".join("ab"[inside] for inside, _ in blocks))
                    texts.append("\n".join(t for _, t in blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(flags, pa.string()), pa.array(texts, pa.string()), batch.column(4)], names=["page_id", "url", "h", "flags", "texts", "wide"])

    parsed = told.mapInArrow(settle, "page_id long, url string, h string, flags string, texts string, wide array<long>")
    if some_outside:  # read once for settled pages and once or twice for the others
        parsed = materialize(parsed, "blocks")
    settled = parsed.where("flags is null") if some_outside else parsed
    chosen = settled.select("page_id", "url", F.col("texts").alias("text"), F.length("texts").cast("long").alias("n_chars"))
    return chosen.unionAll(_by_host(parsed.where("flags is not null"), shard_chars)) if some_outside else chosen


def _key(blocks: Blocks) -> int:
    """Hash of all of a page's blocks."""
    return xxhash.xxh64_intdigest("\n".join(f"{'ab'[inside]}{text}" for inside, text in blocks)) - (1 << 63)


def _site_wide(rows: DataFrame, shard_chars: int) -> tuple[DataFrame, bool]:
    """(h, wide) with each host's site-wide runs, and whether any block stands outside an article."""
    sizes = rows.groupBy("h").agg(F.sum(F.length("html")).alias("chars")).where(F.col("chars") > shard_chars)
    shards = materialize(sizes.select("h", F.ceil(F.col("chars") / shard_chars).cast("int").alias("shards")), "hosts")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()  # pages alike share a shard and count once
        for batch in batches:
            hosts, keys, outside, texts = [], [], [], []
            for h, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks = page_blocks(html.as_py())
                key = _key(blocks)
                if (h, key) in met:
                    continue
                met.add((h, key))
                hosts.append(h)
                keys.append(key)
                outside.append(not all(inside for inside, _ in blocks))
                texts.append("\n".join(text for _, text in blocks))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(outside, pa.bool_()), pa.array(texts, pa.string())], names=["h", "key", "outside", "texts"])

    parsed = rows.select("h", "html").mapInArrow(parse, "h string, key long, outside boolean, texts string")
    dealt = parsed.join(shards, "h", "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("shard", F.pmod("key", F.col("shards")).cast("int"))

    def report(key: tuple, group: pa.Table) -> pa.Table:
        pages = dict(zip(group.column("key").to_pylist(), group.column("texts").to_pylist()))
        total, outside = len(pages), any(group.column("outside").to_pylist())
        runs, n = site_runs([texts.split("\n") if texts else [] for texts in pages.values()])
        least = max(WIDE_PAGES, WIDE_SHARE * total) if group.column("shards")[0].as_py() == 1 else WIDE_SHARE * total - _SLACK
        runs, n = runs[n >= least], n[n >= least]
        size = 1 + len(runs)  # the first row is for the shard itself
        return pa.table({"h": pa.array([key[0].as_py()] * size, pa.string()), "run": pa.array([None, *runs.tolist()], pa.int64()), "n": pa.array([0, *n.tolist()], pa.int64()), "total": pa.array([total] * size, pa.int64()), "outside": pa.array([outside] * size, pa.bool_())})

    dealt = dealt.repartition("h", "shard")  # after a join on h Spark would leave a host's shards in one task
    told = materialize(dealt.groupBy("h", "shard").applyInArrow(lambda k, g: report(k, g), "h string, run long, n long, total long, outside boolean"), "reports")
    release(shards)
    some_outside = not told.where("run is null and outside").isEmpty()
    needs = told.where("run is null").groupBy("h").agg(F.sum("total").alias("pages")).where(F.col("pages") >= WIDE_PAGES)
    needs = needs.withColumn("need", F.greatest(F.lit(float(WIDE_PAGES)), WIDE_SHARE * F.col("pages")))
    sums = told.where("run is not null").groupBy("h", "run").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).join(needs, "h")
    # the shards that did not report a run hold it on less than the share of their pages
    sums = sums.where(F.col("n") + WIDE_SHARE * (F.col("pages") - F.col("total")) >= F.col("need") - _SLACK)
    sums = materialize(sums.select("h", "run", "need", (F.col("n") >= F.col("need")).alias("enough")), "sums")
    release(told)
    runs = sums.where("enough").select("h", "run")
    open_ = sums.where("not enough").groupBy("h").agg(F.collect_list("run").alias("runs"), F.first("need").alias("need"))
    if not open_.isEmpty():

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, found = [], []
                for html, sought in zip(batch.column(1), batch.column(2)):
                    blocks = page_blocks(html.as_py())
                    keys.append(_key(blocks))
                    found.append(np.intersect1d(site_runs([[text for _, text in blocks]])[0], sought.values.to_numpy()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64())), batch.column(3)], names=["h", "key", "runs", "need"])

        seen = rows.select("h", "html").join(open_, "h").mapInArrow(find, "h string, key long, runs array<long>, need double").dropDuplicates(["h", "key"])
        on = seen.select("h", "need", F.explode("runs").alias("run")).groupBy("h", "run").agg(F.count("*").alias("on"), F.first("need").alias("need"))
        runs = runs.unionAll(on.where("on >= need").select("h", "run"))
    wide = materialize(runs.groupBy("h").agg(F.collect_list("run").alias("wide")), "wide")
    release(sums)
    return wide, some_outside


def _by_host(parsed: DataFrame, shard_chars: int) -> DataFrame:
    """EXTRACTED of pages that hold blocks outside an article."""
    sizes = parsed.groupBy("h").agg(F.sum(F.length("texts")).alias("chars"))
    shards = materialize(sizes.select("h", F.greatest(F.lit(1), F.ceil(F.col("chars") / shard_chars)).cast("int").alias("shards")), "hosts")
    dealt = parsed.join(shards, "h").withColumn("shard", F.pmod(F.xxhash64("flags", "texts"), F.col("shards")).cast("int"))

    def count(key: tuple, group: pa.Table) -> pa.Table:
        runs, n = HostShard(_pages(group)).counts()
        return pa.table({"h": pa.array([key[0].as_py()] * len(runs), pa.string()), "shard": pa.array([key[1].as_py()] * len(runs), pa.int32()), "run": runs, "n": n})

    def choose(group: pa.Table, runs: np.ndarray | None = None, sums: np.ndarray | None = None) -> pa.Table:
        if not group.num_rows:
            return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())})
        texts = HostShard(_pages(group)).texts(group.column("wide")[0].values.to_numpy(), runs, sums)
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    key = ("h", "shard")
    whole = dealt.where("shards = 1").groupBy(*key).applyInArrow(lambda g: choose(g), EXTRACTED)
    if shards.where("shards > 1").isEmpty():
        return whole
    split = dealt.where("shards > 1")
    seen = materialize(split.select(*key, "flags", "texts").groupBy(*key).applyInArrow(lambda k, g: count(k, g), "h string, shard int, run long, n long"), "runs")
    sums = seen.groupBy("h", "run").agg(F.sum("n").alias("n"), F.count("*").alias("in_shards")).where("in_shards > 1").drop("in_shards")
    told = seen.select(*key, "run").join(sums, ["h", "run"])
    by_sums = split.groupBy(*key).cogroup(told.groupBy(*key)).applyInArrow(lambda g, s: choose(g, s.column("run").to_numpy(), s.column("n").to_numpy()), EXTRACTED)
    return whole.unionAll(by_sums)
