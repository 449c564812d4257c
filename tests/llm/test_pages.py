"""HTML text, URL filters, WARC and chat against brute force, round trips and odd inputs."""

import base64
import gzip
import hashlib
import html
import random
import re
import time
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat, html_text, queries, urlfilter, warc
from spindrift.llm.components import connected_components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "page_id long, url string, html string, text string, host string, shard int, key string, h string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 9, "k", "h") for r in rows], SCHEMA)


def article_text(page):
    body = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>|<br>", body))
    return "\n".join(b for b in blocks if b)


def test_op3_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op3_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []),
        ("plain &lt;text&gt; &amp; 1 < 2", ["plain <text> & 1 < 2"]),
        ("<article><p>a<br>b  <b>c</b>d<p>e</article><footer>x", ["a b cd", "e"]),
        ("<div class='sidebar'>x</div><div id=cookie-notice>x</div><main><ul><li>one<li>two</ul></main>", ["one", "two"]),
        ("<article><h1>T</h1><aside>x</aside><form><p>x</form><section class=comments><p>x</section><p>y</article>", ["T", "y"]),
        ("<article><p>a<script>if (1<2) '</p>'</script>b<style>p{}</style><!-- <p>x --></article>", ["ab"]),
        ("<p hidden>x</p><p style='display: none'>x</p><p aria-hidden=true>x</p><div role=navigation>x</div><p>y", ["y"]),
        ("<header>x</header><article><header><h1>T</h1></header>t</article>", ["T", "t"]),
        ("<table><tr><td>A<td>B<tr><td>C</table>", ["A", "B", "C"]),
        ("<p>a<script>never closed <p>x", ["a"]),
        ("<p>a</p><p class='unclosed", ["a"]),
    ],
)
def test_blocks(page, blocks):
    assert [t for _, t in html_text.page_blocks(page)] == blocks


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        pages = [rng.integers(1, 4, rng.integers(1, 40)).tolist() for _ in range(rng.integers(1, 5))]
        tokens, owner = [], []
        for i, p in enumerate(pages):
            tokens += [*p, -1 - i]
            owner += [i] * (len(p) + 1)
        n, seen = html_text.MIN_RUN, defaultdict(set)
        for i in range(len(tokens) - n + 1):
            seen[tuple(tokens[i : i + n])].add(owner[i])
        expected = [max([1, *(len(seen[tuple(tokens[j : j + n])]) for j in range(max(0, i - n + 1), i + 1) if j + n <= len(tokens))]) for i in range(len(tokens))]
        assert html_text.repeated_runs(np.array(tokens), np.array(owner)).tolist() == expected


def test_boilerplate_without_an_article_element(spark):
    menu = "<div><p>Home News Sport Weather Travel Money About Us</p>{}<p>All rights reserved by the example press group</p></div>"
    rows = [(i, f"http://h.example/{i}", menu.format(f"<p>Story number {i} tells {' '.join(f'w{i}x{k}' for k in range(30))}.</p>")) for i in range(4)]
    odd = [(10, None, "<p>alone</p>"), (11, "no host", None), (12, "http://h.example/0", rows[0][2]), (12, "http://h.example/0", rows[0][2]), (None, "http://z/", "")]
    got = html_text.extract(pages_of(spark, rows + odd))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted((r.page_id if r.page_id is not None else -1, r.text) for r in got.collect())
    story = lambda i: f"Story number {i} tells {' '.join(f'w{i}x{k}' for k in range(30))}."
    assert texts == [(-1, ""), *((i, story(i)) for i in range(4)), (10, "alone"), (11, ""), (12, story(0)), (12, story(0))]
    assert html_text.extract(pages_of(spark, [])).count() == 0


def test_suffix_array_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 60, 200):
        for kinds in (1, 2, 5):
            tokens = rng.integers(0, kinds, n)
            order, common = html_text.suffix_array(tokens)
            suffixes = sorted(range(n), key=lambda i: tokens[i:].tolist())
            assert order.tolist() == suffixes
            shared = lambda a, b: next((k for k in range(n) if a + k >= n or b + k >= n or tokens[a + k] != tokens[b + k]), 0)
            assert common.tolist()[1:] == [shared(a, b) for a, b in zip(suffixes, suffixes[1:])]


def divs(*blocks):
    return "".join(f"<div>{b}</div>" for b in blocks)


def site(rng, host, stories, menu, end):
    """Pages of plain divs: a menu, a story of its own, an end; some stories with near copies."""
    rows, expected = [], {}
    for k in range(stories):
        story = [" ".join(f"{host[7:9]}{k}p{n}w{j}" for j in range(int(rng.integers(20, 40)))) for n in range(3)]
        for copy in range(1 + 2 * (k % 5 == 0)):
            key = len(rows)
            body = [f"story {k} in edition {copy}e{k} as said", *story]
            rows.append((key, f"{host}/{k}/{copy}", divs(*menu, *body, *end)))
            expected[key] = "\n".join(body)
    return rows, expected


def test_repeats_are_counted_over_all_shards_of_a_host(spark):
    rng = np.random.default_rng(4)
    menu, end = ["Home", "News", "Sport", "Weather and Travel", "Money", "About Us"], ["All rights reserved by the example press group"]
    rows, expected = site(rng, "http://big.example", 40, menu, end)
    # a passage on two pages alone, most likely of different shards, is a repeat too
    pages = pages_of(spark, rows).repartition(3)
    whole = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert whole == expected
    assert any("Home" in "\n".join(t for _, t in html_text.page_blocks(r[2])) for r in rows)  # structure alone keeps the menu
    for size in (1000, 20_000):
        assert {r.page_id: r.text for r in html_text.extract(pages, shard_chars=size).collect()} == whole
    notices = [(100 + i, f"http://n.example/{i}", f"<article><p>own words of page {i} {' '.join(f'q{i}w{k}' for k in range(30))}<p>please read our terms of use before you share</article>") for i in range(24)]
    small, large = ({r.page_id: r.text for r in html_text.extract(pages_of(spark, notices), shard_chars=size).collect()} for size in (300, 1_000_000))
    assert small == large and not any("terms of use" in t for t in large.values())


def test_site_wide_runs_within_articles_are_of_all_pages_of_a_host(spark):
    own = lambda i: f"own words of page {i} " + " ".join(f"q{i}w{k}" for k in range(20))
    dated = lambda i: f"page {i} of our archive: please read the terms of use before you share this page with anyone else"
    most, fewer = "these words of the editors stand on four fifths of the pages", "those words of the printers stand on one page less than that"
    rows, expected = [], {}
    for i in range(30):
        blocks = [own(i), "Share this", dated(i), *([most] if i < 24 else []), *([fewer] if i < 23 else [])]
        expected[i] = "\n".join([own(i), *([fewer] if i < 23 else [])])
        rows.append((i, f"http://n.example/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
    rows += [(100 + i, f"http://n.example/copy/{i}", rows[29][2]) for i in range(20)]  # copies count once
    expected |= {100 + i: expected[29] for i in range(20)}
    pages = pages_of(spark, rows).repartition(3)
    for size in (300, 700, 3000, 1_000_000):
        assert {r.page_id: r.text for r in html_text.extract(pages, shard_chars=size).collect()} == expected


def test_near_copies_of_an_article_on_all_pages_keep_their_own_words():
    story = "Story told again " + " ".join(f"s{k}" for k in range(40))
    pages = [[(True, f"{story} in edition {i}e{i}"), (True, f"{i}d{i} of May")] for i in range(12)]
    assert html_text.main_texts(pages) == ["\n".join(t for _, t in page) for page in pages]


def test_a_notice_within_articles_goes_beside_them_too():
    notice = "please read the terms of use before you share this page with anyone else"
    own = lambda i: f"own words of page {i} " + " ".join(f"q{i}w{k}" for k in range(30))
    pages = [[(True, own(i)), (True, notice)] for i in range(12)] + [[(False, own(12)), (False, notice)]]
    assert html_text.main_texts(pages) == [own(i) for i in range(13)]


def test_site_runs_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(40):
        pages = [[" ".join(f"w{k}" for k in rng.integers(0, 2, rng.integers(1, 12))) for _ in range(rng.integers(0, 5))] for _ in range(rng.integers(1, 5))]
        on = defaultdict(set)
        for p, page in enumerate(pages):
            tokens = [t for text in page for t in ["", *text.split(" "), *[""] * max(1, html_text.MIN_RUN - 1 - len(text.split(" ")))]]
            for i in range(len(tokens) - html_text.MIN_RUN + 1):
                on[tuple(tokens[i : i + html_text.MIN_RUN])].add(p)
        runs, n = html_text.site_runs(pages)
        assert sorted(n.tolist()) == sorted(map(len, on.values())) and len(set(runs.tolist())) == len(runs)


def test_hostile_markup_takes_linear_time():
    n = 20_000
    for page in ("<b>" * n + "</i>" * n, "<p><div>" + "<b>" * n + "<hr>" * n, "<i>" + "<b>" * n + "</i>" * n, '<a "' * n, "<a '\"" * n, "<b>" * n + "<li>" * n, "<script>" * n, "<" * 4 * n):
        began = time.perf_counter()
        html_text.page_blocks(page)
        assert time.perf_counter() - began < 5


def test_shared_article_passages_stay_but_site_wide_notices_go():
    passage = "this passage of many words stands in two articles of the very same host and stays in both"
    notice = "please read our terms of use before you share this page with anyone"
    pages = [[(True, notice), (True, f"own words of page {i} " + " ".join(f"p{i}w{k}" for k in range(20))), *([(True, passage)] if i < 2 else [])] for i in range(12)]
    got = html_text.main_texts(pages)
    assert all(notice not in t for t in got) and passage in got[0] and passage in got[1]


def test_unique_text_beside_an_article_stays():
    menu = "Home News Sport Weather Travel Money About Us"
    lead = lambda i: f"lead of page {i} in few words l{i}a l{i}b l{i}c"
    body = lambda i: f"body of page {i} " + " ".join(f"b{i}x{k}" for k in range(30))
    pages = [html_text.page_blocks(f"<div>{menu}</div><article><p>{lead(i)}</article><div>{body(i)}</div>") for i in range(4)]
    assert html_text.main_texts(pages) == [f"{lead(i)}\n{body(i)}" for i in range(4)]


def test_near_copies_without_an_article_element_keep_their_text():
    menu, end = "Home News Sport Weather Travel Money About Us", "All rights reserved by the example press group"
    story = lambda i: [f"Story {i} paragraph {n} " + " ".join(f"s{i}n{n}x{k}" for k in range(30)) for n in range(4)]
    dated = [["Printed on the first of May", *story(0)], ["Seen again on a day in June", *story(0)], [*story(0)[:3], "another last paragraph of other words " + " ".join(f"o{k}" for k in range(20))]]
    bodies = [*dated, story(1), story(2)]
    pages = [[(False, t) for t in (menu, *body, end)] for body in bodies]
    assert html_text.main_texts(pages) == ["\n".join(b) for b in bodies]
    alone = [[(False, t) for t in body] for body in dated[:2]]
    assert html_text.main_texts(alone) == ["\n".join(b) for b in dated[:2]]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_op7_against_plain_code(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: tuple(r) for r in queries.op7_url_filter(spark, sf_dir).collect()}
    for r in pages:
        host, path = plain_parts(r.url)
        rule, verdict = plain_rule(host, path)
        assert got[r.page_id] == (r.page_id, host, path, rule, verdict or "allow")


def test_blocks_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://bad.net/x", ""), (2, "https://alias.io/a#f", link.format("http://BAD.net/x")), (3, "http://second.io/b", '<meta http-equiv="refresh" content="0; url=//alias.io/a">'),
        (4, "http://x.org/fr/1", link.format("http://alias.io/a")), (5, "http://free.io/", link.format("/other")), (6, "http://free.io/other?q=1", None), (7, None, link.format("http://bad.net/x")),
        (8, "nonsense", ""), (9, "http://third.io", link.format("http://bad2.net/?a=1&amp;b=2")), (10, "http://third.io/", ""), (10, "http://third.io/", ""), (None, "HTTP://Up.Example.NET/en/x?y#z", ""),
    ]
    pages = pages_of(spark, rows)
    verdicts = sorted((r.page_id or 0, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.page_edges(pages)).collect())
    by = {i: (r, v) for i, r, v in verdicts}
    # page 4 is allowed by a rule, and so are all urls of its component that no rule blocks
    assert by[1] == ("net/", "block") and by[4] == ("org/fr/", "allow") and by[2] == (None, "allow") == by[3]
    assert by[5] == by[6] == by[7] == by[8] == (None, "allow")
    assert by[9] == by[10] == (None, "block") and len(verdicts) == 12
    assert by[0] == ("example.net/en/", "allow")
    without = pages.where("page_id is null or page_id <> 4")
    again = {r.page_id: r.verdict for r in urlfilter.judge(without, urlfilter.page_edges(without)).collect()}
    assert again[2] == again[3] == "block"
    empty = pages.where(F.lit(False))
    assert urlfilter.judge(empty, urlfilter.page_edges(empty)).count() == 0


class Links(HTMLParser):
    """What a plain parser finds of canonical links and refreshes."""

    def __init__(self, page):
        super().__init__()
        self.base, self.hrefs = None, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        has = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and self.base is None and has.get("href"):
            self.base = has["href"]
        if tag == "link" and "canonical" in has.get("rel", "").lower().split():
            self.hrefs.append(has.get("href", "").strip())
        if tag == "meta" and has.get("http-equiv", "").lower() == "refresh" and "url=" in has.get("content", ""):
            self.hrefs.append(has["content"].split("url=", 1)[1].strip("\"' "))


def plain_key(url):
    parts = urlsplit(urljoin(url, urlsplit(url).path or "/") + ("?" + urlsplit(url).query if urlsplit(url).query else ""))
    return f"://{parts.netloc.lower()}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def test_edges_against_a_plain_parser(spark):
    rng = random.Random(5)
    hosts = ["good.io", "bad.net", "a.org", "example.com", "b.io"]
    hrefs = ["/login?next=http://bad.net/", "//bad.net/x", "../up/./y", "?q=1&amp;r=http://bad.net/", "#top", "javascript:void(0)", "mailto:x@bad.net", "", "page", "/a/../../b", "HTTP://BAD.net/x", "https://good.io/a", "http://a.org/fr/1", "ftp://bad.net/f", "./", "sub/"]
    tags = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL='Canonical'>", '<link rel="alternate canonical" data-href="http://bad.net/" href="{}"/>', '<meta http-equiv="refresh" content="0; url={}">', "<!-- <link rel=canonical href='{}'> -->", "<script>'<link rel=canonical href=\"{}\">'</script>", '<link rel="stylesheet" href="{}">']
    rows = []
    for i in range(300):
        head = rng.choice(["", "", '<base href="http://b.io/base/dir/">', '<base target=_blank><base href="/rooted/">'])
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'a', 'x/y', 'x/y/', 'en/p'])}{rng.choice(['', '?k=1', '#f'])}", head + "".join(rng.choice(tags).format(rng.choice(hrefs)) for _ in range(rng.randrange(3)))))
    expected = []
    for _, url, page in rows:
        links = Links(page)
        base = urljoin(url, links.base) if links.base else url
        for href in links.hrefs:
            target = urljoin(base, href)
            if href and not href.startswith("#") and target.lower().startswith("http") and plain_key(url) != plain_key(target):
                expected.append((plain_key(url), plain_key(target)))
    pages = pages_of(spark, rows)
    edges = [tuple(r) for r in urlfilter.page_edges(pages).collect()]
    assert sorted(edges) == sorted(expected) and len(expected) > 100
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in expected:
        parent[find(a)] = find(b)
    said = defaultdict(set)
    for node in list(parent):
        said[find(node)].add(plain_rule(*plain_parts(node))[1])
    for r, (_, url, _) in zip(sorted(urlfilter.judge(pages, urlfilter.page_edges(pages)).collect()), rows):
        rule, verdict = plain_rule(*plain_parts(url))
        spread = said[find(plain_key(url))] if plain_key(url) in parent else set()
        assert (r.rule, r.verdict) == (rule, verdict or ("allow" if "allow" in spread or "block" not in spread else "block"))


def test_a_link_that_names_a_url_in_its_query_is_no_alias_of_it(spark):
    pages = pages_of(spark, [(1, "http://good.io/a", '<link rel="canonical" href="/login?next=http://bad.net/">')])
    assert [tuple(r) for r in urlfilter.page_edges(pages).collect()] == [("://good.io/a", "://good.io/login?next=http://bad.net/")]
    assert urlfilter.judge(pages, urlfilter.page_edges(pages)).first().verdict == "allow"


def test_components_against_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(1, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.where(F.lit(False))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [("http://a.example/ä", "<title>x</title><p>One &amp; <b>two</b></p><script>z</script><ul><li>three"), ("", "")]
    raw = b"".join(warc.write_record(*warc.response_record(u, h.encode())) for u, h in pages)
    for data in (raw, gzip.compress(raw)):
        records = list(warc.read_records(data))
        assert [warc.value(h, "WARC-Target-URI") for h, _ in records] == [u for u, _ in pages]
        assert [warc.split_http(b)[2].decode() for _, b in records] == [h for _, h in pages]
        for headers, block in records:
            assert warc.value(headers, "warc-block-digest") == warc.digest(block)
            meta, text = warc.derive(headers, block)
            assert warc.value(meta[0], "WARC-Refers-To") == warc.value(text[0], "WARC-Refers-To") == warc.value(headers, "WARC-Record-ID")
            assert warc.value(headers, "WARC-Payload-Digest").encode() in meta[1] and b"http-header-content-type: text/html" in meta[1]
            assert list(warc.read_records(warc.write_record(*text)))[0][1] == text[1]
            assert warc.derive(*text) == []
    assert warc.derive(*records[0])[1][1].decode() == "One & two\nthree"
    faults = []
    assert list(warc.read_records(raw[:-30], faults)) == records[:1] and len(faults) == 1
    assert list(warc.read_records(b"junk", faults)) == [] and len(faults) == 2
    (tmp_path / "x.warc").write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.record_type for r in warc.derive_files(files).collect()] == ["metadata", "conversion"] * 2


def test_damaged_files_give_what_can_be_read(spark, tmp_path):
    records = [warc.write_record(*warc.response_record(f"http://a.example/{i}", f"<p>page {i} {'x' * 500}".encode())) for i in range(4)]
    whole, members = gzip.compress(b"".join(records)), [gzip.compress(r) for r in records]
    hurt = records[1].replace(b"Content-Length: ", b"Content-Length: x")
    cases = {"plain": (b"".join(records), 4, 0), "cut": (b"".join(records)[:-40], 3, 1), "members": (b"".join(members), 4, 0), "members_cut": (b"".join(members)[:-20], 3, 1), "hurt": (records[0] + hurt + records[2], 2, 1), "noise": (b"junk\n" + records[0], 1, 1), "empty": (b"", 0, 0)}
    for name, (data, _, _) in cases.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    (tmp_path / "whole_cut.warc").write_bytes(whole[: len(whole) - 60])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    for name, (data, good, bad) in cases.items():
        rows = warc.derive_files(files.where(F.col("path").endswith(f"/{name}.warc"))).collect()
        kinds = [r.record_type for r in rows]
        assert (kinds.count("conversion"), kinds.count("metadata")) == (good, good), name
        assert kinds.count("unreadable") >= bad and (bad > 0) == ("unreadable" in kinds), name
    rows = warc.derive_files(files.where(F.col("path").endswith("/whole_cut.warc"))).collect()
    assert any(r.record_type == "unreadable" and "gzip" in r.content for r in rows)


class Visible(HTMLParser):
    """Visible text by another parser: blocks on lines, white space as one space."""

    HIDDEN = ("script", "style", "title", "noscript", "template", "textarea")
    TURNS = "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split()

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.off = [], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.off += tag in self.HIDDEN
        self.turn(tag)

    def handle_endtag(self, tag):
        self.off -= tag in self.HIDDEN and self.off > 0
        self.turn(tag)

    def turn(self, tag):
        if tag in self.TURNS:
            self.out.append("\0")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)

    def text(self):
        lines = (" ".join(part.split()) for part in "".join(self.out).split("\0"))
        return "\n".join(line for line in lines if line)


def test_op8_against_plain_code(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    by = defaultdict(dict)
    for r in queries.op8_warc(spark, sf_dir).collect():
        by[r.page_id][r.record_type] = r
    assert set(by) == set(pages) and all(set(x) == {"metadata", "conversion"} for x in by.values())
    sources = set()
    for key, found in by.items():
        meta, text = found["metadata"], found["conversion"]
        body = pages[key].html.encode()
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        fields = dict(line.split(": ", 1) for line in meta.content.split("\r\n") if line)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        assert fields == {"http-status": "HTTP/1.1 200 OK", "http-header-content-type": "text/html; charset=utf-8", "http-header-content-length": str(len(body)), "source-payload-digest": sha(body), "source-block-digest": sha(head + body), "source-content-length": str(len(head + body))}
        assert text.content == Visible(pages[key].html).text()
        for r in (meta, text):
            assert (r.target_uri, r.warc_date, r.block_digest, r.content_length) == (pages[key].url, warc.DATE, sha(r.content.encode()), len(r.content.encode()))
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id
        sources.add(meta.refers_to)
    assert len(sources) == len({(p.url, p.html) for p in pages.values()})
    assert warc.plain_text("<p>a <img alt=\"a>b\">x<p title='1>0'>y") == "a x\ny"


def test_op8(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op8_warc(spark, sf_dir).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    for r in got:
        body = pages[r.page_id].html.encode()
        assert r.source_payload_digest == warc.digest(body) and r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode())
        assert r.target_uri == pages[r.page_id].url
    odd = warc.derive_pages(pages_of(spark, [(1, None, None), (None, "u", "<p>x"), (1, None, None)])).collect()
    assert len(odd) == 6 and sorted(r.content for r in odd if r.record_type == "conversion") == ["", "", "x"]


def turn_digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_op6_reads_back_every_turn(spark, sf_dir):
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    convs[-7] = [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]
    got = {r.conv_id: r for r in queries.op6_chat(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), turn_digest(turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_markers_and_masks():
    rng = random.Random(1)
    pieces = ["<", "|", ">", "\\", "/", "s", "[", "INST]", "end", "user", " ", "\n", "é", "日", "😀", "<|end|>", "</s>", "[/INST]", "<<SYS>>", "%3c;", "<|endoftext|>", "<|user|>"]
    for _ in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "", "o|>d"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(1, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        under = [s for (role, _), s in zip(turns, spans) if role == "assistant"]
        ids, starts, ends = chat.token_spans(text, TOKENIZER)
        mask, covered = chat.loss_tokens(starts, ends, under)
        assert "".join(map(chat.unescape, chat.masked_text(text, starts, ends, mask))) == "".join(t for r, t in turns if r == "assistant")
        assert [chat.unescape("".join(text[a:b] for a, b in runs)) for runs in covered] == [t for r, t in turns if r == "assistant"]
        inside = [any(a < e and s < b for a, b in under if a < b) for s, e in zip(starts, ends)]
        assert mask.tolist() == inside and len(ids) == len(mask)


def test_a_mask_that_reaches_a_marker_shows():
    text, spans = chat.render([("user", "a"), ("assistant", "b c")])
    _, starts, ends = chat.token_spans(text, TOKENIZER)
    mask, _ = chat.loss_tokens(starts, ends, spans[1:])
    assert chat.masked_text(text, starts, ends, mask) == ["b c"]
    mask[np.flatnonzero(mask)[-1] + 1] = True
    assert chat.masked_text(text, starts, ends, mask) == ["b c<|end|>"]


def test_turns_apart_encode_as_turns_together():
    assert chat.splits_at_end(TOKENIZER)
    rng = random.Random(2)
    pieces = ["<", "|", ">", "\\", " ", "\n", "é", "日", "word", "12", "<|end|>", "<|user|>"]
    turns = [(rng.choice(["user", "assistant", "critic", "", "o|d"]), "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for _ in range(300)]
    whole = chat.token_spans(chat.render(turns)[0], TOKENIZER)[0]
    assert whole == [i for t in turns for i in chat.token_spans(chat.render([t])[0], TOKENIZER)[0]]


def test_chat_on_odd_rows(spark, monkeypatch):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (1, 1, "assistant", None), (None, 0, "user", "lost"), (2, None, "user", "a"), (2, 0, "assistant", "b" * 50_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, now int")
    got = {r.conv_id: r for r in chat.digest_conversations(df, TOKENIZER).collect()}
    assert got[1].turns_sha256 == turn_digest([("", "x"), ("assistant", ""), ("assistant", "")]) and got[1].loss_chars == 0
    assert got[None].n_turns == 1 and got[2].turns_sha256 == turn_digest([("user", "a"), ("assistant", "b" * 50_000)])
    whole = {r.conv_id: r for r in chat.format_conversations(df, TOKENIZER).collect()}
    assert all(len(whole[c].text) == got[c].formatted_chars and len(whole[c].ids) == len(whole[c].loss_mask) for c in got)
    assert chat.digest_conversations(df.where(F.lit(False)), TOKENIZER).count() == 0
    digest = chat._Digest(2)
    monkeypatch.setattr(chat, "FLUSH_CHARS", 10)
    for role, text in [("user", "a"), ("assistant", "b" * 50_000)]:
        digest.add(role, text, TOKENIZER)
    assert digest.row(TOKENIZER) == tuple(got[2])
