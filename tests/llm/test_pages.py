import numpy as np
import pytest

from lookthru.llm import hosts, main_text


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:cut]


def brute_rule(host, path):
    fits = [(r, v) for r, v in hosts.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.NET", "http://example.net/", "http://x.example.com/de/9?q#f", "http://example.com/fr/", "http://b.org/fr/x", "http://b.org/en",
        "notanet/x", None, "", "://", "ftp://fooexample.net/en/", "http://h?x=://y/z", "http://u#/", "http://a.net?/q", "http://1.2.3.4/x", "http://shop.a.co.uk/"]


def test_hosts_and_rules(spark, data):
    given = [(r.page_id, r.url) for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    for rows in (given, list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[3])]):
        pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "'x' as bound", "2 as id")
        labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
        got = hosts.op3_hosts(pages, labels).collect()
        assert len(got) == len(rows)
        want = sorted(str((i, *brute_host(u), brute_rule(*brute_host(u))[0])) for i, u in rows)
        assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in got) == want
        for r in got:
            rule, verdict = brute_rule(r.host, r.path)
            assert r.verdict == (verdict or ("block" if r.bound > 0.5 else "allow"))
    assert hosts.op3_hosts(pages.limit(0), labels).collect() == []
    assert all(r.bound < 0.5 for r in hosts.op3_hosts(pages, labels.limit(0)).collect())


def test_reputation_blocks_what_is_surely_bad(spark):
    rows, bad, n = [], [], 0
    for host, pages, share in (("bad.x.info", 60, 1.0), ("good.x.info", 60, 0.0), ("few.y.info", 1, 1.0), ("new.x.info", 5, None), ("c.co.uk", 30, 0.1)):
        for k in range(pages):
            rows.append((n, f"http://{host}/{k}"))
            if share is not None:
                bad.append((n, k < share * pages))
            n += 1
    got = {r.host: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad boolean")).collect()}
    assert got["bad.x.info"].verdict == "block" and got["bad.x.info"].bound > 0.85
    assert all(got[h].verdict == "allow" for h in ("good.x.info", "few.y.info", "new.x.info", "c.co.uk"))
    assert got["few.y.info"].bound > got["good.x.info"].bound


def test_bound_equals_simulation():
    rng = np.random.default_rng(1)
    for a, b in ((2, 8), (50, 50), (0.5, 3), (400, 30)):
        found = hosts.lower_bound(np.array([float(a)]), np.array([float(b)]), 0.95)[0]
        assert found == pytest.approx(np.quantile(rng.beta(a, b, 400_000), 0.05), rel=0.02)


def test_suffixes(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("a.b.com",), ("com",), ("",), ("1.2.3.4",), ("x.fr",)], "host string").withColumn("suffix", hosts.suffix(F.col("host")))
    got = [(r.suffix, r.d) for r in df.withColumn("d", hosts.registered(F.col("host"), F.col("suffix"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "b.com"), ("com", "com"), ("", ""), ("1.2.3.4", "1.2.3.4"), ("fr", "x.fr")]


def test_extraction_of_one_page():
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies, ok</div>
    <div class="content"><div class="post"><h1>T&amp;itle</h1><p>One, two,   three words<br>here <a href=x>link</a>.</p><script>var t="</p>";</script><ul><li>a</li><li>b c</ul><table><tr><td>1<td>2</table>
    <p>More&nbsp;text &#8212; x<!-- no --></p><div class="comments"><p>nice, very nice, I, agree, with, this, all</p></div></div><div class="sidebar"><ul><li><a href=1>L1</a></ul></div>
    <form><input name=q>Search</form><footer>c</footer>"""
    assert main_text.extract(html) == "T&itle One, two, three words here link. a b c 1 2 More text — x"


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("plain, no tags", "plain, no tags"), ("<p>a<p>b<script>x<y", "a b"), ("<nav>x</nav>", ""), ("<p>a < b &lt; c</p>", "a < b < c"),
                                        ("<p>x<b>y</p>z", "xy z"), ("<article><p>short</p></article><div><p>" + "long, text " * 20 + "</p></div>", None)])
def test_odd_pages(html, text):
    got = main_text.extract(html)
    assert got == text if text is not None else got


def test_deep_and_long_pages():
    assert main_text.extract("<div>" * 30_000 + "hello, there" + "</div>" * 30_000) == "hello, there"
    assert len(main_text.extract("<article>" + "<p>word, word</p>" * 20_000)) == 20_000 * 11 - 1


def test_given_pages(spark, data):
    import html as h
    import re

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r for r in main_text.op8_main_text(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(h.unescape(re.sub("</?b>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == " ".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2)], "page_id long, url string, html string, id int")
    assert sorted(str(tuple(r)) for r in main_text.op8_main_text(odd).collect()) == sorted(str(x) for x in [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)])
    assert main_text.op8_main_text(odd.limit(0)).collect() == []


LONG = "Long text, with commas, and more words here to score. " * 6


def page(body):
    return f"<html><body><nav><a href=1>menu</a></nav>{body}<footer>foot</footer></body></html>"


@pytest.mark.parametrize("wrapper", ["<div class='content with-sidebar'>%s</div>", "<div class='page no-comments'>%s</div>", "<div class='article has-header'>%s</div>",
                                     "<div class='warning-free'>%s</div>", "<section class='post-hero header-image'>%s</section>", "<form action=x>%s<input name=a><button>Go</button></form>",
                                     "<div class='header'>%s</div>", "<body class='sidebar'>%s"])
def test_wrappers_of_the_whole_page_stay(wrapper):
    text = " ".join(LONG.split())
    assert main_text.extract(page(wrapper % f"<p>{LONG}</p><p>{LONG}</p>")) == f"{text} {text}"


def test_nothing_inside_the_article_is_left_out_for_its_links():
    html = page(f"<article><h1>Head</h1><p>{LONG}</p><p><a href=x>a paragraph that is mostly a link</a> indeed</p><p>{LONG}</p>"
                "<ul><li><a href=1>Ref one</a></li><li><a href=2>Ref two</a></li></ul><p>End.</p></article>")
    text = " ".join(LONG.split())
    assert main_text.extract(html) == f"Head {text} a paragraph that is mostly a link indeed {text} Ref one Ref two End."


def test_short_siblings_of_the_same_kind_and_headings_between_stay():
    text = " ".join(LONG.split())
    html = page(f"<div id=c><h2>First</h2><div class=part><p>{LONG}</p></div><h2>Second</h2><div class=part><p>{LONG}{LONG}</p></div>"
                "<div class=links><a href=1>one</a> <a href=2>two</a></div><div class=part><p>Short end.</p></div></div>")
    assert main_text.extract(html) == f"First {text} Second {text} {text} Short end."


@pytest.mark.parametrize("name", ["comments", "comment-list", "post-comments", "commentlist big", "user-comments"])
def test_reader_comments_are_left_out_however_long(name):
    html = page(f"<div class=story><p>{LONG}</p></div><div class='{name}'><p>{LONG * 9}</p><p>{LONG * 9}</p></div>")
    assert main_text.extract(html) == " ".join(LONG.split())


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "left-sidebar", "cookie-notice", "ad", "ad-slot", "share_buttons", "newsletter-signup", "related"])
def test_named_boxes_are_left_out(name):
    html = page(f"<div class=story><p>{LONG}</p><div class='{name}'><p>Box text, of some length, in here.</p></div></div>")
    assert main_text.extract(html) == " ".join(LONG.split())
