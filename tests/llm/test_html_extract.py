import random

import numpy as np

from logstrata.llm import html_extract as hx


def text(page):
    return "\n".join(t for _, t in hx.blocks(page))


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page">
    <nav><ul><li><a href="/a>b">menu</a></ul></nav><!-- ad --><div class="ad banner">buy</div><div class="cookie-notice"><p>cookies</div>
    <article><header><h1>Title &amp;&lt;b&gt;</h1></header><p><b>First<br>line&nbsp;  here<p>second &copy; &#233;&#x41; &unknown; a < b<div id="ad-1">x</div>
    <aside>side</aside><form>name</form><ul><li>one<li>two</ul><script>1 < 2</script><table><tr><td>cell<td>next</table><section class="comments"><p>me too</p></section></article>
    <footer>foot</footer></body></html>"""
    assert text(page) == "Title &<b>\nFirst line here\nsecond © éA &unknown; a < b\none\ntwo\ncell\nnext"


def test_containers():
    assert text("<p>out</p><main><p>in</p><div role=complementary>x</div></main>") == "in"
    assert text("<header>h</header><div id=content><p>in</div><div class=sidebar>s</div><p>after") == "in"
    assert text("<p>only</p><p hidden>no</p><p style='display: none'>no</p>") == "only"
    assert text("<article class='comment'><p>c</p></article><article><p>a</p></article>") == "a"

    for mark in ("commentlist", "comment-form", "topnav", "siteFooter", "left-sidebar", "adslot", "newsletter_box", "cookies"):
        assert text(f"<article><p>a</p><div class='x {mark}'>b</div><p class='commentary'>c</p></article>") == "a\nc", mark


def test_broken_pages():
    for page, want in (("", ""), ("plain", "plain"), ("<p>a<p", "a"), ("<p>a</", "a"), ("<p>a<!-- b", "a"), ("<p>a<script>b", "a"), ("<p>x</div>y</p>", "x\ny"), ('<a title="x>y">z</a>', "z"), ("<p title='>a", "a"), ("a</>b", "a</>b"), ("&am", "&am"), ("&amp", "&"), ("<P>A</P>", "A")):
        assert text(page) == want, page
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(text("<article><p>" + "word " * 200_000)) == 999_999


def brute_cover(streams, run, pages):
    kinds = {tuple(s) for s in streams}
    holders = {}
    for s in kinds:
        for i in range(len(s) - run + 1):
            holders.setdefault(s[i : i + run], set()).add(s)
    out = []
    for s in streams:
        inside = np.zeros(len(s), bool)
        for i in range(len(s) - run + 1):
            if len(holders[tuple(s[i : i + run])]) >= pages:
                inside[i : i + run] = True
        out.append(inside)
    return out


def test_cover_equals_brute_force():
    rng = random.Random(1)
    for trial in range(150):
        streams = [rng.choices("abc" if trial % 2 else "abcdefgh", k=rng.randrange(14)) for _ in range(rng.randrange(1, 9))]
        streams += streams[:2]
        run, pages = rng.randrange(1, 7), rng.randrange(1, 5)
        for got, want in zip(hx.covered(streams, run, pages), brute_cover(streams, run, pages), strict=True):
            assert (got == want).all()
    assert hx.covered([], 3, 2) == []


def pages_without_container(n):
    return [f"<div><p>Home news sport weather about us contact help now</p><p>story {i} {'unique words %d ' % i * 6}</p><p>All rights reserved by the owner of this fine site</p></div>" for i in range(n)]


def test_repetition_decides_where_nothing_is_named(spark):
    rows = [(i, f"http://h{i % 2}.test/{i}", p) for i, p in enumerate(pages_without_container(10))]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t.startswith(f"story {i} ") and "\n" not in t for i, t in got.items())


def test_unique_runs_inside_a_block_stay(spark):
    tail = "printed with the kind permission of the owner of this fine site"
    lead = "you are reading the paper of the town by the river"
    pages = [f"<p>{lead} {i} is the story of day {i * 7} {tail}</p><p>{'own words %d ' % i * 5}</p>" for i in range(5)]
    df = spark.createDataFrame([(i, "http://h.test/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got == {i: f"{i} is the story of day {i * 7}\n" + " ".join(["own words %d" % i] * 5) for i in range(5)}
    off = {r.page_id: r.text for r in hx.extract(df, repeated=6).collect()}  # nothing is on six pages
    assert all(lead in off[i] and tail in off[i] for i in range(5))


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert text("<div>" * 100_000 + "deep<p>x" * 2) == "deep\nxdeep\nx"
    assert text("<p><b>" * 50_000 + "deep") == "deep"
    assert time.perf_counter() - began < 20


def test_articles_stay_whole_though_repeated(spark):
    body = "the same article with quite a few words in it that others copy"
    rows = [(i, "http://h.test/", f"<nav>menu</nav><article><p>{body} {i % 3}</article>", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert {(r.page_id, r.text, r.n_chars) for r in hx.extract(df).collect()} == {(i, f"{body} {i % 3}", len(body) + 2) for i in range(9)}


def test_nulls_copies_large_hosts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(hx, "GROUP", 4)
    pages = pages_without_container(40)
    rows = [(i, "http://h.test/", p) for i, p in enumerate(pages)] + [(100, None, None), (101, "http://h.test/", ""), (102, None, "<p>alone"), (103, "bad", "<p>\U0001f600"), (102, None, "<p>alone"), (None, None, "<p>no id")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = hx.extract(df).collect()
    assert len(found) == len(rows)
    got = {r.page_id: (r.text, r.n_chars) for r in found}
    assert got[100] == got[101] == ("", 0)
    assert got[102] == ("alone", 5)
    assert got[103] == ("\U0001f600", 1)
    assert got[None] == ("no id", 5)
    assert all(f"story {i} " in got[i][0] for i in range(40))
    assert hx.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(hx, "MOST_BROADCAST", 0)
    assert hx.extract(df).count() == len(rows)


def test_parts_of_a_large_host_decide_as_one(spark, monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(30)]
    pages = [f"<p>{'own words %d ' % i * 5}</p>" + "".join(f"<p>{line}</p>" for line in rng.sample(lines, 2)) for i in range(60)]
    pages += [f"<nav>{i}</nav>{pages[0]}" for i in range(40)] + [f"<p>{'once more %d ' % i * 5}</p><p>on two different pages only, though one of them is copied often</p>" for i in range(2) for _ in range(9)]
    rows = [(i, "http://h.test/", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    one = {r.page_id: r.text for r in hx.extract(df).collect()}
    monkeypatch.setattr(hx, "GROUP", 4)
    assert {r.page_id: r.text for r in hx.extract(df).collect()} == one
    holders = {line: len({p for p in pages[:60] if line in p}) for line in lines}
    assert 0 < sum(k >= 3 for k in holders.values()) < 30
    assert all((line in one[i]) == (holders[line] < 3) for i in range(60) for line in lines if line in pages[i])


def test_container_is_where_the_text_is():
    assert text("<main><h1>Headline</h1><p>long text</p><article class=card><p>teaser</p></article></main>") == "Headline\nlong text\nteaser"
    long = "a story of some length that no box holds"
    for box in ("<div class='post'>x", "<div class='entry'>x", "<div id=content>x", "<article>x"):
        assert text(f"<p>{long}</p>{box}</{box[1:4] if box[1] == 'd' else 'article'}><p>{long}</p>") == f"{long}\nx\n{long}", box


def test_marks_do_not_leave_out_what_holds_the_text():
    for mark in ("layout no-sidebar", "has-comments", "nav-open", "page with_menu", "sidebar", "site-header", "widget"):
        assert text(f"<div class='{mark}'><article><p>the whole text</p></article><div class=sidebar>s</div></div>") == "the whole text", mark
        assert text(f"<div class='{mark}'><p>the whole text</p><div class=sidebar>s</div></div><p>x</p>") == "the whole text\nx", mark
    assert text("<div class=cookie-wrapper><main><p>text</p></main></div>") == "text"
    assert text("<form><p>all of the page</p><div class=ad>buy</div></form>") == "all of the page"


def test_marks_leave_out_what_is_longer_than_the_text():
    long = "many words that are not what the page is for " * 5
    for mark in ("comments", "commentlist", "related-posts", "cookie-notice", "ads", "newsletter"):
        assert text(f"<article><p>a</p></article><div class='{mark}'><article><p>{long}</p></article></div>") == "a", mark
        assert text(f"<p>a</p><div class='{mark}'><p>{long}</p></div>") == "a", mark
    assert text(f"<p>a</p><div class=menu><ul><li><a href=/>{long}</a></ul></div>") == "a"
    assert text(f"<article><p>a</p></article><div class=sidebar><p>{long}</p></div>") == "a"
    assert set(text("<main>" + "<div class=menu>x" * 3000 + "</main>").split("\n")) == {"x"}  # nested deep


def test_what_most_pages_have_is_left_out_of_articles(spark, monkeypatch):
    notice = "write to the editors of this paper if you find an error here"
    pages = [f"<article><p>{'own words %d ' % i * 9}</p><p>{notice}</p><p>{'the end %d ' % i * 9}</p></article>" for i in range(30)]
    few = "an old saying that three of the writers like to quote in full"
    pages += [f"<article><p>{'other words %d ' % i * 9}</p><p>{few}</p></article>" for i in range(3)]
    pages += [f"<article><p>copied here {i}</p><p>{notice}</p></article>" for i in range(3)]
    df = spark.createDataFrame([(i, "http://h.test/", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    for group in (512, 4):
        monkeypatch.setattr(hx, "GROUP", group)
        got = {r.page_id: r.text for r in hx.extract(df).collect()}
        assert all(notice not in got[i] and got[i].count("\n") == 1 for i in range(30))
        assert all(few in got[i] for i in range(30, 33)) and all(notice in got[i] for i in range(33, 36))
