"""Main text of pages whose host has several templates."""

from lectern.llm import op6_html_extraction as op6


def texts(spark, *pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in op6.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id").collect()}
    return [got[i] for i in range(len(pages))]


def test_templates_of_a_host_stay_apart(spark):
    pages = ["<article><p>one two</p></article>", "<div class=content><p>three four</p></div>", "<section><p>five six</p></section>"]
    want = ["one two", "three four", "five six"]
    assert texts(spark, *[("http://a.com/x", p) for p in pages]) == want
    assert texts(spark, *zip([None, "x/y", None], pages, strict=True)) == want


def test_sibling_containers_are_kept(spark):
    page = "<div class=menu><a href=x>home</a></div><section class=intro><p>{0} begins</p></section><section class=details><p>{0} goes on for many words</p></section><p>same on all</p>"
    assert texts(spark, *[("http://a.com/x", page.format(w)) for w in ("ant", "bee", "cat")]) == [f"{w} begins {w} goes on for many words" for w in ("ant", "bee", "cat")]


def test_template_on_one_page(spark):
    pages = ["<section><p>one</p></section>", "<section><p>two</p></section>", "<section><p>three</p></section><div class=text><p>only here</p></div>"]
    assert texts(spark, *[("http://a.com/x", p) for p in pages]) == ["one", "two", "three only here"]


def test_layout_names(spark):
    page = "<body class='search no-footer'><div class='layout with-sidebar has-comments'><div class='post-header-wide'><p>{0} main</p></div><div class='site-footer'><p>{0} foot</p></div><div class='comments'><p>{0} said</p></div></div></body>"
    assert texts(spark, *[("http://a.com/x", page.format(w)) for w in ("ant", "bee")]) == ["ant main", "bee main"]


def test_teaser_does_not_hide_the_story(spark):
    page = "<article class='teaser'><p>{0} teaser</p></article><div id='post'><p>{0} the story of many words</p><p>goes on with {0}</p></div>"
    assert texts(spark, *[("http://a.com/x", page.format(w)) for w in ("ant", "bee")]) == [f"{w} the story of many words goes on with {w}" for w in ("ant", "bee")]
    bare = page.replace(" class='teaser'", "")
    assert all("the story of many words" in t for t in texts(spark, *[("http://a.com/x", bare.format(w)) for w in ("ant", "bee")]))


def test_words_of_compound_names(spark):
    inside = "<article><p>{0} main text of words</p>" + "".join(f"<div class='{n}'><p>{{0}} {n}</p></div>" for n in ("comments-section", "ad-banner", "sidebar-left", "post-related")) + "</article>"
    assert texts(spark, *[("http://a.com/x", inside.format(w)) for w in ("ant", "bee")]) == [f"{w} main text of words" for w in ("ant", "bee")]
    names = "sponsored-content sidebar-content comment-content footer-content cookie-content nav-content related-articles user-comment-body".split()
    beside = "<div class='content'><p>{0} main text</p></div>" + "".join(f"<div class='{n}'><p>{{0}} says a lot of other words here {n}</p></div>" for n in names)
    assert texts(spark, *[("http://b.com/x", beside.format(w)) for w in ("ant", "bee")]) == [f"{w} main text" for w in ("ant", "bee")]


def test_match_is_by_the_expression():
    """Repeated groups and optional parts: the page's folded texts come back one by one, in order."""
    pages = ["<div><ul class=a><li>one</li><li>two</li></ul><p>x1</p></div>", "<div><ul class=a><li>three</li></ul><p>x2</p><p>x3</p></div>", "<div><p>x4</p></div>"]
    w = op6.Wrapper()
    for p in pages:
        w = w.merged(op6.Wrapper.of(op6.stream(p)))
    names, tiers = [op6._hash(t) for t in w.tokens], w.slots()
    assert [op6.matched(p, names, tiers) for p in pages] == ["one two x1", "three x2 x3", "x4"]
    assert len([t for t in w.tokens if t[0] == "#"]) == 2  # one slot for all items, one for all paragraphs
