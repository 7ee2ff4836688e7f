"""Articles whose text lies in containers of their own, and hosts whose pages differ."""

from brinework.llm.host_paths import main_text

NAV = "<nav><a href=x>Menu</a></nav>"
LONG = "words that make up the body of it " * 9


def texts(spark, *pages):
    rows = [(i, f"http://h.example/{i}", f"<html><body>{NAV}{p}<footer>end</footer></body></html>") for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_nested_article_is_whole(spark):
    page = f"<article><h1>Title</h1><p>lead</p><div class=body><p>{LONG}</div></article>"
    whole = " ".join(f"Title lead {LONG}".split())
    assert texts(spark, page, page) == {0: whole, 1: whole}


def test_sections_stay_together(spark):
    short, whole = "a short section", " ".join(f"a short section {LONG}".split())
    for around in ("article", "main", "div", "center"):
        page = f"<{around}><section class=one><p>{short}</section><section class=two><p>{LONG}</section></{around}>"
        assert texts(spark, page, page) == {0: whole, 1: whole}


def test_deeper_containers_stay_together(spark):
    page = f"<div class=post><h1>Title</h1><div class=wrap><div class=in><p>{LONG}</div></div><div class=more><p>tail</div></div>"
    whole = " ".join(f"Title {LONG} tail".split())
    assert texts(spark, page, page) == {0: whole, 1: whole}


def test_page_of_another_template(spark):
    usual = f"<div class=post><p>{LONG}</div>"
    other = f"<div class=post><p>teaser</div><article><p>{LONG} other</article>"
    got = texts(spark, usual, usual, usual, other)
    assert got[0] == " ".join(LONG.split()) and got[3] == " ".join(f"{LONG} other".split())


def test_sections_directly_in_the_body(spark):
    page = f"<h1>Title</h1><section class=one><p>a short section</section><section class=two><p>{LONG}</section>"
    whole = " ".join(f"Title a short section {LONG}".split())
    assert texts(spark, page, page) == {0: whole, 1: whole}


def test_deep_and_broken_pages_take_linear_time():
    import time

    from brinework.llm.host_paths import Page

    pages = {"<div>" * 100_000 + "deep" + "</div>" * 100_000: "deep", "<a b='x>y" * 100_001: None, '<p t="' + '<a b="c ' * 100_000: None, "<b>" * 100_000 + "in<p>more" * 1000: None, "<" * 200_000: None, "<div>" * 50_000 + "</i>" * 100_000 + "end": "end"}
    began = time.time()
    for source, want in pages.items():
        page = Page(source)
        text = page.text(page.path(page.best()))
        assert want is None or text == want
    assert time.time() - began < 60


def test_formulas_are_text():
    from brinework.llm.host_paths import Page

    page = Page("<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><svg><text>drawn</text></svg></article>")
    assert page.text(None).replace(" ", "") == "Wherex=2holds."
