"""Blocks that the votes of a host leave out, whatever their class, and what stays in an article."""

from helpers import prose

from brinework.llm.host_paths import Page, main_text

NOTICE = "<div class=cmp-wrapper><p>We and our partners keep small files on your device to measure what you read.</p></div>"


def texts(spark, pages, host="h.example"):
    rows = [(i, f"http://{host}/{i}", f"<html><body>{p}</body></html>") for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def one(text):
    return " ".join(text.split())


def comment(i):
    return f"<div class='c-row r{i}'><span class=user-{i}>reader{i}</span><p>{prose(900 + i, 12)}</p></div>"


def template(i, opinions):
    links = "".join(f"<li><a href=/{i}{k}>{prose(50 * i + k, 4)}</a></li>" for k in range(5))
    under = f"<section class={'reader-opinions' if i % 2 else 'c-list'}><h3>Readers</h3>{''.join(map(comment, range(40 * i, 40 * i + opinions)))}</section>" if opinions else ""
    return f"{NOTICE}<div class=story><h1>Title {i}</h1><div class=lead>{prose(i, 30)}</div><p>{prose(100 + i, 90)}</p></div><div class=more><ul>{links}</ul></div>{under}"


def test_blocks_of_any_class(spark):
    """No page has an article element; one page of each kind has a single comment, which only its host's votes tell."""
    opinions = [3, 4, 2, 5, 1, 1, 0, 2]
    pages = [template(i, n) for i, n in enumerate(opinions)]
    got = texts(spark, pages)
    assert got == {i: one(f"Title {i} {prose(i, 30)} {prose(100 + i, 90)}") for i in range(len(pages))}
    alone = {i: Page(f"<html><body>{p}</body></html>").text(None) for i, p in enumerate(pages)}
    assert sum(alone[i] != got[i] for i in got) == len(pages)  # the host changes every page


def test_copies_are_no_template(spark):
    """Pages that are copies of one another but for an advert keep their text; so do articles that share a short block twice only."""
    body = f"<div class=story><div class=one>{prose(1, 40)}</div><div class=two>{prose(2, 60)}</div></div>"
    copies = [f"<div class=x>{prose(300 + i, 5)}</div>{body}" for i in range(6)]
    assert all(one(f"{prose(1, 40)} {prose(2, 60)}") in t for t in texts(spark, copies).values())
    short = [f"<div class=story><div class=by>Staff</div><p>{prose(400 + i, 60)}</p></div>" for i in range(2)]
    assert texts(spark, short) == {i: one(f"Staff {prose(400 + i, 60)}") for i in range(2)}


def test_article_words_are_no_menus(spark):
    for kind in ("class=related-work", "id=related-work", "class=share-price", "class=col-search-results", "class=discussion", "class='no-sidebar has-comments'", "class=category-cookies"):
        page = f"<article><h1>Head</h1><section {kind}><p>{prose(7, 20)}</p></section><p>{prose(8, 50)}</p></article>"
        assert texts(spark, [page]) == {0: one(f"Head {prose(7, 20)} {prose(8, 50)}")}, kind
    for kind in ("related-posts", "shareButtons", "social-share", "comment-list", "site-search", "cookie-notice", "ad", "widget"):
        page = f"<article><h1>Head</h1><p>{prose(8, 50)}</p><div class={kind}><p>{prose(7, 20)}</p></div></article>"
        assert texts(spark, [page]) == {0: one(f"Head {prose(8, 50)}")}, kind


def test_pages_of_lists_and_threads_stay(spark):
    """A page that is nothing but links, or posts with authors, keeps them; articles under their authors are no comments."""
    links = "<div class=all>" + "".join(f"<p><a href=/{k}>{prose(k, 6)}</a></p>" for k in range(5)) + "</div>"
    posts = "<div class=posts>" + "".join(map(comment, range(4))) + "</div>"
    teasers = f"<div class=top><p>{prose(70, 40)}</p></div><div class=list>" + "".join(f"<article><b class=author>A{k}</b><p>{prose(80 + k, 30)}</p></article>" for k in range(3)) + "</div>"
    got = texts(spark, [links, posts, teasers])
    assert got[0] == one(" ".join(prose(k, 6) for k in range(5))) and all(prose(900 + i, 12) in got[1] for i in range(4)) and "A0" in got[2]


def test_hosts_differ_and_rows_repeat(spark):
    rows = [(i % 4, f"http://{h}/{i}", f"<body>{template(i, 2)}") for i in range(4) for h in ("a.example", "b.example") for _ in range(2)] + [(9, None, template(3, 3)), (10, "http://c.example", None), (None, None, "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.url, r.text) for r in main_text(frame).collect()]
    assert len(got) == len(rows) and all(t == one(f"Title {i} {prose(i, 30)} {prose(100 + i, 90)}") for i, u, t in got if u and "c.example" not in u)
    assert "reader" not in next(t for i, u, t in got if i == 9) and [t for i, _, t in got if i in (10, None)] == ["", ""]
