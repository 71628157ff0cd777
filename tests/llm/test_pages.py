"""Main text of pages whose markup claims only some lines."""

import random
import time

from gridvalue.llm import html_text


def text_of(html, other=""):
    return html_text.main_text(html_text.lines_of(html), html_text.lines_of(other))


def test_open_lines_beside_an_article_are_differenced():
    page = "<div>Site</div><article><p>Teaser {0}</p></article><div>Body {0}</div><div>All rights reserved</div>"
    assert text_of(page.format(1), page.format(2)) == "Teaser 1\nBody 1"
    assert text_of("<article><p>Site</p></article>", "<div>Site</div>") == "Site"


def test_names_do_not_claim_what_holds_an_article():
    wrapped = '<div class="page has-sidebar"><p>Lead {0}</p><article class="post has-sidebar"><p>Body {0}</p></article></div>'
    assert text_of(wrapped.format(1)) == "Lead 1\nBody 1"
    assert text_of('<nav class="menu"><article>menu</article></nav><main id="menu"><p>x</p></main>') == "x"


def test_names_inside_an_article_need_the_neighbour():
    page = ('<article><div class="entry-header"><h1>Title {0}</h1></div><p class="notice">Note {0}</p><p>Body {0}</p>'
            '<div class="share">Share this</div></article>')
    assert text_of(page.format(1), page.format(2)) == "Title 1\nNote 1\nBody 1"


def test_names_without_an_article_need_the_neighbour():
    page = '<div class="content has-sidebar"><p>Body {0}</p></div><div class="sidebar">Links</div>'
    assert text_of(page.format(1), page.format(2)) == "Body 1"
    beside = '<article><p>Body {0}</p></article><div class="ad">Buy {0}</div>'
    assert text_of(beside.format(1), beside.format(2)) == "Body 1"


def test_copies_are_compared_with_other_content(spark):
    def page(i, url, body):
        return i, url, f"<div>Site</div><p>{body}</p><div>All rights reserved</div>"

    rows = [page(1, "http://s.org/a?x=1", "First"), page(2, "http://s.org/a?x=2", "First"), page(2, "http://s.org/a?x=2", "First"),
            page(3, "http://s.org/b", "Second"), page(4, "http://s.org/b/1", "Second"), (5, "http://s.org/a", ""),
            *(page(i, "http://lone.org/", "Alone") for i in range(6, 40))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract_pages(pages).collect())
    assert got == [(1, "First"), (2, "First"), (2, "First"), (3, "Second"), (4, "Second"), (5, ""),
                   *((i, "Site\nAlone\nAll rights reserved") for i in range(6, 40))]


def test_comments_adverts_and_teasers_go_inside_and_outside_articles():
    for page in (
        '<article><p>Body {0}</p><div class="comments"><p>Reader {0} says hi</p></div><div class="ad">Buy {0}</div></article>',
        '<p>Body {0}</p><section id="comments"><p>Reader {0} says hi</p></section><div class="ad-slot">Buy {0}</div>',
        '<main><p>Body {0}</p><section class="related"><article>Teaser {0}</article></section></main>',
        '<article><p>Body {0}</p></article><div id="comments"><article class="comment">Reader {0}</article></div>',
    ):
        assert text_of(page.format(1), page.format(2)) == text_of(page.format(1)) == "Body 1"


def test_a_name_around_all_of_a_page_drops_nothing():
    for page in ('<div class="comments-open"><p>Body {0}</p><p>End</p></div>', '<div class="share"><p>Body {0}</p></div>',
                 '<div class="share"><article>Body {0}</article></div>'):
        assert text_of(page.format(1)).startswith("Body 1")


def test_alignment_is_longest():
    draw = random.Random(1)
    for _ in range(500):
        kinds = draw.choice([1, 2, 3, 9])
        a, b = ([draw.randrange(kinds) for _ in range(draw.randrange(15))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = html_text.shared_lines(a, b)
        rest = iter(b)
        assert sum(shared) == best[-1][-1] and all(x in rest for x, s in zip(a, shared) if s)


def test_repeated_lines_and_deep_pages_take_little_time():
    start = time.monotonic()
    lines = ["same"] * 10_000
    assert sum(html_text.shared_lines(["a", *lines, "b"], ["c", *lines, "d"])) == 10_000
    assert html_text.lines_of("<div>" * 25_000 + "x") == [("x", html_text.OPEN)]
    article = "<article>" + "".join(f"<p>Line {i} of a long text</p>" for i in range(40_000)) + "</article>"
    assert text_of("<nav>Menu</nav>" + article).split("\n") == [f"Line {i} of a long text" for i in range(40_000)]
    assert time.monotonic() - start < 30
