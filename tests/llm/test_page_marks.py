"""Attributes are read whole, and marks do not drop what holds most of a page."""

import time
from html.parser import HTMLParser

import pytest

from steplens.llm import queries as Q
from steplens.llm.html_extract import _marked, extract

LONG = "A paragraph of the story, with commas, clauses, and enough words to count as text of the page. " * 2


@pytest.mark.parametrize("attrs", [' href="/hidden-valley"', ' title="A hidden garden"', ' data-hidden="false"', ' href="/q?role=search"', ' data-id="nav"', " title='class=ad'", ' data-class = "ad"', " href=/id=nav", ' alt="x style=display:none"'])
def test_words_in_values_mark_nothing(attrs):
    assert _marked(attrs) == (False, False)


@pytest.mark.parametrize("attrs, marks", [(" hidden", (True, False)), (' HIDDEN=""', (True, False)), (" class=ad", (False, True)), (' aria-hidden = "true"', (True, False)), (" style='display : none'", (True, False)), (' href="/x" role="navigation"', (False, True))])
def test_marks(attrs, marks):
    assert _marked(attrs) == marks


def test_links_and_wrappers_stay():
    page = f'<body><div class="layout has-sidebar"><div><p>{LONG}</p><p>{LONG}<a href="/hidden-valley">valley</a></p></div><div class="sidebar"><p>Short words of another kind, here.</p></div></div></body>'
    text = extract(page)
    assert text.count("A paragraph") == 4 and "valley" in text and "another kind" not in text


def test_longer_comments_stay_out():
    page = f'<body><div class="layout has-sidebar"><div><p>{LONG}</p><p>{LONG}</p></div><div class="comments">{"<p>A reader says something, at some length, about it.</p>" * 9}</div></div></body>'
    assert extract(page).count("A paragraph") == 4 and "reader" not in extract(page)


P = f"<p>{LONG}</p>"


def framed(body):
    return f'<html><body><nav><a href="/">Home</a></nav>{body}<footer>Copyright, all rights reserved by someone.</footer></body></html>'


@pytest.mark.parametrize(
    "page, also",
    [
        (framed(f'<div class="content has-sidebar">{P * 3}</div>'), ""),
        (framed(f'<div class="post no-comments">{P * 3}</div>'), ""),
        (f'<html><body><form id="aspnetForm"><nav><a href="/">Home</a></nav><label>Search</label><div>{P * 3}</div><footer>Copyright, by someone.</footer></form></body></html>', ""),
        (framed(f'<div class="entry"><div class="entry-header"><h1>The title</h1></div><div class="entry-content">{P * 3}</div></div>'), "The title"),
        (framed(f'<div><h1>The title</h1><div><div>{P * 3}</div></div></div>'), "The title"),
        (framed(f'<article>{P * 3}<p class="share-price">Shares fell, by a third, on the day of the news.</p></article>'), "Shares fell, by a third, on the day of the news."),
        (framed(f"<div id=story><div>{P * 3}</div><div>A short one.</div></div>"), "A short one."),
    ],
)
def test_ordinary_markup_keeps_its_text(page, also):
    text = extract(page)
    assert text.count("A paragraph") == 6 and also in text
    assert not any(w in text for w in ("Home", "Copyright", "Search"))


def test_furniture_goes():
    boxes = "".join(f'<div class="{c}"><p>{LONG.replace("story", "shop")}</p></div>' for c in ("ad", "ad-slot", "cookie-banner", "newsletterSignup", "comment-list", "related-posts", "site-footer", "sidebar left"))
    text = extract(framed(f"<div><div>{P * 9}</div>{boxes}</div>"))
    assert text.count("story") == 18 and "shop" not in text


@pytest.mark.parametrize("page", [lambda n: "<span>" * n + "</x>" * n, lambda n: "<p><table><tr><td>" + "<span>" * n + "<hr>" * n, lambda n: "<div>" * n + P + "</div>" * n])
def test_time_grows_with_the_page_alone(page):
    def least(n):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            extract(page(n))
            times.append(time.perf_counter() - began)
        return min(times)

    assert least(32_000) < 12 * least(4_000)  # 8 is in proportion, 64 the square


class _Articles(HTMLParser):
    """Text blocks of the article element: what the given pages hold, read by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] * (tag in ("article", "p", "h1", "h2", "h3", "ul", "li", "div"))
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] * (tag in ("article", "p", "h1", "h2", "h3", "ul", "li", "div"))

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_every_page_against_another_parser(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = Q.op8_html_extract(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        other = _Articles()
        other.feed(pages[r["page_id"]]["html"])
        want = "\n".join(filter(None, (" ".join(b.split()) for b in other.blocks)))
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))
