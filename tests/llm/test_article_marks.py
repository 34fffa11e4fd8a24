"""Inside an article no single word of a class or an id drops text; adverts and comments of readers still go."""

import pytest

from steplens.llm.html_extract import extract

LONG = "A paragraph of the story, with commas, clauses, and enough words to count as text of the page. " * 2
P = f"<p>{LONG}</p>"
NAMES = [f'id="{w}"' for w in ("discussion", "search", "copyright", "related", "notice", "login", "navigation", "sharing")] + ['class="reply"', 'class="section-header"', 'class="wp-block-group banner"']
OWN = "What the authors found, and what follows from it, is the matter of this part."


def framed(body):
    return f'<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1>{P}{body}{P}</article><footer>Copyright, by someone.</footer></body></html>'


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["section", "div", "h2", "p"])
def test_names_are_anchors_and_subjects(tag, name):
    for inner in (OWN, f"<b>{OWN}</b>", f"<p>{OWN}</p><p>{OWN}</p>" if tag in ("section", "div") else OWN):
        text = extract(framed(f"<{tag} {name}>{inner}</{tag}>"))
        assert OWN in text and text.count("A paragraph") == 4 and "Home" not in text


@pytest.mark.parametrize("part", ['<aside class="pullquote">{}</aside>', '<aside role="doc-footnote">{}</aside>', "<aside class='side-note'><p>{}</p></aside>", "<p>{} <math><mi>x</mi></math></p>", "<p><label>{}</label> ends.</p>", "<p>Press <button>{}</button> twice.</p>", "<div><math><mtext>{}</mtext></math></div>"])
def test_parts_of_an_article(part):
    assert OWN in extract(framed(part.format(OWN)))


OTHER = "Somebody else says, at some length, that there is more to it than that, or sells it."


@pytest.mark.parametrize(
    "part",
    ['<div class="responses"><p>{}</p><p>{}</p></div>', '<div class="adslot-300"><p>{}</p></div>', '<div class="adBox">{}</div>', '<section id="comments"><p>{}</p></section>', '<div class="ad">{}</div>', '<div class="newsletter-box"><p>{}</p></div>', "<aside><p>{}</p></aside>", '<aside class="sidebar"><p>{}</p></aside>', '<div role="complementary">{}</div>']
    + ['<div class="related"><a href="/a">{}</a></div>', '<div id="search"><input name="q">{}</div>', '<div id="login"><form><label>{}</label></form></div>', '<div id="discussion"><div class="reply">{}</div><div class="reply">{}</div><div class="reply">{}</div></div>', "<form><p><label>{}</label></p></form>", "<div><label>{}</label></div>", "<div><button>{}</button></div>"],
)
@pytest.mark.parametrize("inside", [True, False])
def test_adverts_readers_and_controls_go(part, inside):
    part = part.replace("{}", OTHER)
    page = framed(part) if inside else framed("").replace("</article>", f"</article>{part}")
    assert OTHER not in extract(page) and extract(page).count("A paragraph") == 4
