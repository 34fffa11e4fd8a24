"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.llm.common import ship, slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|title|textarea|iframe|noembed|noframes|xmp)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)
    |<[!?][^>]*+>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |</?[a-zA-Z][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
#: One attribute after the other, each with its whole name and value, so that no value is read as a name.
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|"[^"]*+"|'[^']*+'""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text, and that end an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li"
    " main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text never belongs to an article, those whose text does inside a line of prose outside forms, and those whose text
#: does only where they hold most of a page.
DROPPED = frozenset("head nav footer aside button select option menu dialog noscript template svg object canvas audio video map datalist label legend".split())
INLINE = frozenset("button label".split())
WRAPPERS = frozenset("form fieldset".split())
#: Words that mark furniture, adverts, notices and reader comments where a name in class, id or role is one of them or ends
#: in one, or begins with one and ends in a word for a box.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices popup modal"
    " overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar sidebars widget widgets menu menus nav navbar navigation"
    " breadcrumb breadcrumbs pagination pager footer header masthead toolbar comment comments disqus reply replies respond response responses discussion copyright contentinfo complementary search".split()
)
#: Of these words the ones that mark inside an article too: by a class or an id, and by a class alone. All others may name what an
#: article is about or be an anchor, and need to be borne out there.
CERTAIN = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion comment comments disqus response responses".split())
BY_CLASS = CERTAIN | frozenset("cookie cookies consent gdpr popup modal newsletter subscribe subscription sidebar sidebars widget widgets menu menus nav navbar breadcrumb breadcrumbs pagination toolbar masthead".split())
#: Words for what readers write, and those that make an aside a part of its article.
READERS = frozenset("comment comments reply replies response responses message".split())
OWN_ASIDE = frozenset("pull pullquote quote quotation footnote footnotes endnote endnotes note notes epigraph callout tip example sidenote".split())
#: Blocks of prose, which no mark drops inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
LINES = PROSE | frozenset("li dd dt td th blockquote figcaption caption".split())
BOXES = frozenset(
    "area bar block body box bottom button buttons column container content footer form group header holder icon icons inner item items left link links list main module outer panel"
    " posts right row section slot space title top unit widget widgets wrap wrapper zone".split()
)
#: Words in front that turn a name's meaning round, and those that make a header one of the article.
NEGATIONS = frozenset("has no not with without hide".split())
OWN_HEADER = frozenset("article content entry post section story title".split())
#: Elements that an element of the key ends where it opens inside them, and those it does not look beyond.
CLOSES = {t: (frozenset(e.split()), frozenset(s.split())) for t, e, s in [("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("tbody", "tbody thead tfoot tr td th", "table"), ("tfoot", "tbody thead tr td th", "table"), ("option", "option", "select"), ("body", "head", "")]}
_PARAGRAPH_STOPS = frozenset("article aside blockquote body button caption details dialog div figure footer form header li main nav section table td th html dd".split())
_RULES = {**CLOSES, "": (frozenset(["p"]), _PARAGRAPH_STOPS)}  # "" is any block
#: The rules that an open element has a part in, as (rule, whether it is ended and not looked beyond).
_PART = {t: [(r, t in ends) for r, (ends, stops) in _RULES.items() if t in ends or t in stops] for ends, stops in _RULES.values() for t in ends | stops}
_HEADING = re.compile("h[1-6]")


def _words(name: str) -> list[str]:
    """The words of a name in lower case, an advert's box that is written as one word as two."""
    parts: list[str] = []
    for w in map(str.lower, _NAME.findall(name)):
        box = next((len(x) for x in ("ads", "ad") if w.startswith(x) and w[len(x) :] in BOXES), 0)
        parts += [w[:box], w[box:]] if box else [w]
    return parts


def _furniture_word(name: str) -> str:
    """The word by which a name marks furniture, or nothing."""
    parts = _words(name)
    if not parts or parts[0] in NEGATIONS:
        return ""
    if parts[-1] in FURNITURE:
        return "" if parts[-1] == "header" and parts[0] in OWN_HEADER else parts[-1]
    return next((w for w in reversed(parts) if w in FURNITURE), "") if parts[-1] in BOXES else ""


def _named(attrs: str) -> list[tuple[str, str]]:
    """(attribute, name) of all names in class, id and role."""
    return [(a.lower(), n) for a, *values in _ATTR.findall(attrs) if a.lower() in ("class", "id", "role") for n in "".join(values).split()]


def _marked(attrs: str) -> tuple[bool, bool]:
    """(hidden, furniture) as the attributes of an element say."""
    hidden = furniture = False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role") and any(map(_furniture_word, value.split())):
            furniture = True
    return hidden, furniture


class _Page:
    """Elements in page order, each with its parent's number, and the text runs between them."""

    def __init__(self, html: str):
        self.tag, self.parent = ["#page"], [0]
        self.hard, self.furniture = [False], [False]
        self.certain, self.readers = [False], [False]  # marked inside an article too; named for what readers write
        self.controls = [0]
        self.runs: list[tuple[int, str | None]] = []  # (element, text), or None for the edge of a block
        self.stack = [0]
        # At each depth the nearest open element that each rule ends, so that no rule walks the open elements.
        self.near: list[dict[str, int]] = [{}]
        self.open: Counter[str] = Counter()
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self.runs.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            if tag := m["tag"]:
                if m["end"]:
                    self._close(tag.lower())
                else:
                    self._open(tag.lower(), m["attrs"])
        if at < len(html):
            self.runs.append((self.stack[-1], html[at:]))

    def _edge(self) -> None:
        self.runs.append((self.stack[-1], None))

    def _cut(self, depth: int) -> None:
        for i in self.stack[depth:]:
            self.open[self.tag[i]] -= 1
        del self.stack[depth:], self.near[depth:]

    def _end(self, rule: str) -> None:
        while depth := self.near[-1].get(rule):
            self._cut(depth)
            self._edge()

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.runs.append((self.stack[-1], " "))
            return
        if tag in BLOCK:
            self._edge()
            self._end("")
        if tag in CLOSES:
            self._end(tag)
        if tag in VOID:
            self.controls[self.stack[-1]] += tag == "input"
            return
        hidden, furniture = _marked(attrs) if attrs else (False, False)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        named = _named(attrs) if furniture or tag == "aside" and attrs else []
        words = [(a, w) for a, n in named if (w := _furniture_word(n))]
        own = tag == "aside" and any(n.startswith("doc-") if a == "role" else not OWN_ASIDE.isdisjoint(_words(n)) for a, n in named)
        own |= tag in INLINE and self._in_line()
        self.hard.append(hidden or tag in DROPPED and not own)
        self.furniture.append(furniture or tag in WRAPPERS)
        self.certain.append(tag in WRAPPERS or any(a == "role" or w in (BY_CLASS if a == "class" else CERTAIN) for a, w in words))
        self.readers.append(any(w in READERS for _, w in words))
        self.controls.append(int(tag in ("form", "select")))
        near = self.near[-1]
        if tag in _PART:
            near = dict(near)
            for rule, ended in _PART[tag]:
                if ended:
                    near[rule] = len(self.stack)
                else:
                    near.pop(rule, None)
        self.near.append(near)
        self.open[tag] += 1
        self.stack.append(len(self.tag) - 1)

    def _in_line(self) -> bool:
        """Whether what opens here stands in a line of prose and in no form."""
        if self.open["form"]:
            return False
        return next((self.tag[i] in LINES for i in reversed(self.stack) if self.tag[i] in BLOCK), False)

    def _close(self, tag: str) -> None:
        if self.open[tag]:
            if tag in BLOCK:
                self._edge()
            depth = len(self.stack) - 1
            while self.tag[self.stack[depth]] != tag:
                depth -= 1
            self._cut(depth)
        elif tag == "p":
            self._edge()


def _borne_out(page: _Page) -> list[bool]:
    """Which marks of furniture count. Inside an article, where names are anchors and subjects too, headings and paragraphs are never
    marked, and other elements by words that leave no doubt, or if links are a third of their text, or if they hold controls or
    several entries of readers. Outside, all marks count, but for headings and paragraphs on the same terms."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    size, linked, readers, controls = [0] * n, [0] * n, list(map(int, page.readers)), page.controls[:]
    story, link, line = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        p = parent[i]
        story[i] = story[p] or tag[p] == "article"
        link[i] = link[p] or tag[i] == "a"
        line[i] = tag[i] in PROSE or line[p] and tag[i] not in BLOCK
    for i, text in page.runs:
        if text is not None:
            size[i] += (length := len(text.strip()))
            linked[i] += length if link[i] else 0
    for i in range(n - 1, 0, -1):
        for x in (size, linked, readers, controls):
            x[parent[i]] += x[i]
    counts = page.furniture[:]
    for i in range(n):
        if counts[i] and (story[i] or line[i]):
            shown = page.certain[i] or 3 * linked[i] > size[i] or controls[i] > 0 or readers[i] > 2
            counts[i] = shown and not (story[i] and line[i])
    return counts


def _points(text: str) -> float:
    return 1.0 + text.count(",") + min(len(text) // 100, 3)


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by line ends; empty if there is none.

    Each block of text passes a point, one for each comma and up to three for its length to the element around it, half
    to the next and less to those beyond; what an element has gathered is discounted by its share of link text. The best
    element is kept, with siblings that score a fifth as much or are plain paragraphs of some length; below the body, with
    every sibling that is not mostly links; and with what holds main headings beside it or beside what it stands in. Marks of furniture that count drop an element's text before
    that, but not where the element holds most of the page's points. The time grows with the length of the page alone.
    """
    if not html:
        return ""
    page = _Page(html)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    furniture = _borne_out(page)
    core, in_article = [False] * n, [False] * n
    shut, points = [False] * n, [0.0] * n
    for i in range(1, n):
        shut[i] = shut[parent[i]] or page.hard[i] or tag[i] == "a"
    for i, text in page.runs:
        if text is not None and not shut[i] and len(text := text.strip()) >= 25:
            points[i] += _points(text)
    clear = points[:]  # without what stands in marked elements further down
    for i in range(n - 1, 0, -1):
        points[parent[i]] += points[i]
        clear[parent[i]] += 0 if furniture[i] else clear[i]
    # Marks do not count on an element with most of the page's points, unless the text seen so far has a quarter of its clear points.
    seen, waived = clear[0], [False] * n
    for i in range(1, n):
        if furniture[i] and 2 * points[i] > points[0] and clear[i] > 4 * seen:
            waived[i] = True
            seen += clear[i]
    for i in range(n - 1, 0, -1):
        core[i] = core[i] or waived[i]
        if core[i] or tag[i] in ("article", "main"):
            core[parent[i]] = True
    gone, link, block = [False] * n, [False] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        in_article[i] = in_article[p] or tag[p] in ("article", "main")
        header = tag[i] == "header" and not in_article[i]
        marked = furniture[i] and tag[i] not in ("html", "body", "main") or header
        gone[i] = gone[p] or page.hard[i] or marked and not core[i]
        link[i] = link[p] or tag[i] == "a"
        block[i] = i if tag[i] in BLOCK else block[p]
    blocks: list[tuple[int, str]] = []  # (element, text)
    size, linked, score = [0.0] * n, [0.0] * n, [0.0] * n
    held: list[str] = []
    owner = links = 0

    def end_block() -> None:
        nonlocal links
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((owner, text))
            size[owner] += len(text)
            linked[owner] += min(links, len(text))
            if len(text) >= 25 and not _HEADING.fullmatch(tag[owner]):
                gain = _points(text)
                up = owner if tag[owner] in ("div", "article", "main", "section", "body", "#page") else parent[owner]
                for level in range(6):
                    score[up] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    if not up:
                        break
                    up = parent[up]
        links = 0

    for i, text in page.runs:
        if text is None:
            end_block()
        elif not gone[i]:
            if "&" in text:
                text = unescape(text)
            if not held:
                owner = block[i]
            held.append(text)
            if link[i]:
                links += len(text)
    end_block()
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
    for i in range(n):
        if tag[i] in ("article", "main") and size[i]:
            score[i] += 25
        score[i] *= 1 - linked[i] / size[i] if size[i] else 0
    best = max(range(n), key=score.__getitem__)
    if score[best] <= 0:
        return "\n".join(t for _, t in blocks)
    titled = [False] * n
    for i, _ in blocks:
        titled[i] = tag[i] in ("h1", "h2")
    for i in range(n - 1, 0, -1):
        titled[parent[i]] |= titled[i]
    # Around the best element stands the rest of the article, unless that is the whole page.
    inner = tag[parent[best]] not in ("#page", "html", "body")
    above, up = {0}, parent[best]
    while up:
        above.add(up)
        up = parent[up]
    keep = [False] * n
    keep[best] = True
    for i in range(1, n):
        if keep[parent[i]]:
            keep[i] = True
        elif i != best and i not in above and parent[i] in above and size[i]:
            density = linked[i] / size[i]
            keep[i] = titled[i] and not density
            if parent[i] == parent[best]:
                keep[i] |= score[i] >= max(10, 0.2 * score[best]) or density < 0.25 and (inner or tag[i] == "p" and size[i] > 80)
    return "\n".join(t for i, t in blocks if keep[i])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): the main text of each whole page. Null or empty html, and pages of furniture alone, give an
    empty text; null and repeated ids and urls pass through; an empty table gives no rows."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = pa.array([extract(h) for h in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
