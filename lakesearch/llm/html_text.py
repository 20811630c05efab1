"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass decides blocks by where they stand (menus, page headers and
footers, sidebars, notices, adverts, forms, comments), by the share of their text inside links, by length and by the
density of stop words; short blocks stay open, and so do longer ones with few stop words.  The second pass gives open
blocks the label of the nearest decided neighbours.

Where a block stands is told by tags (``nav``, ``footer``, ...) and by marks: words in ``class``, ``id`` and ``role``, and
``form``.  A mark is evidence only: an element that holds most of the page's articles, or without articles most of its dense
text, isn't what its mark says (a layout called ``right-sidebar``, a form around the whole page).  ``html``, ``body`` and
``main`` have no marks, and ``article`` none but that of a comment.

Markup may be broken.  Elements end with their parents; ``script``, ``style`` and ``textarea`` without an end and open comments
reach to the end of the page as in browsers, other elements whose content isn't text end at the next paragraph or section.
Every character is looked at a bounded number of times.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset("the of and to in is that it for was with as on be at by this are from or an not have but which they you his her der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an le la les de des du un une et est que qui dans pour par sur au avec ne se pas plus el los las y en por con para una su al lo como más".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_HOLDS = frozenset("article aside body dialog div dl fieldset figure footer form head header html li main menu nav ol section table td tr ul".split())
#: Elements whose own kind opens beside them, not inside.
_SIBLINGS = frozenset("li td tr".split())
_BAD_TAGS = frozenset("nav footer aside menu head".split())
#: Elements that may be wrapped around a whole page.
_MARKED_TAGS = frozenset("form fieldset dialog".split())
#: Elements whose content is no markup; without an end tag the first three reach to the end of the page, the others are left out.
_RAW = frozenset("script style textarea iframe noembed noframes xmp title".split())
_TO_THE_END = frozenset("script style textarea".split())
#: Elements whose content is no text of the page, and tags that don't stand in them.
_SKIPPED = frozenset("noscript template svg select object button math canvas audio video".split())
_NOT_SKIPPED = frozenset("article body footer form h1 h2 h3 h4 h5 h6 header main nav ol p section table ul".split())
_IN_HEAD, _PARTS = frozenset("html head title".split()), frozenset("article body main".split())
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_NEXT = re.compile(r"""=\s*+(["'])|>""")
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_CLOSING = re.compile(r"</([a-zA-Z]+)")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
#: Words in class, id or role that name something other than main text, and those of comments (fixed values).
_BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Parts of names that say that something is absent or switched (fixed values).
_STATES = frozenset("no not without open closed enabled disabled off on".split())
#: Parts of names that say that an element is a box for something (fixed values).
_BOXES = frozenset("area articles bar block bottom box button buttons container content form group inline inner item items left links list outer panel posts right row section slot top unit wrap wrapper".split())
_SPACE = re.compile(r"[\s ]+")
_HIDDEN, _QUOTED = re.compile(r"(?<![^\s\"/])hidden(?![^\s=/])"), re.compile(r"\"[^\"]*+\"|'[^']*+'")
_NONE = re.compile(r"""(?<![^\s"'/])style\s*+=\s*+(?:"[^"]*?|'[^']*?)display\s*+:\s*+none""", re.I)
#: Ends of sentences in any script.
_SENTENCE = re.compile(r"[.!?…](?=\s|\Z)|[。！？｡।؟۔։።]")

SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.33, 0.15, 0.25
#: Share of stop words below which a page's language is taken for unknown; characters of a sentence at most, on average.
UNKNOWN, SENTENCE = 0.06, 300


class Tags:
    """Tags of a page, read from a place on: (start, end, closing, name, attributes); comments and declarations have no name."""

    def __init__(self, page: str):
        self.page = page
        self.unclosed: set[str] = set()
        self.quotes = True

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        start = at
        while self.quotes:
            m = _NEXT.search(self.page, at)
            if m is None:
                self.quotes = False  # no tag from here on is complete with its quotes, so they mean nothing any more
            elif m[1] is None:
                return m.start()
            elif m[1] in self.unclosed:
                at = m.end()
            elif (close := self.page.find(m[1], m.end())) < 0:
                self.unclosed.add(m[1])
                at = m.end()
            else:
                at = close + 1
        return self.page.find(">", start)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if m := _PLAIN.match(page, at):
                return at, m.end(), bool(m[1]), m[2].lower(), m[3]
            if m := _NAME.match(page, at):
                end = self._end(m.end())
                return (at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]) if end >= 0 else None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, False, "", ""
            if page.startswith("<![CDATA[", at):
                return at, at + 9, False, "", ""
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                return (at, end + 1, False, "", "") if end >= 0 else None
            at += 1
        return None


def _marks(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """(marked as something other than main text, marked as comments); ``inside`` an article a name with another word in it
    (``related-work``, ``ad-hoc-methods``) is no mark, only one for a box of such things."""
    if tag in ("html", "body", "main"):
        return False, False
    marked = tag in _MARKED_TAGS
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", name)
            if not _STATES.isdisjoint((parts[0], parts[-1])):
                continue
            if not _COMMENTS.isdisjoint(parts):
                return marked, True
            named = not _BAD_NAMES.isdisjoint(parts) and (not inside or all(x in _BAD_NAMES or x in _BOXES or x.isdigit() or not x for x in parts))
            marked |= tag != "article" and named
    return marked, False


def _is_hidden(attributes: str) -> bool:
    """Do attributes say that an element isn't shown?"""
    low = attributes.lower()
    return ("hidden" in low and bool(_HIDDEN.search(_QUOTED.sub('""', low)))) or ("none" in low and bool(_NONE.search(low)))


class _Page:
    """Blocks of a page while its tags are read."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, bool, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, int, int, int, int]] = []
        self.names: Counter[str] = Counter()
        #: Parent of each mark; the first stands for none.
        self.marks = [0]
        self.bad = self.inside = self.skipped = self.mark = 0
        self.links = self.heading = False

    def text(self, piece: str) -> None:
        if piece and not self.skipped:
            self.parts.append(piece)
            if self.links:
                self.linked.append(piece)

    def end(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", html.unescape("".join(self.linked))).strip()) if self.linked else 0
                self.blocks.append((text, linked, self.bad > 0, self.mark, self.inside > 0, self.heading))
            self.parts, self.linked = [], []

    def pop(self) -> str:
        tag, bad, inside, skipped, mark = self.open.pop()
        self.names[tag] -= 1
        self.bad, self.inside, self.skipped, self.mark = self.bad - bad, self.inside - inside, self.skipped - skipped, mark
        return tag

    def skip(self, tag: str) -> None:
        self.open.append((tag, 0, 0, 1, self.mark))
        self.names[tag] += 1
        self.skipped += 1

    def push(self, tag: str, attributes: str) -> None:
        marked, comments = _marks(tag, attributes, self.inside > 0)
        bad = int(tag in _BAD_TAGS or comments or (bool(attributes) and tag not in ("html", "body") and _is_hidden(attributes)) or (tag == "header" and not self.inside))
        inside = int(tag in ("article", "main") and not bad)
        self.open.append((tag, bad, inside, 0, self.mark))
        self.names[tag] += 1
        self.bad, self.inside = self.bad + bad, self.inside + inside
        if marked and not bad:
            self.marks.append(self.mark)
            self.mark = len(self.marks) - 1

    def close(self, tag: str) -> None:
        if self.names[tag]:
            while self.pop() != tag:
                pass


def blocks(page: str | None) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters in links, in a part that isn't main text, in an article or main part, heading) by block."""
    page = page or ""
    p, at, tags = _Page(), 0, Tags(page)
    left = Counter(t for t in (m[1].lower() for m in _CLOSING.finditer(page)) if t in _SKIPPED or t in _BAD_TAGS)
    missing: set[str] = set()
    while found := tags.after(at):
        start, end, closing, tag, attributes = found
        p.text(page[at:start])
        at = end
        alone = attributes.rstrip().endswith("/")
        if tag in _RAW and not closing:
            p.text(" ")
            if tag in missing or (alone and tag not in _TO_THE_END):
                continue
            if m := _ENDS[tag].search(page, at):
                at = m.start()
            elif tag in _TO_THE_END:
                at = len(page)
            else:
                missing.add(tag)
        elif tag in _SKIPPED:
            p.text(" ")
            if closing:
                left[tag] -= 1
                p.close(tag)
            elif not alone and left[tag] > 0:
                if tag == "button":
                    p.close(tag)
                p.skip(tag)
        elif tag == "a":
            p.links = not closing
        elif tag in _BLOCK:
            if closing and tag in _BAD_TAGS:
                left[tag] -= 1
            if not closing and tag in ("article", "main", "h1"):
                for t in _BAD_TAGS:  # an element that nothing ends ends here
                    if p.names[t] and left[t] <= 0:
                        p.end()
                        p.close(t)
            if not closing and tag in _NOT_SKIPPED:
                while p.skipped:
                    p.pop()
            if not p.skipped:
                p.end()
                p.heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
                p.links = False
            if tag not in _HOLDS:
                if tag not in _IN_HEAD:
                    p.close("head")
            elif closing:
                p.close(tag)
            elif not alone or tag in _PARTS:
                if tag not in _IN_HEAD:
                    p.close("head")
                if tag in _SIBLINGS and p.open and p.open[-1][0] == tag:
                    p.pop()
                p.push(tag, attributes)
        elif not tag or tag == "br":
            p.text(" ")
    p.text(page[at:])
    p.end()
    wrong = _believed(p)
    return [(text, linked, bad or wrong[mark], inside, heading) for text, linked, bad, mark, inside, heading in p.blocks]


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))


def _is_prose(text: str, linked: int, foreign: bool = False) -> bool:
    """Is it prose by its length, links and stop words, or, in a language without known ones, by its sentences?"""
    if len(text) < SHORT or linked > LINKS * len(text):
        return False
    if foreign:
        return (n := len(_SENTENCE.findall(text))) > 0 and len(text) <= SENTENCE * n
    density = _density(text)
    return density >= MANY or (density >= FEW and len(text) > LONG)


def _foreign(texts: list[tuple[str, int]]) -> bool:
    """Have the longer texts of a page (with characters in links) hardly any known stop word?"""
    long = [t for t, linked in texts if len(t) >= SHORT and linked <= LINKS * len(t)]
    return bool(long) and _density(" ".join(long)) < UNKNOWN


def _believed(p: _Page) -> list[bool]:
    """For each mark: is it, or one around it, believed?  Not if it holds most of what the page has in articles, or, without
    articles, most of its dense text."""
    if len(p.marks) == 1:
        return [False]
    n = len(p.marks)
    held, dense = [0] * n, [0] * n
    for text, _, bad, mark, inside, _ in p.blocks:
        held[mark] += len(text) if inside and not bad else 0
    articles = any(held)
    foreign = _foreign([(b[0], b[1]) for b in p.blocks if not b[2]])
    for text, linked, bad, mark, _, _ in p.blocks:
        if not (articles or bad) and _is_prose(text, linked, foreign):
            dense[mark] += len(text)
    for mark in range(n - 1, 0, -1):
        held[p.marks[mark]] += held[mark]
        dense[p.marks[mark]] += dense[mark]
    out = [False] * n
    for mark in range(1, n):
        most = 2 * held[mark] > held[0] if articles else dense[mark] > max(LONG, dense[0] // 2)
        out[mark] = out[p.marks[mark]] or not most
    return out


def classify(page: list[tuple[str, int, bool, bool, bool]]) -> list[bool]:
    """Is each block main text?"""
    labels: list[bool | None] = []
    foreign = _foreign([(b[0], b[1]) for b in page if not b[2]])
    for text, linked, bad, inside, heading in page:
        if inside and not bad and LINKS * len(text) < linked < len(text) - 4 and _SENTENCE.search(text[-1]):
            labels.append(None)  # "See this page."
        elif bad or linked > LINKS * len(text):
            labels.append(False)
        elif heading or len(text) < SHORT:
            labels.append(None)
        elif inside or _is_prose(text, linked, foreign):
            labels.append(True)
        elif linked and (foreign or _density(text) < FEW):
            labels.append(False)
        else:
            labels.append(None)
    # what doesn't belong to an article it stands in (an advert, a hidden part) says nothing about its neighbours there
    says = [label is not None and not (b[2] and b[3]) for label, b in zip(labels, page, strict=True)]
    before, after, last = [], [None] * len(labels), None
    for i in range(len(labels)):
        before.append(last)
        last = i if says[i] else last
    last = None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = i if says[i] else last
    out = []
    for i, label in enumerate(labels):
        if label is None:
            inside = page[i][3]
            # neighbours on the other side of an article's edge say nothing about it
            near = [k for k in (before[i], after[i]) if k is not None and page[k][3] == inside]
            near.sort(key=lambda k: (abs(k - i), -k))
            if not near:
                label = inside
            elif inside and not page[i][2] and not page[i][4] and _SENTENCE.search(page[i][0][-1]):
                label = any(labels[k] for k in near)  # a sentence of an article that has prose beside it
            elif len(near) == 2 and abs(near[0] - i) == abs(near[1] - i):
                label = bool(labels[near[0]]) or bool(labels[near[1]])
            else:
                label = bool(labels[near[0]])
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The main text's blocks in page order, joined by an empty line; null, empty or without main text: ''."""
    found = blocks(page)
    return "\n\n".join(b[0] for b, keep in zip(found, classify(found), strict=True) if keep)


def with_main_text(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in column ``name``, an existing one replaced.

    Null, empty and broken pages, and such without main text, give ''; equal rows give equal rows, an empty table an empty
    result.  A page is read in time in proportion to its length, whatever its markup."""

    @F.pandas_udf("string")
    def of(source: pd.Series) -> pd.Series:
        return source.map(main_text)

    return pages.withColumn(name, of(html_column))
