"""Which elements are page furniture rather than content, judged from names and shape.

All judgements are memoised per element for the life of one :class:`Signals`, so that a
deep tree is tokenised once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

from .dom import Node
from .html_tokens import lower


class Vocabulary(tuple):
    """Words, known by identity where judgements are looked up: not hashed word for word each time."""

    __hash__ = object.__hash__
    __eq__ = object.__eq__


_set = lambda s: Vocabulary(s.split())
# The words that element names, ids, classes and roles are compared with.
CONTENT = _set("article body content entry guide help main text")
CONTENT_HINTS = _set("article body content main story text")
LAYOUT = _set("column columns container frame grid layout wrapper")
STRONG = _set("accessories affiliate buy carrier compare comparison deal deals disambiguation disclaimer disclosure environment faq hatnote incentive legal modal offer offers policy pricing promo report ribbon shop shopping specialist subjectpageheader tag tags terms trade upgrade values")
UTILITY = _set(
    "ad advert affiliate appearance author audio bio breadcrumb buy byline categories category caption carrier catlinks comment comments compare comparison copied copy control controls count deal deals "
    "disambiguation disclaimer disclosure dropdown environment eyebrow edit editsection featured export faq filter filters globalnav hatnote hidden indicator indicators incentive interface kicker lang "
    "language legal localnav meta metadata media menu modal nav newsletter noprint offer offers pending pagination player policy portlet pricing print promo report reaction reactions recommend recommended "
    "related revision ribbon share shop shopping sidebar social specialist status subtitle subscribe subjectpageheader tag tags feedback terms topic topics trade upsell upgrade utility values video widget"
)
ROLES = _set("complementary dialog menu menubar navigation search tablist toolbar")
AUXILIARY = _set("backlink bibliography citation citations cite disambiguation editsection footnote footnotes hatnote noteref reflist reference references redirect shortdescription subjectbar subjectpageheader sister toc")
NOTICE = _set("advertising affiliate commission copyright cookie cookies disclosure earn links policy privacy purchase sponsored terms")
NOTICE_PHRASES = ("affiliate commission", "fair use", "here's how it works", "how it works", "terms apply", "we may earn", "when you purchase through links", "when you purchase through links on our site")
NOTICE_CERTAIN = ("copyright act", "reviewed by an editor", "this article was generated", "used for the purpose of news reporting")
SECTION_HEADINGS = ("citations", "external links", "further reading", "notes", "other sources", "references", "see also")
SOURCES = ("source:", "sources:", "via:")
NOTE_LINKS = ("#bib", "#cite", "#fn", "#footnote", "#note", "#ref", "#refs", "#r")
SILENT = frozenset(_set("head noscript script style template"))
CONTROLS = frozenset(_set("button footer input nav option select textarea"))
RICH = frozenset(_set("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p picture pre table ul video"))
PARAGRAPHS = frozenset(_set("blockquote h1 h2 h3 h4 li p pre table"))
NAMED = frozenset(_set("id class role itemprop title name"))
_WORD = re.compile("[A-Za-z0-9]+")


def heading_level(tag: str) -> int | None:
    return int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else None


def squeezed(text: str) -> str:
    """One space for each run of white space, none at the ends."""
    return " ".join(text.split())


def joins_with_space(before: str, after: str) -> bool:
    return bool(before) and bool(after) and not before[-1].isspace() and before[-1] not in "([{/-" and after[0] not in ")]},.;:!?"


def words(text: str) -> list[str]:
    return [lower(w) for w in _WORD.findall(text)]


def among(word: str, vocabulary: tuple[str, ...]) -> bool:
    """Whether a word is one of the vocabulary, or holds one of five letters and more with at least three others."""
    return word in vocabulary or any(len(w) >= 5 and len(word) > len(w) + 2 and w in word for w in vocabulary)


def counted(tokens: tuple[str, ...], vocabulary: tuple[str, ...]) -> int:
    """How many tokens are :func:`among` the vocabulary."""
    return sum(among(t, vocabulary) for t in tokens)


#: What elements are called comes again in document after document: judged once a worker, unless it is long.
_known = lru_cache(1 << 16)(counted)
_FEW, _LONG = 16, 256


class Signals:
    def __init__(self) -> None:
        self._tokens: dict[int, tuple[str, ...]] = {}
        self._chrome: dict[int, bool] = {}
        self._hits: dict[tuple[int, int], int] = {}
        self._held: list[Node] = []  # keeps ids valid

    def tokens(self, e: Node) -> tuple[str, ...]:
        found = self._tokens.get(id(e))
        if found is None:
            found = words(e.tag)
            for name, value in sorted(e.attrs.items()):
                if name in NAMED or name.startswith("aria-"):
                    found = found + words(name) + words(value)
                elif name.startswith("data-"):
                    found = found + words(value)
            found = self._tokens[id(e)] = tuple(found)
            self._held.append(e)
        return found

    def hits(self, e: Node, vocabulary: tuple[str, ...]) -> int:
        """How many tokens are :func:`among` the vocabulary."""
        tokens = self.tokens(e)
        if len(tokens) <= _FEW and sum(map(len, tokens)) <= _LONG:
            return _known(tokens, vocabulary)
        key = (id(e), id(vocabulary))
        if key not in self._hits:
            self._hits[key] = counted(tokens, vocabulary)
        return self._hits[key]

    # -- hidden and auxiliary ------------------------------------------------------------

    @staticmethod
    def hidden_style(e: Node) -> bool:
        for part in e.attrs.get("style", "").split(";"):
            name, colon, value = part.partition(":")
            if colon and name.strip() in ("display", "visibility") and ("none" in lower(value) or "hidden" in lower(value)):
                return True
        return False

    @staticmethod
    def hidden(e: Node) -> bool:
        return "hidden" in e.attrs or lower(e.attrs.get("aria-hidden", "")) == "true"

    @staticmethod
    def note_link(e: Node) -> bool:
        leads = lambda n: "href" in n.attrs and lower(n.attrs["href"].strip()).startswith(NOTE_LINKS)
        return leads(e) or any(leads(n) for n in e.elements())

    def auxiliary(self, e: Node) -> bool:
        count, note = self.hits(e, AUXILIARY), self.note_link(e)
        if not count and not note:
            return False
        if note and e.tag in ("a", "sup", "sub", "span") or e.tag in ("span", "div") and self.hits(e, CITES):
            return True
        return count > self.hits(e, CONTENT_HINTS) and e.tag in ("a", "aside", "div", "li", "nav", "ol", "p", "section", "span", "sub", "sup", "ul")

    def excerpt(self, e: Node, limit: int) -> str:
        """Text until ``limit`` characters are reached."""
        out = ""

        def add(n: Node) -> str:
            nonlocal out
            if len(out) >= limit:
                return out
            if n.kind == "text":
                text = squeezed(n.text)
                out += (" " if joins_with_space(out, text) else "") + text
            elif n.kind != "element" or n.tag not in SILENT:
                for c in n.children:
                    add(c)
                    if len(out) >= limit:
                        break
            return out

        return squeezed(add(e))

    def notice(self, e: Node) -> bool:
        if e.tag not in ("aside", "div", "li", "p", "section", "span") or not any(n.tag == "a" for n in e.elements()):
            return False
        text = lower(self.excerpt(e, 420))
        certain = any(p in text for p in NOTICE_CERTAIN)
        if not text or len(text) > 420 or len(text) > 240 and not certain or sum(map(str.isalpha, text)) < 18:
            return False
        return certain or any(p in text for p in NOTICE_PHRASES) or sum(w in NOTICE for w in words(text)) >= 3

    def attribution(self, e: Node) -> bool:
        if e.tag not in ("div", "li", "p", "section", "span") or not any(n.tag == "a" for n in e.elements()):
            return False
        text = lower(self.excerpt(e, 220))
        return len(text) <= 220 and text.startswith(SOURCES)

    def skipped(self, e: Node) -> bool:
        """Left out of a reader's text, the judgement of chrome aside."""
        return self.hidden_style(e) or self.hidden(e) or self.auxiliary(e) or self.notice(e) or self.attribution(e) or self.auxiliary_section(e)

    # -- sections by their heading ---------------------------------------------------------

    def heading(self, e: Node) -> str | None:
        """The heading that an element is or opens with, among the first few of two levels."""
        from .text import heading_text

        level = lambda n: heading_text(n, self) if heading_level(n.tag) else None
        if text := level(e):
            return text
        first = lambda n: islice((c for c in n.children if c.kind == "element"), 4)
        for child in first(e):
            if text := level(child):
                return text
            if child.tag in ("div", "header", "section"):
                for grandchild in first(child):
                    if text := level(grandchild):
                        return text
        return None

    def closing_heading(self, e: Node) -> bool:
        text = self.heading(e)
        return text is not None and lower(squeezed(text).rstrip(":")) in SECTION_HEADINGS

    def auxiliary_section(self, e: Node) -> bool:
        return e.tag in ("aside", "div", "nav", "section") and self.closing_heading(e)

    def ends_narrative(self, e: Node) -> bool:
        return e.tag in ("aside", "nav", "section") and self.chrome(e) or self.closing_heading(e)

    # -- chrome -------------------------------------------------------------------------------

    def chrome(self, e: Node) -> bool:
        found = self._chrome.get(id(e))
        if found is None:
            found = self._chrome[id(e)] = self._is_chrome(e)
            self._held.append(e)
        return found

    def _is_chrome(self, e: Node) -> bool:
        tag = e.tag
        if tag in ("html", "body"):
            return False
        if tag in CONTROLS or self.hidden(e) or lower(e.attrs.get("role", "")) in ROLES:
            return True
        main = tag in ("article", "main")
        if not main and self.hits(e, STRONG):
            return True
        content = self.hits(e, CONTENT)
        if self.compact_widget(e, content):
            return True
        if main:
            return False
        if self.hits(e, FOOTER):
            return True
        utility = self.hits(e, UTILITY)
        if utility and not content and self.hits(e, LAYOUT) and any(self.surface(n) for n in islice(e.elements(), 256)):
            return False
        return utility > content

    def surface(self, e: Node) -> bool:
        """A place that holds main content."""
        if e.tag == "main" or lower(e.attrs.get("role", "")) == "main" or lower(e.attrs.get("itemprop", "")) == "articlebody":
            return True
        content, utility = self.hits(e, CONTENT), self.hits(e, UTILITY)
        blocks = sum(1 for _ in islice((n for n in e.elements() if n.tag in PARAGRAPHS), 4))
        return e.tag == "article" and blocks >= 2 or content >= 2 and utility <= content and blocks >= 1 or content >= 1 and utility == 0 and blocks >= 3

    def compact_widget(self, e: Node, content: int) -> bool:
        """A small box of a link or two without any block of text."""
        if content or e.tag not in ("aside", "div", "section") or any(heading_level(a.tag) for a in e.ancestors() if a.kind == "element"):
            return False
        links = images = inner = chars = 0
        for n in e.walk():
            if n.kind == "element" and n is not e:
                inner += 1
                images += n.tag == "img"
                links += n.tag == "a"
                if n.tag in RICH or images > 1 or n.tag == "a" and links > (2 if images else 1):
                    return False
            elif n.kind == "text":
                chars += sum(not c.isspace() for c in n.text)
                if chars > 64:
                    return False
        return inner > 0 and chars > 0


CITES, FOOTER, CAPTION = Vocabulary(("cite", "backlink")), Vocabulary(("footer",)), Vocabulary(("caption",))
