"""Inspection of a document: counts, likely content roots with selectors, headings and links.

Every candidate container is measured once (:class:`Candidate`); two weight tables score it for
extraction and for reading; rules held as data compare each pair of nested candidates.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import cached_property

from . import css, urls
from .chrome import SILENT, Signals, Vocabulary, heading_level, squeezed
from .dom import Document, Node, path_of, roomy, serialized
from .extract import parsed
from .html_parser import parse_fragment
from .html_tokens import lower
from .text import body_text, heading_text, title

_set = lambda s: Vocabulary(s.split())
# Vocabularies of content roots and of links that say little.
POSITIVE = _set("article body content entry guide help main page post primary story")
NEGATIVE = _set("ad banner breadcrumb comment footer header language menu nav newsletter promo related share sidebar social toc toolbar")
GENERIC = frozenset(_set("article body container content inner layout main module outer page wrapper"))
WEAK_PATHS = _set("article-share article-tags breadcrumb comment comments footer menu nav newsletter promo related report share social toolbar")
WEAK_LINKS = _set("/fair-use/ /policy /privacy /report/ /rss /subscribe /tags/ /terms privacy-policy terms-of-use terms-and-conditions")
WEAK_TEXTS = ("add as a preferred source", "follow us", "how it works", "preferred source", "privacy policy", "report a problem", "terms of use", "terms apply")
SAMPLES = 8
_IDENT = re.compile("[A-Za-z_-][A-Za-z0-9_-]*")


@dataclass(frozen=True)
class Weights:
    """What counts how much for one purpose."""

    tags: dict[str, int]
    main_role: int
    body_prop: int
    chars: int
    heading: int
    positive: int
    negative: int
    utility: tuple[int, int]  # of article or main with a shallow heading, of others
    constant: int
    no_body: tuple[int, int, int]  # nothing, little, what is little
    title_only: tuple[int, int]
    crowded: tuple[int, tuple[int, int], tuple[int, int], tuple[int, int]]  # few characters, then (penalty, characters) at 6, 4 and 3 links a paragraph
    primary: dict[int, int]
    primary_each: int


# The two weight tables.
EXTRACTION = Weights({"article": 120, "main": 70, "section": 28, "div": 18}, 28, 55, 105, 10, 22, 34, (18, 24), 90, (200, 95, 420), (200, 420), (30, (25, 1600), (60, 6500), (34, 12000)), {}, 0)
READING = Weights({"main": 100, "article": 90, "section": 30, "div": 15}, 45, 35, 90, 12, 20, 28, (12, 18), 75, (180, 75, 320), (170, 300), (25, (15, 1200), (40, 4000), (22, 6000)), {1: 130, 2: 78, 3: 20}, 38)


@dataclass(frozen=True)
class Candidate:
    selector: str
    path: str
    tag: str
    chars: int
    headings: int
    links: int
    blocks: int = 0
    level: int | None = None
    primaries: int = 0
    depth: int | None = None
    utility: int = 0
    main_role: bool = False
    body_prop: bool = False
    positive: int = 0
    negative: int = 0
    score: int = 0

    @cached_property
    def shallow(self) -> bool:
        """Whether its first main heading is near its top."""
        return self.depth is not None and (self.level == 1 and self.depth <= 5 or self.level == 2 and self.depth <= 2)

    @cached_property
    def stable(self) -> int:
        """How far its selector can be trusted, from 0 (a path) to 5 (an id)."""
        s = self.selector
        if ":nth-of-type(" in s:
            return 0
        if s.startswith("#"):
            return 5
        if "[itemprop=" in s or "[role=" in s or s.startswith("["):
            return 4
        return 3 if "." in s and s[0].isalpha() else 2 if s.startswith(".") else 1

    @cached_property
    def steps(self) -> int:
        return self.path.count(" > ")

    def holds(self, other: Candidate) -> bool:
        return other.path.startswith(self.path + " > ")

    def loses_title(self, inner: Candidate) -> bool:
        """Whether narrowing to ``inner`` gives up the title."""
        return self.shallow and not (inner.shallow and (inner.level == 1 or self.level != 1))

    def is_shell_of(self, inner: Candidate) -> bool:
        """Whether it adds hardly more than a crowd of headings around ``inner``."""
        more = self.headings >= inner.headings + 24 and self.headings >= 2 * inner.headings
        return inner.headings >= 2 and inner.chars * 100 >= self.chars * 94 and more and self.links <= inner.links + 12 and inner.stable >= self.stable

    def rated(self, w: Weights) -> int:
        big = self.tag in ("article", "main")
        total = w.tags.get(self.tag, 0) + self.main_role * w.main_role + self.body_prop * w.body_prop + min(self.chars, 8000) // w.chars + min(self.headings, 8) * w.heading
        if self.shallow:
            total += w.primary.get(self.level, 0) + min(self.primaries, 2) * w.primary_each
        total += min(self.blocks, 16) * 7 + min(self.positive, 4) * w.positive - min(self.negative, 4) * w.negative
        total -= min(self.utility, 12) * w.utility[0 if big and self.shallow else 1] + 220 * (self.selector == self.path) + w.constant
        if self.blocks == 0 and self.chars < 500:
            total -= w.no_body[0]
        elif self.blocks <= 1 and self.chars < w.no_body[2]:
            total -= w.no_body[1]
        if not big and self.shallow and not self.blocks and self.chars < w.title_only[1]:
            total -= w.title_only[0]
        if self.chars < 240 and self.links > 8:
            return total - w.crowded[0]
        for (penalty, chars), ratio in zip(w.crowded[1:], (6, 4, 3), strict=True):
            if self.links > self.blocks * ratio and self.chars < chars:
                return total - penalty
        return total


@dataclass(frozen=True)
class Gap:
    """What an outer candidate has beyond an inner one."""

    outer: Candidate
    inner: Candidate

    def __getattr__(self, name: str) -> int:
        return getattr(self.outer, name) - getattr(self.inner, name)

    def share(self, percent: int) -> bool:
        return self.inner.chars * 100 >= self.outer.chars * percent

    @property
    def loses(self) -> bool:
        return self.outer.loses_title(self.inner)


@dataclass(frozen=True)
class Rule:
    """If the test holds for a gap, (inner, outer) change by the purpose's amounts; None: not for it."""

    test: object
    extraction: tuple[int, int] | None
    reading: tuple[int, int] | None
    ends: bool = False


def no(x):
    """Not ``x``, for truth values and for columns."""
    return not x if isinstance(x, bool) else ~x


# Amounts and limits of the rules for nested candidates. The tests hold for numbers and for columns alike.
RULES = [
    Rule(lambda g: g.outer.is_shell_of(g.inner), (2250, -1950), (1900, -1650), True),
    Rule(lambda g: g.loses & g.share(85) & (g.outer.blocks > 0), (-280, 245), None, True),
    Rule(lambda g: g.share(92) & (g.blocks <= 1) & (g.headings <= 2) & ((g.links >= 8) | (g.utility >= 2)), (210, -165), None),
    Rule(lambda g: g.share(88) & (g.headings >= 12) & (g.links >= 24), (760, -620), None),
    Rule(lambda g: g.share(98) & (g.headings >= 0) & (g.links >= 20), (320, -260), None),
    Rule(lambda g: g.share(95) & no(g.loses) & (g.headings <= 4) & (g.links >= 20) & (g.inner.stable >= g.outer.stable), (2400, -2000), None),
    Rule(lambda g: g.share(98) & (g.links >= 120), (700, -580), (620, -520)),
    Rule(lambda g: (g.outer.chars >= 6 * g.inner.chars) & (g.blocks >= 4) & (g.headings >= 4), (-190, 170), None),
    Rule(lambda g: g.share(78) & (g.blocks <= 1) & ((g.utility >= 8) | (g.utility > 0) & (g.links > 8)) & (g.headings <= 2), (145, -110), (120, -95)),
    Rule(lambda g: (g.outer.blocks > 0) & g.loses & g.share(70) & (g.links <= 70), (-120, 95), (-220, 185)),
    Rule(lambda g: (g.outer.blocks > 0) & (g.primaries > 0) & g.share(80) & (g.links <= 20) & (g.utility <= 6), (-50, 35), (-115, 85)),
    Rule(lambda g: (g.outer.blocks > 0) & g.share(80) & (g.headings >= 4) & (g.links <= 20) & (g.utility <= 6), (-55, 40), (-110, 90)),
    Rule(lambda g: (g.outer.blocks > 0) & g.share(90) & (g.headings >= 2) & (g.links <= 12) & (g.utility <= 4), (-30, 20), (-75, 55)),
    Rule(lambda g: g.share(68) & no((g.outer.links > 0) & (g.inner.links * 100 > g.outer.links * 80)) & (g.utility <= 12), (90, -60), (60, -40)),
]


def ranked(candidates: list[Candidate], reading: bool, limit: int) -> list[Candidate]:
    """Candidates of positive score, corrected for nesting and sorted, the best ``limit``."""
    scored = [replace(c, score=c.rated(READING) if reading else c.rated(EXTRACTION) + max(c.rated(READING), 0) // 3) for c in candidates]
    live = [c for c in scored if c.score > 0]
    change = [0] * len(live)
    for o, outer in enumerate(live):
        for i, inner in enumerate(live):
            if not outer.holds(inner):
                continue
            gap = Gap(outer, inner)
            for rule in RULES:
                amounts = rule.reading if reading else rule.extraction
                if amounts and rule.test(gap):
                    change[i] += amounts[0]
                    change[o] += amounts[1]
                    if rule.ends:
                        break
    live = [replace(c, score=c.score + d) for c, d in zip(live, change, strict=True)]
    by = (lambda c: (-c.score, -c.chars, -c.headings, -c.stable, c.selector)) if reading else (lambda c: (-c.score, c.links, -c.stable, -c.steps, -c.chars, c.selector))
    return sorted(live, key=by)[:limit]


def promoted(extraction: list[Candidate], reading: list[Candidate]) -> list[Candidate]:
    """Extraction candidates after the reading candidates had their say, in three passes."""
    rank = lambda c: ("div", "section", "main", "article").index(c.tag) + 1 if c.tag in ("div", "section", "main", "article") else 0
    last = lambda pool, key: max(reversed(pool), key=key, default=None)  # noqa: E731  of equals the last

    def lead(chosen: Candidate | None, among: list[Candidate]) -> list[Candidate]:
        return among if chosen is None else [chosen, *(c for c in among if c.path != chosen.path)]

    now, top = extraction[0], reading[0] if reading else None
    if top is not None:
        if now.path == top.path:
            pool = [c for c in reading[1:] if top.holds(c) and c.chars * 100 >= top.chars * 92 and (c.headings + 2 >= top.headings and c.links <= top.links or top.is_shell_of(c))]
            best = last(pool, lambda c: (rank(c), c.stable, -c.chars, -c.links, -c.steps, c.selector))
        else:
            pool = [c for c in reading if now.holds(c) and c.chars * 100 >= now.chars * 90 and (now.links >= c.links + 20 or now.is_shell_of(c)) and c.stable >= 2]
            best = last(pool, lambda c: (c.stable, rank(c), -c.chars, -c.links, -c.steps, c.selector))
        extraction = lead(best, extraction)
        now = extraction[0]
        if top.holds(now) and top.loses_title(now) and now.chars * 100 >= top.chars * 85 and top.headings + 2 >= now.headings and top.links <= now.links + 60:
            extraction = lead(top, extraction)
            now = extraction[0]
    pool = [c for c in reading if now.holds(c) and c.chars * 100 >= now.chars * 90 and c.headings + 2 >= now.headings and now.links >= c.links + 20 and not now.loses_title(c)]
    return lead(min(pool, key=lambda c: (c.links, -c.stable, -c.chars, c.steps, c.selector), default=None), extraction)


class Inspector:
    def __init__(self, document: Document, base: str | None):
        self.document, self.base, self.signals, self.matcher = document, base, Signals(), css.Matcher()
        self.all = document.elements()
        self._clean: dict[int, bool] = {}
        self._link: dict[int, str] = {}

    def clean(self, e: Node) -> bool:
        """Neither chrome nor inside chrome."""
        known = self._clean.get(e.number)
        if known is None:
            up = e.parent
            known = not self.signals.chrome(e) and (up is None or up.kind != "element" or self.clean(up))
            self._clean[e.number] = known
        return known

    def text_of(self, e: Node) -> str:
        return body_text(parse_fragment(serialized(e, True)), "normalize", True)

    def link_text(self, e: Node) -> str:
        """The text of a link that leads somewhere and says something; empty otherwise."""
        if e.number not in self._link:
            href = e.attrs.get("href", "").strip()
            good = "href" in e.attrs and self.clean(e) and urls.meaningful(href)
            text = self.text_of(e) if good else ""
            self._link[e.number] = "" if text and weak_link(href, text, path_of(e)) else text
        return self._link[e.number]

    def headings(self, e: Node, tags: str) -> list[Node]:
        return [n for n in e.elements() if n.tag in tags.split() and heading_text(n, self.signals)]

    # -- candidates ----------------------------------------------------------------------------

    def contains_content(self, e: Node, positive: int) -> bool:
        if e.tag in ("main", "article"):
            return True
        if e.tag not in ("section", "div"):
            return False
        if positive or lower(e.attrs.get("role", "")) == "main" or lower(e.attrs.get("itemprop", "")) == "articlebody":
            return True
        return e.tag == "section" and narrative(e)

    def measured(self) -> list[Candidate]:
        out = []
        for e in (n for n in self.document.nodes if n.kind == "element"):
            positive = self.signals.hits(e, POSITIVE)
            if not self.contains_content(e, positive) or not self.clean(e):
                continue
            chars = len(self.text_of(e))
            if not chars:
                continue
            inner = list(e.elements())
            heads, links = len(self.headings(e, "h1 h2 h3 h4 h5 h6")), sum(bool(self.link_text(n)) for n in inner if n.tag == "a")
            prose = sum(n.tag == "p" for n in inner)
            blocks = prose + min(-(-sum(n.tag == "li" for n in inner) // 3), 6)
            if not readable(e.tag, chars, heads, links, blocks, prose):
                continue
            main = self.headings(e, "h1 h2")
            depth = next((i for i, a in enumerate(main[0].ancestors(), 1) if a is e), None) if main else None
            furniture = [n for n in inner if self.signals.chrome(n)]
            ids = {id(n) for n in furniture}
            roots = sum(not any(id(a) in ids for a in between(n, e)) for n in furniture)
            path = path_of(e)
            out.append(Candidate(
                self.recommended(e, path), path, e.tag, chars, heads, links, blocks, heading_level(main[0].tag) if main else None, len(main), depth, roots,
                lower(e.attrs.get("role", "")) == "main", lower(e.attrs.get("itemprop", "")) == "articlebody", positive, self.signals.hits(e, NEGATIVE)))
        return out

    def recommended(self, e: Node, path: str) -> str:
        """The first of the usual selectors that matches this element alone, or its path."""
        for selector in dict.fromkeys(selector_ideas(e)):
            try:
                wanted = css.parse(selector)
            except css.SelectorError:
                continue
            if self.matcher.any(wanted, e) and sum(self.matcher.any(wanted, n) for n in self.all) == 1:
                return selector
        return path

    # -- samples ---------------------------------------------------------------------------------

    def scope(self, path: str | None) -> list[Node]:
        """Elements below the scope in document order; all by creation without one that can be found."""
        if path is not None:
            try:
                found = css.select(self.document, css.parse(path))
            except css.SelectorError:
                found = []
            if found:
                return list(found[0].elements())
        return self.all

    def heading_samples(self, paths: list[str], limit: int) -> list[dict]:
        out: list[dict] = []
        seen: set[str] = set()

        def sample(path: str | None, tags: str, most: int) -> list[dict]:
            got = []
            for e in self.scope(path):
                if len(got) >= most:
                    break
                if e.tag in tags.split() and self.clean(e) and (p := path_of(e)) not in seen:
                    seen.add(p)
                    if text := heading_text(e, self.signals):
                        got.append({"level": heading_level(e.tag), "text": text, "path": p})
            return got

        for path in [*paths, None] if limit else []:
            out = sample(path, "h1 h2 h3 h4 h5 h6", limit)
            if out:
                break
        if limit and not any(h["level"] == 1 for h in out):
            seen = {h["path"] for h in out}
            out = (sample(None, "h1", 1) + out)[:limit]
        return out

    def link_samples(self, paths: list[str], limit: int) -> list[dict]:
        out: list[dict] = []
        seen: set[str] = set()
        for path in [*paths, None]:
            for e in self.scope(path):
                if len(out) >= limit:
                    return out
                if e.tag != "a" or not (text := self.link_text(e)) or (p := path_of(e)) in seen:
                    continue
                seen.add(p)
                href = e.attrs["href"].strip()
                resolved = urls.resolve(self.base, href)
                if self.base and same_page(resolved, self.base):
                    continue
                out.append({"text": text, "resolved_href": resolved, "href": href, "path": p})
        return out


def between(n: Node, top: Node):
    for a in n.ancestors():
        if a is top:
            return
        yield a


def narrative(e: Node) -> bool:
    """Three paragraphs, or two with a heading or a list of two items."""
    p = heads = items = 0
    for n in e.elements():
        p += n.tag == "p"
        heads += n.tag in ("h1", "h2", "h3")
        items += n.tag == "li"
        if p >= 3 or p >= 2 and (heads or items >= 2):
            return True
    return False


def readable(tag: str, chars: int, headings: int, links: int, blocks: int, prose: int) -> bool:
    """Whether there is enough text for the headings and links."""
    if chars < 20 or tag not in ("article", "main") and not blocks and chars < 120:
        return False
    if not prose and blocks <= 2 and chars < 220:
        return (not headings or chars // headings >= 24) and (not links or chars // links >= 18)
    return chars >= 4000 or headings <= max(blocks * 3, 12) and links <= max(blocks * 5, 18)


def quoted(value: str) -> str:
    return value.replace("\\", "\\\\").replace('"', '\\"')


def selector_ideas(e: Node):
    if value := e.attrs.get("id", "").strip():
        yield f"#{value}" if _IDENT.fullmatch(value) else f'[id="{quoted(value)}"]'
    if value := e.attrs.get("role", "").strip():
        yield f'{e.tag}[role="{quoted(value)}"]'
        yield f'[role="{quoted(value)}"]'
    if value := e.attrs.get("itemprop", "").strip():
        yield f'{e.tag}[itemprop="{quoted(value)}"]'
    names = [c for c in e.attrs.get("class", "").split() if _IDENT.fullmatch(c)]
    if names := ([c for c in names if c not in GENERIC] or names)[:2]:
        yield e.tag + "".join("." + c for c in names)
        yield "".join("." + c for c in names)
    yield e.tag


def weak_link(href: str, text: str, path: str) -> bool:
    if href.startswith("#"):
        marks = text.strip()
        return bool(marks) and all(c in "0123456789*#[]" for c in marks) or "> sup:nth-of-type(" in path
    return any(x in lower(text) for x in WEAK_TEXTS) or any(x in lower(href) for x in WEAK_LINKS) or any(x in lower(path) for x in WEAK_PATHS)


def same_page(a: str, b: str) -> bool:
    x, y = urls.parse(a), urls.parse(b)
    return x is not None and y is not None and x.text(False) == y.text(False)


def visible_chars(document: Document) -> int:
    """Characters of the body's text with single spaces, image texts included."""
    top = document.first("body") or document.html() or document.root
    parts: list[str] = []

    todo = list(reversed(top.children))
    while todo:
        c = todo.pop()
        if c.kind == "text":
            parts.append(squeezed(c.text))
        elif c.kind == "element" and c.tag == "img":
            parts.append(squeezed(c.attrs.get("alt", "")))
        elif c.kind != "element" or c.tag not in SILENT:
            todo.extend(reversed(c.children))
    return len(" ".join(p for p in parts if p))


def most(counts: Counter, limit: int) -> list[dict]:
    return [{"name": k, "count": v} for k, v in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:limit]]


def inspect(html: str, input_base_url: str | None = None, limit: int = SAMPLES) -> dict:
    """The summary of one document; the base as in extraction, nothing sampled for a limit of 0."""
    document = parsed(html)
    roomy(document.root)
    shown = urls.redacted(input_base_url) if input_base_url else None
    base = urls.effective_base(document, shown)
    run = Inspector(document, base)
    elements = [n for n in document.nodes if n.kind == "element"]
    tags = Counter(e.tag for e in elements)
    classes = Counter(c for e in elements for c in e.attrs.get("class", "").split())
    measured = run.measured() if limit else []
    reading = ranked(measured, True, limit)
    extraction = ranked(measured, False, limit)
    extraction = promoted(extraction, reading) if extraction else list(reading)
    paths = [c.path for c in reading]
    shape = lambda c: {"selector": c.selector, "path": c.path, "tag_name": c.tag, "text_char_count": c.chars, "heading_count": c.headings, "link_count": c.links}
    said, href = [], urls.base_href(document)
    if href is not None and base is None:
        said.append({"level": "warning", "code": "EFFECTIVE_BASE_URL_UNRESOLVED", "message": "The document declares <base href>, but no effective base URL could be resolved for this input.", "details": {"documentBaseHref": href, "rewriteRequested": False}})
    return {
        "title": title(document), "root_tag": "html", "element_count": len(elements), "text_char_count": visible_chars(document), "link_count": tags["a"], "image_count": tags["img"], "form_count": tags["form"],
        "table_count": tags["table"], "script_count": tags["script"], "style_count": tags["style"], "document_base_href": href, "effective_base_url": base, "top_tags": most(tags, limit), "top_classes": most(classes, limit),
        "extraction_candidates": [shape(c) for c in extraction], "reading_candidates": [shape(c) for c in reading], "headings": run.heading_samples(paths, limit), "links": run.link_samples(paths, limit), "diagnostics": said,
    }
