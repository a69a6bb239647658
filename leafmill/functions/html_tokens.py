"""The HTML tokenizer: characters, tags, comments and doctypes by scanning with patterns.

The tree builder chooses how text is read (``mode``) after a start tag.
"""

from __future__ import annotations

import re
from html.entities import html5

# What numeric references in the C1 range stand for.
WINDOWS = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D,
    0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}
LONGEST = max(map(len, html5))
_NUMBER = re.compile("&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?")
_NAME = re.compile("&[0-9A-Za-z]+;?")
_TAG_NAME = re.compile("[^\t\n\f />]+")
_SPACE = re.compile("[\t\n\f /]*")
_BLANK = re.compile("[\t\n\f ]*")
_ATTR_NAME = re.compile("=?[^\t\n\f />=]*")
_PLAIN = re.compile("([a-z][a-z0-9]*)>")  # most tags: a name alone, nothing to fold
_BARE = re.compile("[^\t\n\f >]*")
_DOCTYPE = re.compile("[\t\n\f ]*([^\t\n\f >]*)[\t\n\f ]*(?:(public)[\t\n\f ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?[\t\n\f ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?|(system)[\t\n\f ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?)?", re.I)
_COMMENT_END = re.compile("--!?>")
_SCRIPT_STEP = re.compile("<!--|-->|</?script(?=[\t\n\f />])", re.I)

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """ASCII letters in lower case, nothing else changed."""
    return text.translate(ASCII_LOWER) if not text.islower() else text


def unescape(text: str, attribute: bool = False) -> str:
    """Character references replaced."""
    at = text.find("&")
    if at < 0:
        return text
    out, done = [], 0
    while at >= 0:
        got, end = None, at + 1
        if m := _NUMBER.match(text, at):
            n = int(m[1], 16) if m[1] else int(m[2]) if len(m[2]) < 10 else 0x110000
            got = "\ufffd" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(WINDOWS.get(n, n))
            end = m.end()
        elif m := _NAME.match(text, at):
            name = m[0][1:]
            for size in range(min(len(name), LONGEST), 1, -1):
                if (key := name[:size]) in html5:
                    after = text[at + 1 + size : at + 2 + size]
                    if not (attribute and key[-1] != ";" and (after == "=" or after.isascii() and after.isalnum())):
                        got, end = html5[key], at + 1 + size
                    break
        if got is not None:
            out += [text[done:at], got]
            done = end
        at = text.find("&", end)
    out.append(text[done:])
    return "".join(out)


class Tokens:
    """Reads one document and tells ``sink`` of each token."""

    def __init__(self, text: str, sink) -> None:
        text = text.removeprefix("\ufeff")
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        self.sink, self.mode, self.last = sink, "data", ""

    def run(self) -> None:
        text, sink, at, size = self.text, self.sink, 0, len(self.text)
        while at < size:
            if self.mode == "plaintext":
                sink.characters(text[at:].replace("\0", "\ufffd"))
                break
            if self.mode != "data":
                at = self.raw(at)
                continue
            mark = text.find("<", at)
            if mark < 0:
                mark = size
            if mark > at:
                sink.characters(unescape(text[at:mark]))
                at = mark
            if at < size:
                at = self.markup(at)
        sink.end()

    def raw(self, at: int) -> int:
        """Text up to the end tag that fits the open element."""
        text, mode = self.text, self.mode
        stop = re.compile(f"</{re.escape(self.last)}(?=[\t\n\f />])", re.I)
        if mode == "script":
            end, level, pos = len(text), 0, at  # level 1: inside <!--, 2: inside <script of it
            while m := _SCRIPT_STEP.search(text, pos):
                found = m[0].lower()
                pos = m.end()
                if found == "<!--" and level == 0:
                    level = 1
                    pos -= 2  # "<!-->" closes at once
                elif found == "-->":
                    level = 0
                elif found == "</script" and level < 2:
                    end = m.start()
                    break
                elif found == "</script":
                    level = 1
                elif found == "<script" and level == 1:
                    level = 2
        else:
            m = stop.search(text, at)
            end = m.start() if m else len(text)
        if end > at:
            data = text[at:end].replace("\0", "\ufffd")
            self.sink.characters(unescape(data) if mode == "rcdata" else data)
        self.mode = "data"
        return self.markup(end) if end < len(text) else end

    def markup(self, at: int) -> int:
        """What begins with ``<`` at ``at``; returns where it ends."""
        text, sink = self.text, self.sink
        after = text[at + 1 : at + 2]
        if after.isascii() and after.isalpha():
            return self.tag(at + 1, False)
        if after == "/":
            c = text[at + 2 : at + 3]
            if c.isascii() and c.isalpha():
                return self.tag(at + 2, True)
            if c == ">":
                return at + 3
            if not c:
                sink.characters("</")
                return at + 2
            return self.bogus(at + 2)
        if after == "!":
            if text.startswith("--", at + 2):
                return self.comment(at + 4)
            if text[at + 2 : at + 9].lower() == "doctype":
                return self.doctype(at + 9)
            if text.startswith("[CDATA[", at + 2) and sink.foreign():
                end = text.find("]]>", at + 9)
                sink.characters(text[at + 9 : end if end >= 0 else len(text)])
                return end + 3 if end >= 0 else len(text)
            return self.bogus(at + 2)
        if after == "?":
            return self.bogus(at + 1)
        sink.characters("<")
        return at + 1

    def bogus(self, at: int) -> int:
        end = self.text.find(">", at)
        end = len(self.text) if end < 0 else end
        self.sink.comment(self.text[at:end].replace("\0", "\ufffd"))
        return end + 1

    def comment(self, at: int) -> int:
        text = self.text
        if text.startswith(">", at):
            self.sink.comment("")
            return at + 1
        if text.startswith("->", at):
            self.sink.comment("")
            return at + 2
        m = _COMMENT_END.search(text, at)
        if m:
            data, end = text[at : m.start()], m.end()
        else:
            data, end = text[at:], len(text)
            for tail in ("--!", "--", "-"):
                if data.endswith(tail):
                    data = data[: -len(tail)]
                    break
        self.sink.comment(data.replace("\0", "\ufffd"))
        return end

    def doctype(self, at: int) -> int:
        end = self.text.find(">", at)
        end = len(self.text) if end < 0 else end
        m = _DOCTYPE.match(self.text, at, end)
        public = next((x for x in (m[3], m[4]) if x is not None), None)
        system = next((x for x in (m[5], m[6], m[8], m[9]) if x is not None), None)
        self.sink.doctype(lower(m[1]).replace("\0", "\ufffd"), public, system, not m[1] or (end == len(self.text)))
        return end + 1

    def tag(self, at: int, closing: bool) -> int:
        text, size = self.text, len(self.text)
        plain = _PLAIN.match(text, at)
        m = plain or _TAG_NAME.match(text, at)
        name, at, attrs, alone = (plain[1] if plain else lower(m[0])), m.end(), {}, False
        while not plain:
            before = at
            at = _SPACE.match(text, at).end()
            if at >= size:
                return size  # an unfinished tag is dropped
            if text[at] == ">":
                alone = at > before and text[at - 1] == "/"
                at += 1
                break
            m = _ATTR_NAME.match(text, at)
            key, at = lower(m[0]), m.end()
            gap = _BLANK.match(text, at).end()
            value = ""
            if text.startswith("=", gap):
                at = _BLANK.match(text, gap + 1).end()
                quote = text[at : at + 1]
                if quote in ('"', "'") and quote:
                    end = text.find(quote, at + 1)
                    if end < 0:
                        return size
                    value, at = unescape(text[at + 1 : end], True), end + 1
                elif quote != ">":
                    m = _BARE.match(text, at)
                    value, at = unescape(m[0], True), m.end()
            if key not in attrs:
                attrs[key.replace("\0", "\ufffd")] = value.replace("\0", "\ufffd")
        name = name.replace("\0", "\ufffd")
        if closing:
            self.sink.end_tag(name)
        else:
            self.last = name
            self.sink.start_tag(name, attrs, alone)
        return at
