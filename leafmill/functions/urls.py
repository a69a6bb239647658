"""URLs as the WHATWG standard reads them: parsing, joining, and rewriting links in trees.

Hosts outside ASCII go through the standard library's IDNA codec (the 2003 tables).
"""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

from .dom import HTML, Document, Node
from .html_tokens import lower

DEFAULT_PORTS = {"ftp": "21", "http": "80", "https": "443", "ws": "80", "wss": "443", "file": ""}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = re.compile(r"[\0\t\n\r #%/:<>?@\[\\\]^|\x01-\x1f\x7f]")
# Characters that each part of a URL percent-encodes besides controls and non-ASCII.
FRAGMENT, QUERY, PATH, USERINFO = ' "<>`', " \"#<>", ' "#<>?`{}^', ' "#<>?`{}/:;=@[\\]^|'
#: Attributes that hold one URL.
LINKS = ("action", "cite", "data", "formaction", "href", "poster", "src")


def encode(text: str, extra: str) -> str:
    if text.isascii() and not any(c in extra or c < " " or c == "\x7f" for c in text):
        return text
    out = []
    for c in text:
        if c in extra or not " " <= c <= "~":
            out += [f"%{b:02X}" for b in c.encode("utf-8", "replace")]
        else:
            out.append(c)
    return "".join(out)


def _ipv4(host: str) -> str | None:
    """The dotted form of a host whose last label is a number; None if it is one but wrong."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not re.fullmatch(r"[0-9]+|0[xX][0-9a-fA-F]*", parts[-1]):
        return host
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    if len(numbers) > 4 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _host(text: str, special: bool) -> str | None:
    if text.startswith("["):
        import ipaddress

        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") else None
        except ValueError:
            return None
    if not special:
        return None if re.search(r"[\0\t\n\r #/:<>?@\[\\\]^|]", text) else encode(text, "")
    name = unquote_to_bytes(text).decode("utf-8", "replace")
    if name.isascii():
        name = lower(name)
    else:
        try:
            name = ".".join(p if p.isascii() else p.encode("idna").decode() for p in re.split("[.\u3002\uff0e\uff61]", name.casefold()))
        except UnicodeError:
            return None
    return None if not name or _BAD_HOST.search(name) else _ipv4(name)


class Url:
    """scheme, credentials, host, port, path (list, or text if opaque), query, fragment."""

    __slots__ = ("scheme", "user", "password", "host", "port", "path", "query", "fragment")

    def __init__(self) -> None:
        self.scheme, self.user, self.password, self.host, self.port = "", "", "", None, ""
        self.path: list[str] | str = []
        self.query: str | None = None
        self.fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in DEFAULT_PORTS

    def text(self, fragment: bool = True) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            who = self.user + (":" + self.password if self.password else "")
            out += "//" + (who + "@" if who else "") + self.host + (":" + self.port if self.port else "")
        elif isinstance(self.path, list) and len(self.path) > 1 and self.path[0] == "":
            out += "/."
        out += self.path if isinstance(self.path, str) else "".join("/" + p for p in self.path)
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + self.fragment if fragment and self.fragment is not None else "")

    def follow(self, text: str, keep: list[str]) -> None:
        """Extend the segments ``keep`` by the path ``text``."""
        segments = list(keep)
        parts = re.split(r"[/\\]" if self.special else "/", text)
        for i, part in enumerate(parts):
            plain, last = part.lower().replace("%2e", "."), i == len(parts) - 1
            if plain == "..":
                if segments:
                    segments.pop()
                if last:
                    segments.append("")
            elif plain == ".":
                if last:
                    segments.append("")
            else:
                segments.append(encode(part, PATH))
        self.path = segments

    def authority(self, text: str) -> bool:
        who, at, where = text.rpartition("@")
        if at:
            user, _, password = who.partition(":")
            self.user, self.password = encode(user, USERINFO), encode(password, USERINFO)
        m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", where)
        if not m or self.special and not m[1]:
            return False
        self.host = _host(m[1], self.special) if m[1] else ""
        if self.host is None or m[2] and int(m[2]) > 65535:
            return False
        port = str(int(m[2])) if m[2] else ""
        self.port = "" if port == DEFAULT_PORTS.get(self.scheme) else port
        return True


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL of ``text``, joined to ``base`` if relative; None if it is none."""
    text = re.sub("[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    out = Url()
    text, mark, fragment = text.partition("#")
    if mark:
        out.fragment = encode(fragment, FRAGMENT)
    m = _SCHEME.match(text)
    rest = text
    if m:
        out.scheme, rest = m[1].lower(), text[m.end() :]
        relative = out.special and base is not None and base.scheme == out.scheme and not re.match(r"[/\\]", rest) and out.scheme != "file"
        if not relative:
            return _absolute(out, rest)
    elif base is None:
        return None
    elif isinstance(base.path, str):
        if text or not mark:
            return None
        out.scheme, out.path, out.query = base.scheme, base.path, base.query
        return out
    out.scheme = base.scheme
    slash = r"[/\\]" if out.special else "/"
    if re.match(slash + slash, rest):
        return _absolute(out, rest)
    out.user, out.password, out.host, out.port = base.user, base.password, base.host, base.port
    path, question, query = rest.partition("?")
    if question:
        out.query = encode(query, QUERY + ("'" if out.special else ""))
    if re.match(slash, path):
        out.follow(path[1:], [])
    elif path:
        out.follow(path, base.path[:-1])
    else:
        out.path = list(base.path)
        out.query = out.query if question else base.query
    return out


def _absolute(out: Url, rest: str) -> Url | None:
    path, question, query = rest.partition("?")
    if question:
        out.query = encode(query, QUERY + ("'" if out.special else ""))
    if out.special or path.startswith("//"):
        m = re.match(r"[/\\]*([^/\\]*)(.*)" if out.special and out.scheme != "file" else r"//([^/]*)(.*)" if not out.special else r"(?:[/\\]{2})?([^/\\]*)(.*)", path, re.S)
        if out.scheme == "file":
            out.host = _host(m[1], True) if m[1] else ""
            if out.host is None:
                return None
        elif not out.authority(m[1]):
            return None
        tail = m[2]
        if out.special or tail:
            out.follow(tail[1:], [])
        return out
    if path.startswith("/"):
        out.follow(path[1:], [])
    else:
        out.path = encode(path, "")
    return out


def http(text: str | None) -> Url | None:
    url = parse(text) if text else None
    return url if url is not None and url.scheme in ("http", "https") else None


def normal(text: str) -> str:
    url = parse(text)
    return text if url is None else url.text()


def resolve(base: str | None, link: str) -> str:
    """``link`` made absolute; unchanged without a base, if blank, a fragment, absolute or not a URL."""
    trimmed = link.strip()
    if base is None or not trimmed or trimmed.startswith("#") or parse(trimmed) is not None:
        return link
    joined = parse(trimmed, parse(base))
    return link if joined is None else joined.text()


def base_href(document: Document) -> str | None:
    """The trimmed ``href`` of the first ``base`` that has one."""
    for e in document.elements():
        if e.tag == "base" and e.ns == HTML and "href" in e.attrs:
            return e.attrs["href"].strip() or None
    return None


def effective_base(document: Document, given: str | None) -> str | None:
    href = base_href(document)
    start = normal(given) if given else None
    if href is None or href.startswith("#"):
        return start
    url = parse(href)
    if url is not None:
        return url.text() if url.scheme in ("http", "https") else start
    joined = parse(href, parse(given)) if given else None
    return joined.text() if joined is not None and joined.scheme in ("http", "https") else start


def meaningful(href: str) -> bool:
    """Whether a link leads anywhere."""
    h = lower(href.strip())
    return bool(h) and h != "#" and not h.startswith("javascript:")


def redacted(text: str) -> str | None:
    """The form of an http URL that may be shown: no credentials, query masked, no fragment; None if it isn't allowed."""
    url = http(text)
    if url is None or url.user or url.password:
        return None
    url.fragment = None
    if url.query is not None:
        url.query = "[redacted]"
    return url.text()


# -- rewriting ---------------------------------------------------------------------------


def srcset(base: str | None, value: str) -> str:
    out, at, size = [], 0, len(value)
    while at < size:
        while at < size and (value[at].isspace() or value[at] == ","):
            at += 1
        start = at
        data = value[at : at + 5].lower() == "data:"
        while at < size and not value[at].isspace() and not (value[at] == "," and not data):
            at += 1
        link = value[start:at]
        ended = link.endswith(",")
        link = link.rstrip(",")
        if not link:
            continue
        descriptor = ""
        if not ended:
            end = value.find(",", at)
            end = size if end < 0 else end
            descriptor, at = " ".join(value[at:end].split()), end
        out.append(resolve(base, link) + (" " + descriptor if descriptor else ""))
    return ", ".join(out)


_REFRESH = re.compile(r"(.*?;\s*url\s*=\s*)(\"[^\"]*\"?|'[^']*'?|[^\s].*?)?(\s*)$", re.I | re.S)


def refresh(base: str | None, value: str) -> str:
    m = _REFRESH.match(value)
    if not m or not m[2]:
        return value
    target, quote = m[2], m[2][0] if m[2][0] in "\"'" else ""
    inner = target[1:].removesuffix(quote) if quote else target
    closed = quote if quote and len(target) > 1 and target.endswith(quote) else ""
    return m[1] + quote + resolve(base, inner) + closed + m[3]


_CSS = re.compile(r"(/\*.*?(?:\*/|$))|(?<![\w\\-])(url\(\s*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\s\"')]*)(\s*\))|(@import\s+)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", re.I | re.S)


def style(base: str | None, value: str) -> str:
    def link(text: str) -> str:
        quote = text[:1] if text[:1] in ("'", '"') else ""
        inner = text[1:-1] if quote else text
        plain = re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], inner, flags=re.S)
        new = resolve(base, plain)
        return text if new == plain else quote + new + quote

    def one(m: re.Match) -> str:
        if m[2]:
            return m[2] + link(m[3]) + m[4]
        return m[5] + link(m[6]) if m[5] else m[0]

    return _CSS.sub(one, value)


def rewrite_attribute(base: str | None, e: Node, name: str, value: str) -> str:
    if name in LINKS:
        return resolve(base, value)
    if name in ("srcset", "imagesrcset"):
        return srcset(base, value)
    if name == "ping":
        return " ".join(resolve(base, p) for p in value.split())
    if name == "style":
        return style(base, value)
    if name == "content" and e.tag == "meta" and lower(e.attrs.get("http-equiv", "")) == "refresh":
        return refresh(base, value)
    return value


def rewritten(document: Document, base: str | None) -> Document:
    """A copy of the tree with all its links made absolute."""
    out = document.clone()
    if base is None:
        return out
    for e in out.nodes:
        if e.kind == "element":
            for name, value in list(e.attrs.items()):
                e.attrs[name] = rewrite_attribute(base, e, name, value)
        elif e.kind == "text" and e.parent is not None and e.parent.kind == "element" and e.parent.tag == "style":
            e.text = style(base, e.text)
    return out
