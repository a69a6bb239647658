"""The HTML tree construction stage.

One method per insertion mode and token kind, looked up by name; tables of tag sets are
the specification's. Scripting counts as enabled. ``select`` content is built like
other body content, as in the current specification.
"""

from __future__ import annotations

import re

from .dom import HTML, MATHML, SVG, Document, Node
from .html_tokens import Tokens, lower

_set = lambda s: frozenset(s.split())
# Tag sets of the specification.
SPECIAL = _set("address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
SCOPE = _set("applet caption html table td th marquee object select template")
MATH_TEXT, SVG_HTML = _set("mi mo mn ms mtext"), _set("foreignobject desc title foreignObject")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
THOROUGH = IMPLIED | _set("caption colgroup tbody td tfoot th thead tr")
BLOCKS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
CLOSING_BLOCKS = (BLOCKS - {"p"}) | _set("button listing pre select")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
BREAKOUT = _set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
HEAD_TAGS = _set("base basefont bgsound link meta noframes script style template title")
SVG_TAGS = {t.lower(): t for t in "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient radialGradient textPath".split()}
SVG_ATTRS = {t.lower(): t for t in "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan".split()}
FOREIGN_ATTRS = {"xlink:actuate", "xlink:arcrole", "xlink:href", "xlink:role", "xlink:show", "xlink:title", "xlink:type", "xml:lang", "xml:space", "xmlns:xlink"}
QUIRKY_PUBLIC = re.compile(r"(?i)^(?:-//w3o//dtd w3 html strict 3\.0//en//$|-/w3c/dtd html 4\.0 transitional/en$|html$|\+//silmaril//|-//as//|-//advasoft ltd//|-//ietf//dtd html|-//metrius//|-//microsoft//dtd internet explorer [23]|-//netscape comm\. corp\.//|-//o'reilly and associates//|-//softquad|-//spyglass//|-//sun microsystems corp\.//|-//w3c//dtd html (?:3|3\.2|experimental|4\.0 (?:frameset|transitional))|-//w3c//dtd w3 html|-//w3o//dtd w3 html|-//webtechs//)")
QUIRKY_HTML4 = re.compile(r"(?i)^-//w3c//dtd html 4\.01 (?:frameset|transitional)//")
_SPACES = "\t\n\f\r "
_LEAD = re.compile("[\t\n\f\r ]+")


class Parser:
    def __init__(self, text: str) -> None:
        self.doc, self.stack, self.active, self.mode = Document(), [], [], "initial"
        self.back, self.head, self.form, self.frames_ok = "", None, None, True
        self.templates: list[str] = []
        self.foster, self.skip_line, self.pending, self.pages = False, False, [], 0
        self.tokens = Tokens(text, self)
        self.tokens.run()

    # -- nodes ---------------------------------------------------------------------

    @property
    def node(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def place(self, target: Node | None = None) -> tuple[Node, int]:
        """The appropriate place for a new node: parent and index."""
        target = target or self.stack[-1]
        if self.foster and target.ns == HTML and target.tag in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                n = self.stack[i]
                if n.ns == HTML and n.tag == "template":
                    return self.inside(n), len(self.inside(n).children)
                if n.ns == HTML and n.tag == "table":
                    if n.parent is not None:
                        return n.parent, next(k for k, c in enumerate(n.parent.children) if c is n)
                    return self.stack[i - 1], len(self.stack[i - 1].children)
            return self.stack[0], len(self.stack[0].children)
        target = self.inside(target)
        return target, len(target.children)

    def inside(self, n: Node) -> Node:
        """Where the children of ``n`` go: a template's content."""
        return n.children[0] if n.kind == "element" and n.tag == "template" and n.ns == HTML and n.children and n.children[0].kind == "fragment" else n

    def create(self, tag: str, attrs: dict[str, str], ns: str = HTML) -> Node:
        n = self.doc.make("element", tag=tag, attrs=attrs, ns=ns)
        if ns != HTML and any(":" in k and k in FOREIGN_ATTRS for k in attrs):
            n.names = {k.split(":")[1]: k for k in attrs if k in FOREIGN_ATTRS}
            n.attrs = {}
            for k, v in attrs.items():
                n.attrs.setdefault(k.split(":")[1] if k in FOREIGN_ATTRS else k, v)
        return n

    def insert(self, tag: str, attrs: dict[str, str] | None = None, ns: str = HTML) -> Node:
        n = self.create(tag, attrs or {}, ns)
        parent, at = self.place()
        parent.insert(at, n)
        self.stack.append(n)
        if tag == "template" and ns == HTML:
            n.append(self.doc.make("fragment"))
        return n

    def void(self, tag: str, attrs: dict[str, str]) -> None:
        self.insert(tag, attrs)
        self.stack.pop()

    def text(self, data: str) -> None:
        if not data:
            return
        parent, at = self.place()
        if parent.kind == "document":
            return
        if at and parent.children[at - 1].kind == "text":
            parent.children[at - 1].text += data
        else:
            parent.insert(at, self.doc.make("text", text=data))

    # -- the stack -------------------------------------------------------------------

    def in_scope(self, tags, extra=(), table: bool = False) -> bool:
        tags = {tags} if isinstance(tags, str) else tags
        for n in reversed(self.stack):
            if n.ns == HTML:
                if n.tag in tags:
                    return True
                if n.tag in (("html", "table", "template") if table else SCOPE) or n.tag in extra:
                    return False
            elif not table and ((n.ns == MATHML and (n.tag in MATH_TEXT or n.tag == "annotation-xml")) or (n.ns == SVG and n.tag in SVG_HTML)):
                return False
        return False

    def imply(self, but: str = "", tags=IMPLIED) -> None:
        while self.stack and self.node.ns == HTML and self.node.tag in tags and self.node.tag != but:
            self.stack.pop()

    def pop_to(self, tags) -> None:
        """Pop up to and with the first element of ``tags``."""
        tags = {tags} if isinstance(tags, str) else tags
        while self.stack:
            n = self.stack.pop()
            if n.ns == HTML and n.tag in tags:
                break

    def clear_to(self, tags) -> None:
        while self.stack and not (self.node.ns == HTML and (self.node.tag in tags or self.node.tag in ("html", "template"))):
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", ("button",)):
            self.imply("p")
            self.pop_to("p")

    # -- active formatting elements; None is a marker --------------------------------

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or any(self.active[-1] is n for n in self.stack):
            return
        at = len(self.active) - 1
        while at > 0 and self.active[at - 1] is not None and not any(self.active[at - 1] is n for n in self.stack):
            at -= 1
        for i in range(at, len(self.active)):
            self.active[i] = self.insert(self.active[i].tag, dict(self.active[i].attrs))

    def remember(self, n: Node) -> None:
        same = []
        for other in reversed(self.active):
            if other is None:
                break
            if other.tag == n.tag and other.attrs == n.attrs:
                same.append(other)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(n)

    def forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency."""
        if self.node.ns == HTML and self.node.tag == tag and not any(self.node is n for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            found = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    found = n
                    break
            if found is None:
                self.other_end(tag)
                return
            if not any(found is n for n in self.stack):
                self.active = [n for n in self.active if n is not found]
                return
            if not self.holds(found):
                return
            at = self.index(found)
            block = next((n for n in self.stack[at + 1 :] if self.special(n)), None)
            if block is None:
                del self.stack[at:]
                self.active = [n for n in self.active if n is not found]
                return
            common, mark = self.stack[at - 1], next(i for i, n in enumerate(self.active) if n is found)
            above, last, count = self.index(block), block, 0
            while True:
                above -= 1
                n = self.stack[above]
                if n is found:
                    break
                count += 1
                listed = next((i for i, x in enumerate(self.active) if x is n), None)
                if count > 3 and listed is not None:
                    del self.active[listed]
                    mark -= listed < mark
                    listed = None
                if listed is None:
                    del self.stack[above]
                    continue
                copy = self.create(n.tag, dict(n.attrs))
                self.active[listed] = self.stack[above] = copy
                if last is block:
                    mark = listed + 1
                last.detach()
                copy.append(last)
                last = copy
            last.detach()
            before, self.foster = self.foster, True
            parent, i = self.place(common)
            self.foster = before
            parent.insert(i, last)
            copy = self.create(found.tag, dict(found.attrs))
            for child in list(block.children):
                child.detach()
                copy.append(child)
            block.append(copy)
            gone = next(i for i, x in enumerate(self.active) if x is found)
            self.active.insert(mark, copy)
            del self.active[gone + (mark <= gone)]
            self.stack = [n for n in self.stack if n is not found]
            self.stack.insert(self.index(block) + 1, copy)

    def index(self, n: Node) -> int:
        return next(i for i, x in enumerate(self.stack) if x is n)

    def holds(self, wanted: Node) -> bool:
        for n in reversed(self.stack):
            if n is wanted:
                return True
            if n.ns == HTML and n.tag in SCOPE or n.ns == MATHML and (n.tag in MATH_TEXT or n.tag == "annotation-xml") or n.ns == SVG and n.tag in SVG_HTML:
                return False
        return False

    def special(self, n: Node) -> bool:
        if n.ns == HTML:
            return n.tag in SPECIAL
        return n.ns == MATHML and (n.tag in MATH_TEXT or n.tag == "annotation-xml") or n.ns == SVG and n.tag in SVG_HTML

    def other_end(self, tag: str) -> None:
        for n in reversed(self.stack):
            if n.ns == HTML and n.tag == tag:
                self.imply(tag)
                del self.stack[self.index(n) :]
                return
            if self.special(n):
                return

    def reset(self) -> None:
        """The insertion mode that fits the stack."""
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            t = n.tag if n.ns == HTML else ""
            if t in ("td", "th") and i:
                self.mode = "cell"
            elif t == "tr":
                self.mode = "row"
            elif t in ("tbody", "thead", "tfoot"):
                self.mode = "table_body"
            elif t in ("caption", "table", "body", "frameset"):
                self.mode = t
            elif t == "colgroup":
                self.mode = "columns"
            elif t == "template":
                self.mode = self.templates[-1]
            elif t == "head" and i:
                self.mode = "head"
            elif t == "html":
                self.mode = "before_head" if self.head is None else "after_head"
            elif i:
                continue
            else:
                self.mode = "body"
            return

    # -- tokens ----------------------------------------------------------------------

    def foreign(self) -> bool:
        return bool(self.stack) and self.node.ns != HTML

    def as_html(self, tag: str | None, chars: bool) -> bool:
        """Whether a token goes to the insertion mode though the current node is foreign."""
        n = self.node
        if n.ns == MATHML and n.tag in MATH_TEXT and (chars or tag is not None and tag not in ("mglyph", "malignmark")):
            return True
        if n.ns == MATHML and n.tag == "annotation-xml" and tag == "svg":
            return True
        point = n.ns == SVG and n.tag in SVG_HTML or n.ns == MATHML and n.tag == "annotation-xml" and lower(n.attrs.get("encoding", "")) in ("text/html", "application/xhtml+xml")
        return point and (chars or tag is not None)

    def characters(self, data: str) -> None:
        if self.skip_line:
            self.skip_line = False
            data = data.removeprefix("\n")
        if not data:
            return
        if self.stack and self.foreign() and not self.as_html(None, True):
            self.text(data.replace("\0", "\ufffd"))
            if data.strip(_SPACES + "\0"):
                self.frames_ok = False
            return
        while data:
            data = getattr(self, f"{self.mode}_text")(data)

    def comment(self, data: str) -> None:
        self.skip_line = False
        n = self.doc.make("comment", text=data)
        if self.mode in ("initial", "before_html", "after_after_body", "after_after_frameset"):
            self.doc.root.append(n)
        elif self.mode == "after_body":
            self.stack[0].append(n)
        else:
            self.flush()
            parent, at = self.place()
            parent.insert(at, n)

    def doctype(self, name: str, public: str | None, system: str | None, broken: bool) -> None:
        self.skip_line = False
        if self.mode != "initial":
            return
        self.doc.root.append(self.doc.make("doctype", text=name))
        p, s = public or "", system or ""
        self.doc.quirks = broken or name != "html" or bool(QUIRKY_PUBLIC.match(p)) or lower(s) == "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd" or system is None and bool(QUIRKY_HTML4.match(p))
        self.mode = "before_html"

    def start_tag(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        self.skip_line = False
        if self.stack and self.foreign() and not self.as_html(tag, False):
            self.foreign_start(tag, attrs, alone)
            return
        while getattr(self, f"{self.mode}_start")(tag, attrs, alone):
            pass

    def end_tag(self, tag: str) -> None:
        self.skip_line = False
        if self.stack and self.foreign():
            self.foreign_end(tag)
            return
        while getattr(self, f"{self.mode}_end")(tag):
            pass

    def end(self) -> None:
        for _ in range(100):
            if self.mode == "initial":
                self.doc.quirks, self.mode = True, "before_html"
            elif self.mode in ("before_html", "before_head", "after_head"):
                getattr(self, f"{self.mode}_other")()
            elif self.mode == "head":
                self.stack.pop()
                self.mode = "after_head"
            elif self.mode == "text":
                self.stack.pop()
                self.mode = self.back
            else:
                self.flush()
                if self.templates and any(n.tag == "template" and n.ns == HTML for n in self.stack):
                    self.pop_to("template")
                    self.forget_to_marker()
                    self.templates.pop()
                    self.reset()
                    continue
                return

    def raw(self, tag: str, attrs: dict[str, str], mode: str) -> None:
        self.insert(tag, attrs)
        self.tokens.mode, self.tokens.last = mode, tag
        self.back, self.mode = self.mode, "text"

    # -- foreign content -------------------------------------------------------------

    def foreign_start(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        if tag in BREAKOUT or tag == "font" and not attrs.keys().isdisjoint(("color", "face", "size")):
            while self.foreign() and not (self.node.ns == MATHML and self.node.tag in MATH_TEXT or self.node.ns == SVG and self.node.tag in SVG_HTML or self.as_html("x", False)):
                self.stack.pop()
            self.start_tag(tag, attrs, alone)
            return
        ns = self.node.ns
        if ns == SVG:
            tag, attrs = SVG_TAGS.get(tag, tag), {SVG_ATTRS.get(k, k): v for k, v in attrs.items()}
        else:
            attrs = {"definitionURL" if k == "definitionurl" else k: v for k, v in attrs.items()}
        self.insert(tag, attrs, ns)
        if alone:
            self.stack.pop()

    def foreign_end(self, tag: str) -> None:
        if tag in ("br", "p"):
            while self.foreign() and not (self.node.ns == MATHML and self.node.tag in MATH_TEXT or self.node.ns == SVG and self.node.tag in SVG_HTML):
                self.stack.pop()
            while getattr(self, f"{self.mode}_end")(tag):
                pass
            return
        for i in range(len(self.stack) - 1, 0, -1):
            n = self.stack[i]
            if n.ns == HTML:
                while getattr(self, f"{self.mode}_end")(tag):
                    pass
                return
            if lower(n.tag) == tag:
                del self.stack[i:]
                return

    def foreign_root(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        ns = SVG if tag == "svg" else MATHML
        attrs = {SVG_ATTRS.get(k, k): v for k, v in attrs.items()} if ns == SVG else {"definitionURL" if k == "definitionurl" else k: v for k, v in attrs.items()}
        self.reconstruct()
        self.insert(tag, attrs, ns)
        if alone:
            self.stack.pop()

    # -- before the body ---------------------------------------------------------------

    def _lead(self, data: str) -> tuple[str, str]:
        m = _LEAD.match(data)
        return (data[: m.end()], data[m.end() :]) if m else ("", data)

    def initial_text(self, data: str) -> str:
        _, rest = self._lead(data)
        if rest:
            self.doc.quirks, self.mode = True, "before_html"
        return rest

    def initial_start(self, *_) -> bool:
        self.doc.quirks, self.mode = True, "before_html"
        return True

    def initial_end(self, tag: str) -> bool:
        return self.initial_start()

    def before_html_other(self) -> None:
        n = self.create("html", {})
        self.doc.root.append(n)
        self.stack.append(n)
        self.mode = "before_head"

    def before_html_text(self, data: str) -> str:
        _, rest = self._lead(data)
        if rest:
            self.before_html_other()
        return rest

    def before_html_start(self, tag, attrs, alone) -> bool:
        if tag != "html":
            self.before_html_other()
            return True
        n = self.create("html", attrs)
        self.doc.root.append(n)
        self.stack.append(n)
        self.mode = "before_head"
        return False

    def before_html_end(self, tag) -> bool:
        if tag in ("head", "body", "html", "br"):
            self.before_html_other()
            return True
        return False

    def before_head_other(self) -> None:
        self.head = self.insert("head")
        self.mode = "head"

    def before_head_text(self, data: str) -> str:
        _, rest = self._lead(data)
        if rest:
            self.before_head_other()
        return rest

    def before_head_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        if tag == "head":
            self.head = self.insert(tag, attrs)
            self.mode = "head"
            return False
        self.before_head_other()
        return True

    def before_head_end(self, tag) -> bool:
        if tag in ("head", "body", "html", "br"):
            self.before_head_other()
            return True
        return False

    def head_text(self, data: str) -> str:
        lead, rest = self._lead(data)
        self.text(lead)
        if rest:
            self.stack.pop()
            self.mode = "after_head"
        return rest

    def head_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        if tag in ("base", "basefont", "bgsound", "link", "meta"):
            self.void(tag, attrs)
        elif tag == "title":
            self.raw(tag, attrs, "rcdata")
        elif tag in ("noframes", "style", "noscript"):
            self.raw(tag, attrs, "rawtext")
        elif tag == "script":
            self.raw(tag, attrs, "script")
        elif tag == "template":
            self.insert(tag, attrs)
            self.active.append(None)
            self.frames_ok, self.mode = False, "template"
            self.templates.append("template")
        elif tag != "head":
            self.stack.pop()
            self.mode = "after_head"
            return True
        return False

    def head_end(self, tag) -> bool:
        if tag == "template":
            self.end_template()
        elif tag in ("head", "body", "html", "br"):
            self.stack.pop()
            self.mode = "after_head"
            return tag != "head"
        return False

    def end_template(self) -> None:
        if any(n.tag == "template" and n.ns == HTML for n in self.stack):
            self.imply(tags=THOROUGH)
            self.pop_to("template")
            self.forget_to_marker()
            self.templates.pop()
            self.reset()

    def after_head_other(self) -> None:
        self.insert("body")
        self.mode = "body"

    def after_head_text(self, data: str) -> str:
        lead, rest = self._lead(data)
        self.text(lead)
        if rest:
            self.after_head_other()
        return rest

    def after_head_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        if tag == "body":
            self.insert(tag, attrs)
            self.frames_ok, self.mode = False, "body"
        elif tag == "frameset":
            self.insert(tag, attrs)
            self.mode = "frameset"
        elif tag in HEAD_TAGS:
            self.stack.append(self.head)
            self.head_start(tag, attrs, alone)
            self.stack = [n for n in self.stack if n is not self.head]
        elif tag != "head":
            self.after_head_other()
            return True
        return False

    def after_head_end(self, tag) -> bool:
        if tag == "template":
            return self.head_end(tag)
        if tag in ("body", "html", "br"):
            self.after_head_other()
            return True
        return False

    # -- text of raw elements ------------------------------------------------------------

    def text_text(self, data: str) -> str:
        self.text(data)
        return ""

    def text_start(self, tag, attrs, alone) -> bool:
        self.stack.pop()
        self.mode = self.back
        return True

    def text_end(self, tag) -> bool:
        self.stack.pop()
        self.mode = self.back
        return False

    # -- the body --------------------------------------------------------------------------

    def body_text(self, data: str) -> str:
        data = data.replace("\0", "")
        if data:
            self.reconstruct()
            self.text(data)
            if self.frames_ok and data.strip(_SPACES):
                self.frames_ok = False
        return ""

    def body_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            if not self.templates:
                for k, v in attrs.items():
                    self.stack[0].attrs.setdefault(k, v)
        elif tag in HEAD_TAGS:
            return self.head_start(tag, attrs, alone)
        elif tag == "body":
            if len(self.stack) > 1 and self.stack[1].tag == "body" and not self.templates:
                self.frames_ok = False
                for k, v in attrs.items():
                    self.stack[1].attrs.setdefault(k, v)
        elif tag == "frameset":
            if self.frames_ok and len(self.stack) > 1 and self.stack[1].tag == "body":
                self.stack[1].detach()
                del self.stack[1:]
                self.insert(tag, attrs)
                self.mode = "frameset"
        elif tag in BLOCKS:
            self.close_p()
            self.insert(tag, attrs)
        elif tag in HEADINGS:
            self.close_p()
            if self.node.ns == HTML and self.node.tag in HEADINGS:
                self.stack.pop()
            self.insert(tag, attrs)
        elif tag in ("pre", "listing"):
            self.close_p()
            self.insert(tag, attrs)
            self.skip_line, self.frames_ok = True, False
        elif tag == "form":
            if self.form is None or self.templates:
                self.close_p()
                n = self.insert(tag, attrs)
                if not self.templates:
                    self.form = n
        elif tag == "li":
            self.frames_ok = False
            self.close_items(("li",))
            self.insert(tag, attrs)
        elif tag in ("dd", "dt"):
            self.frames_ok = False
            self.close_items(("dd", "dt"))
            self.insert(tag, attrs)
        elif tag == "plaintext":
            self.close_p()
            self.insert(tag, attrs)
            self.tokens.mode = "plaintext"
        elif tag == "button":
            if self.in_scope("button"):
                self.imply()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
            self.frames_ok = False
        elif tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    self.active = [x for x in self.active if x is not n]
                    self.stack = [x for x in self.stack if x is not n]
                    break
            self.reconstruct()
            self.remember(self.insert(tag, attrs))
        elif tag in FORMATTING:
            self.reconstruct()
            if tag == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.active.append(None)
            self.frames_ok = False
        elif tag == "table":
            if not self.doc.quirks:
                self.close_p()
            self.insert(tag, attrs)
            self.frames_ok, self.mode = False, "table"
        elif tag in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.void(tag, attrs)
            self.frames_ok = False
        elif tag == "input":
            if self.in_scope("select"):
                self.pop_to("select")
            self.reconstruct()
            self.void(tag, attrs)
            if lower(attrs.get("type", "")) != "hidden":
                self.frames_ok = False
        elif tag in ("param", "source", "track"):
            self.void(tag, attrs)
        elif tag == "hr":
            self.close_p()
            if self.in_scope("select"):
                self.imply()
            self.void(tag, attrs)
            self.frames_ok = False
        elif tag == "image":
            return self.body_start("img", attrs, alone)
        elif tag == "textarea":
            self.frames_ok = False
            self.raw(tag, attrs, "rcdata")
            self.skip_line = True
        elif tag == "xmp":
            self.close_p()
            self.reconstruct()
            self.frames_ok = False
            self.raw(tag, attrs, "rawtext")
        elif tag == "iframe":
            self.frames_ok = False
            self.raw(tag, attrs, "rawtext")
        elif tag in ("noembed", "noscript"):
            self.raw(tag, attrs, "rawtext")
        elif tag == "select":
            if self.in_scope("select"):
                self.pop_to("select")
            else:
                self.reconstruct()
                self.insert(tag, attrs)
                self.frames_ok = False
        elif tag in ("option", "optgroup"):
            if self.in_scope("select"):
                self.imply("optgroup" if tag == "option" else "")
            elif self.node.tag == "option":
                self.stack.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.imply("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        elif tag in ("math", "svg"):
            self.foreign_root(tag, attrs, alone)
        elif tag not in ("caption", "col", "colgroup", "frame", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.reconstruct()
            self.insert(tag, attrs)
        return False

    def close_items(self, tags) -> None:
        for n in reversed(self.stack):
            if n.ns == HTML and n.tag in tags:
                self.imply(n.tag)
                self.pop_to(n.tag)
                break
            if self.special(n) and not (n.ns == HTML and n.tag in ("address", "div", "p")):
                break
        self.close_p()

    def body_end(self, tag) -> bool:
        if tag == "template":
            return self.head_end(tag)
        if tag in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
                return tag == "html"
        elif tag in CLOSING_BLOCKS:
            if self.in_scope(tag):
                self.imply()
                self.pop_to(tag)
        elif tag == "form":
            if self.templates:
                if self.in_scope("form"):
                    self.imply()
                    self.pop_to("form")
            else:
                n, self.form = self.form, None
                if n is not None and self.holds(n):
                    self.imply()
                    self.stack = [x for x in self.stack if x is not n]
        elif tag == "p":
            if not self.in_scope("p", ("button",)):
                self.insert("p")
            self.close_p()
        elif tag == "li":
            if self.in_scope("li", ("ol", "ul")):
                self.imply("li")
                self.pop_to("li")
        elif tag in ("dd", "dt"):
            if self.in_scope(tag):
                self.imply(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.imply()
                self.pop_to(tag)
                self.forget_to_marker()
        elif tag == "br":
            self.body_start("br", {}, False)
        else:
            self.other_end(tag)
        return False

    # -- tables --------------------------------------------------------------------------

    def flush(self) -> None:
        """Text that was held back in a table."""
        held, self.pending = "".join(self.pending), []
        if not held:
            return
        if held.strip(_SPACES):
            self.foster = True
            self.body_text(held)
            self.foster = False
        else:
            self.text(held)

    def table_text(self, data: str) -> str:
        if self.node.tag in ("table", "tbody", "tfoot", "thead", "tr", "template"):
            self.pending.append(data.replace("\0", ""))
        else:
            self.foster = True
            self.body_text(data)
            self.foster = False
        return ""

    row_text = table_body_text = table_text

    def table_start(self, tag, attrs, alone) -> bool:
        self.flush()
        if tag == "caption":
            self.clear_to(("table",))
            self.active.append(None)
            self.insert(tag, attrs)
            self.mode = "caption"
        elif tag == "colgroup":
            self.clear_to(("table",))
            self.insert(tag, attrs)
            self.mode = "columns"
        elif tag == "col":
            self.clear_to(("table",))
            self.insert("colgroup")
            self.mode = "columns"
            return True
        elif tag in ("tbody", "tfoot", "thead"):
            self.clear_to(("table",))
            self.insert(tag, attrs)
            self.mode = "table_body"
        elif tag in ("td", "th", "tr"):
            self.clear_to(("table",))
            self.insert("tbody")
            self.mode = "table_body"
            return True
        elif tag == "table":
            if self.in_scope("table", table=True):
                self.pop_to("table")
                self.reset()
                return True
        elif tag in ("style", "script", "template"):
            return self.head_start(tag, attrs, alone)
        elif tag == "input" and lower(attrs.get("type", "")) == "hidden":
            self.void(tag, attrs)
        elif tag == "form":
            if not self.templates and self.form is None:
                self.form = self.insert(tag, attrs)
                self.stack.pop()
        else:
            self.foster = True
            again = self.body_start(tag, attrs, alone)
            self.foster = False
            return again
        return False

    def table_end(self, tag) -> bool:
        self.flush()
        if tag == "table":
            if self.in_scope("table", table=True):
                self.pop_to("table")
                self.reset()
        elif tag == "template":
            return self.head_end(tag)
        elif tag not in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.foster = True
            again = self.body_end(tag)
            self.foster = False
            return again
        return False

    def end_caption(self) -> bool:
        if not self.in_scope("caption", table=True):
            return False
        self.imply()
        self.pop_to("caption")
        self.forget_to_marker()
        self.mode = "table"
        return True

    caption_text = cell_text = body_text

    def caption_start(self, tag, attrs, alone) -> bool:
        if tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return self.end_caption()
        return self.body_start(tag, attrs, alone)

    def caption_end(self, tag) -> bool:
        if tag == "caption":
            self.end_caption()
            return False
        if tag == "table":
            return self.end_caption()
        if tag in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
            return False
        return self.body_end(tag)

    def columns_text(self, data: str) -> str:
        lead, rest = self._lead(data)
        self.text(lead)
        if rest:
            if self.node.tag != "colgroup":
                return ""
            self.stack.pop()
            self.mode = "table"
        return rest

    def columns_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        if tag == "col":
            self.void(tag, attrs)
            return False
        if tag == "template":
            return self.head_start(tag, attrs, alone)
        if self.node.tag != "colgroup":
            return False
        self.stack.pop()
        self.mode = "table"
        return True

    def columns_end(self, tag) -> bool:
        if tag == "template":
            return self.head_end(tag)
        if tag == "col" or self.node.tag != "colgroup":
            return False
        self.stack.pop()
        self.mode = "table"
        return tag != "colgroup"

    def table_body_start(self, tag, attrs, alone) -> bool:
        self.flush()
        if tag == "tr":
            self.clear_to(("tbody", "tfoot", "thead"))
            self.insert(tag, attrs)
            self.mode = "row"
            return False
        if tag in ("td", "th"):
            self.clear_to(("tbody", "tfoot", "thead"))
            self.insert("tr")
            self.mode = "row"
            return True
        if tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
            return self.leave_table_body()
        return self.table_start(tag, attrs, alone)

    def leave_table_body(self) -> bool:
        if not self.in_scope({"tbody", "thead", "tfoot"}, table=True):
            return False
        self.clear_to(("tbody", "tfoot", "thead"))
        self.stack.pop()
        self.mode = "table"
        return True

    def table_body_end(self, tag) -> bool:
        self.flush()
        if tag in ("tbody", "tfoot", "thead"):
            if self.in_scope(tag, table=True):
                self.leave_table_body()
            return False
        if tag == "table":
            return self.leave_table_body()
        if tag in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
            return False
        return self.table_end(tag)

    def leave_row(self) -> bool:
        if not self.in_scope("tr", table=True):
            return False
        self.clear_to(("tr",))
        self.stack.pop()
        self.mode = "table_body"
        return True

    def row_start(self, tag, attrs, alone) -> bool:
        self.flush()
        if tag in ("td", "th"):
            self.clear_to(("tr",))
            self.insert(tag, attrs)
            self.mode = "cell"
            self.active.append(None)
            return False
        if tag in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            return self.leave_row()
        return self.table_start(tag, attrs, alone)

    def row_end(self, tag) -> bool:
        self.flush()
        if tag == "tr":
            self.leave_row()
            return False
        if tag == "table":
            return self.leave_row()
        if tag in ("tbody", "tfoot", "thead"):
            return self.in_scope(tag, table=True) and self.leave_row()
        if tag in ("body", "caption", "col", "colgroup", "html", "td", "th"):
            return False
        return self.table_end(tag)

    def leave_cell(self) -> None:
        self.imply()
        self.pop_to({"td", "th"})
        self.forget_to_marker()
        self.mode = "row"

    def cell_start(self, tag, attrs, alone) -> bool:
        if tag in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if not self.in_scope({"td", "th"}, table=True):
                return False
            self.leave_cell()
            return True
        return self.body_start(tag, attrs, alone)

    def cell_end(self, tag) -> bool:
        if tag in ("td", "th"):
            if self.in_scope(tag, table=True):
                self.imply()
                self.pop_to(tag)
                self.forget_to_marker()
                self.mode = "row"
            return False
        if tag in ("body", "caption", "col", "colgroup", "html"):
            return False
        if tag in ("table", "tbody", "tfoot", "thead", "tr"):
            if not self.in_scope(tag, table=True):
                return False
            self.leave_cell()
            return True
        return self.body_end(tag)

    # -- templates ---------------------------------------------------------------------------

    template_text = body_text

    def template_start(self, tag, attrs, alone) -> bool:
        if tag in HEAD_TAGS:
            return self.head_start(tag, attrs, alone)
        mode = "table" if tag in ("caption", "colgroup", "tbody", "tfoot", "thead") else "columns" if tag == "col" else "table_body" if tag == "tr" else "row" if tag in ("td", "th") else "body"
        self.templates[-1] = self.mode = mode
        return True

    def template_end(self, tag) -> bool:
        return self.head_end(tag) if tag == "template" else False

    # -- after the body, framesets ---------------------------------------------------------

    def after_body_text(self, data: str) -> str:
        lead, rest = self._lead(data)
        if lead:
            self.body_text(lead)
        if rest:
            self.mode = "body"
        return rest

    after_after_body_text = after_body_text

    def after_body_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        self.mode = "body"
        return True

    after_after_body_start = after_body_start

    def after_body_end(self, tag) -> bool:
        if tag == "html":
            self.mode = "after_after_body"
            return False
        self.mode = "body"
        return True

    def after_after_body_end(self, tag) -> bool:
        self.mode = "body"
        return True

    def frameset_text(self, data: str) -> str:
        self.text("".join(c for c in data if c in _SPACES))
        return ""

    after_frameset_text = frameset_text

    def after_after_frameset_text(self, data: str) -> str:
        lead = "".join(c for c in data if c in _SPACES)
        if lead:
            self.body_text(lead)
        return ""

    def frameset_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        if tag == "frameset":
            self.insert(tag, attrs)
        elif tag == "frame":
            self.void(tag, attrs)
        elif tag == "noframes":
            return self.head_start(tag, attrs, alone)
        return False

    def frameset_end(self, tag) -> bool:
        if tag == "frameset" and len(self.stack) > 1:
            self.stack.pop()
            if self.node.tag != "frameset":
                self.mode = "after_frameset"
        return False

    def after_frameset_start(self, tag, attrs, alone) -> bool:
        if tag == "html":
            return self.body_start(tag, attrs, alone)
        return self.head_start(tag, attrs, alone) if tag == "noframes" else False

    after_after_frameset_start = after_frameset_start

    def after_frameset_end(self, tag) -> bool:
        if tag == "html":
            self.mode = "after_after_frameset"
        return False

    def after_after_frameset_end(self, tag) -> bool:
        return False


def parse(text: str) -> Document:
    return Parser(text).doc


def parse_fragment(text: str) -> Document:
    """A fragment read as the body of a standards-mode document."""
    return Parser(f"<!DOCTYPE html><html><body>{text}").doc
