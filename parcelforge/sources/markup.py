"""HTML read by one state machine: elements in document order, with attributes in any order, nesting and text.

A page is gone through once, from tag to tag, in time that grows with its length: quotes, comments and raw text that
never end take the rest of the page, as browsers have it.  What ends without an end tag (list items, cells, rows, options,
paragraphs, links) is ended by what can't stand in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

NAME, GAP, ATTRIBUTE, EQUALS, BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: Elements without an end tag, and those whose content is text up to it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, TITLES = frozenset(("script", "style")), frozenset(("title", "textarea"))
#: What a start tag ends, and what it doesn't reach beyond.
PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "a": (("a",), ("table", "td")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), **{x: (("thead", "tbody", "tfoot"), ("table",)) for x in ("thead", "tbody", "tfoot")},
}
#: What a plainly written start tag has behind `<`: a name and attributes that have a quoted value or none.
PLAIN = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>="'<]++(?:="[^"]*+"|='[^']*+'|(?!=)))*+)\s*+/?+>""")
PAIRS = re.compile(r"""([^\s="']+)(?:="([^"]*)"|='([^']*)')?""")
#: Short plain tags that were read, by what they say (name, attributes, which an end tag has none of, what the tag ends), and how many are kept.
TAGS: dict[str, tuple[str, dict[str, str] | None, tuple | None]] = {}
MOST_TAGS, SHORT = 5000, 64


def clean(text: str | None) -> str:
    return " ".join(text.split()) if text else ""


class Page:
    """Elements by number: names, attributes (raw), where their text begins and ends in `texts`, and the last element within each."""

    def __init__(self, source: str):
        self.names: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.last: list[int] = []
        self.texts: list[str] = []  # raw
        self.kinds: list[str] = []  # the raw element that a text is of, or ""
        self.open: list[int] = []
        self.opened: dict[str, int] = {}
        if not self.read_plain(source):
            for x in (self.names, self.attrs, self.begin, self.end, self.last, self.texts, self.kinds, self.open, self.opened):
                x.clear()
            self.read(source)
        while self.open:
            self.pop()

    def read_plain(self, s: str) -> bool:
        """What read() does, for pages whose tags are plainly written: pieces are what is between `<`, and tags that were met before
        aren't read again.  False if a tag is written otherwise; then read() has to begin anew."""
        names, attrs, begin, end, last, texts, kinds, stack, opened = self.names, self.attrs, self.begin, self.end, self.last, self.texts, self.kinds, self.open, self.opened
        pieces = iter(s.split("<"))
        if text := next(pieces):
            self.say(text)
        raw, content, comment = "", [], False
        for piece in pieces:
            stop = piece.find(">")
            known = TAGS.get(piece[:stop]) if stop > 0 and not raw and not comment else None
            if known is not None:
                text = piece[stop + 1 :]
            else:
                mark = piece[:1]
                if raw:  # up to its end tag
                    rest = piece[len(raw) + 1 : len(raw) + 2]
                    if mark != "/" or piece[1 : len(raw) + 1].lower() != raw or not (rest in ("/", ">") or rest.isspace()) or not rest:
                        content.append(piece)
                        continue
                    self.say("<".join(content), raw if raw in RAW else "")
                    raw = ""
                if comment or piece.startswith("!--"):
                    end_at = piece.find("-->", 0 if comment else 3)
                    comment = end_at < 0
                    text = "" if comment else piece[end_at + 3 :]
                elif not mark or not (mark in "/!?" or (mark.isascii() and mark.isalpha())):
                    self.say("<")
                    text = piece
                elif stop < 0:
                    return False
                elif mark in "!?":
                    text = piece[stop + 1 :]
                else:
                    if mark == "/":
                        m, at = NAME.match(piece, 1, stop), stop + 1
                        known = (m[0].lower() if m else "", None, None)
                    elif m := PLAIN.match(piece):
                        given: dict[str, str] = {}
                        for key, x, y in PAIRS.findall(m[2]) if m[2] else ():
                            given.setdefault(key.lower(), x or y)
                        name, at = m[1].lower(), m.end()
                        known = (name, given, ENDS.get(name) or ((("p",), ("table", "td", "li", "div")) if name in PARAGRAPH else None))
                    else:
                        return False
                    if at == stop + 1 and stop <= SHORT:
                        if len(TAGS) >= MOST_TAGS:
                            TAGS.clear()
                        TAGS[piece[:stop]] = known
                    text = piece[at:]
            if known is not None:
                name, given, rule = known
                if given is None:
                    if name and opened.get(name):
                        n, k = len(names) - 1, -1
                        while k < 0 or names[k] != name:
                            k = stack.pop()
                            end[k], last[k] = len(texts), n
                            opened[names[k]] -= 1
                else:
                    if rule:
                        self.end_before(*rule)
                    k, place = len(names), len(texts)
                    names.append(name)
                    attrs.append(given)
                    begin.append(place)
                    end.append(place)
                    last.append(k)
                    if name not in VOID:
                        stack.append(k)
                        opened[name] = opened.get(name, 0) + 1
                        if name in RAW or name in TITLES:
                            raw, content = name, [text]
                            continue
            if text:
                texts.append(text)
                kinds.append("")
        if raw:
            self.say("<".join(content), raw if raw in RAW else "")
        return True

    def read(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            tag = s.find("<", at)
            if tag < 0:
                tag = n
            if tag > at:
                self.say(s[at:tag])
            if tag >= n:
                return
            mark = s[tag + 1 : tag + 2]
            if s.startswith("<!--", tag):
                stop = s.find("-->", tag + 4)
                at = n if stop < 0 else stop + 3
            elif mark in ("!", "?", "/") and mark:
                stop = s.find(">", tag)
                at = n if stop < 0 else stop + 1
                if mark == "/" and stop >= 0 and (m := NAME.match(s, tag + 2)):
                    self.close(m[0].lower())
            elif m := NAME.match(s, tag + 1):
                at = self.start(s, m[0].lower(), m.end())
            else:
                self.say("<")
                at = tag + 1

    def start(self, s: str, name: str, at: int) -> int:
        """Reads a start tag behind its name, and the content of raw elements; gives the place behind."""
        attrs: dict[str, str] = {}
        n = len(s)
        while True:
            at = GAP.match(s, at).end()
            if at >= n:
                return n
            if s[at] == ">":
                at += 1
                break
            m = ATTRIBUTE.match(s, at)
            key, at, value = m[0].lower(), m.end(), ""
            if m := EQUALS.match(s, at):
                at = m.end()
                quote = s[at : at + 1]
                if quote in ("'", '"') and quote:
                    stop = s.find(quote, at + 1)
                    if stop < 0:
                        return n
                    value, at = s[at + 1 : stop], stop + 1
                else:
                    m = BARE.match(s, at)
                    value, at = m[0], m.end()
            attrs.setdefault(key, value)
        if name in ENDS:
            self.end_before(*ENDS[name])
        elif name in PARAGRAPH:
            self.end_before(("p",), ("table", "td", "li", "div"))
        self.names.append(name)
        self.attrs.append(attrs)
        self.begin.append(len(self.texts))
        self.end.append(len(self.texts))
        self.last.append(len(self.names) - 1)
        if name in VOID:
            return at
        self.open.append(len(self.names) - 1)
        self.opened[name] = self.opened.get(name, 0) + 1
        if name in RAW or name in TITLES:
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(s, at)
            stop = m.start() if m else n
            self.say(s[at:stop], name if name in RAW else "")
            return stop
        return at

    def say(self, text: str, kind: str = "") -> None:
        self.texts.append(text)
        self.kinds.append(kind)

    def pop(self) -> str:
        k = self.open.pop()
        self.end[k], self.last[k] = len(self.texts), len(self.names) - 1
        self.opened[self.names[k]] -= 1
        return self.names[k]

    def close(self, name: str) -> None:
        if self.opened.get(name):
            while self.pop() != name:
                pass

    def end_before(self, kinds: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        for k in kinds:
            if self.opened.get(k):
                break
        else:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.names[self.open[depth]]
            if name in kinds:
                while len(self.open) > depth:
                    self.pop()
                return
            if name in bounds:
                return

    def within(self, top: int | None = None) -> range:
        """The elements below one, in document order; all of them."""
        return range(len(self.names)) if top is None else range(top + 1, self.last[top] + 1)

    def having(self, name: str | None = None, cls: str | None = None, top: int | None = None) -> Iterator[int]:
        """Elements of a name and a class."""
        span = self.within(top)
        if name is not None and name not in self.names:
            return
        for k in span:
            if (name is None or self.names[k] == name) and (cls is None or cls in self.attrs[k].get("class", "").split()):
                yield k

    def attr(self, k: int, name: str) -> str | None:
        """With entities decoded."""
        value = self.attrs[k].get(name)
        return html.unescape(value) if value and "&" in value else value

    def text(self, k: int | None = None) -> str:
        """All text of an element, that of scripts too, as a document has it."""
        a, b = (0, len(self.texts)) if k is None else (self.begin[k], self.end[k])
        plain = "".join(self.texts[a:b])
        return plain if "&" not in plain else "".join(t if kind else html.unescape(t) for t, kind in zip(self.texts[a:b], self.kinds[a:b], strict=True))

    def visible(self) -> str:
        """Raw text without scripts and styles, apart where tags are."""
        return clean(" ".join(t for t, kind in zip(self.texts, self.kinds, strict=True) if not kind))
