"""A page's parts by its structure: one pass over its tags with a stack of the open ones.

Patterns can't count nesting; a stack can.  The reader takes the first main element, role of it, article and body, the
first heading and title, what the markup names as an employer, meta tags and scripts.  Text of elements that hold no
content, nested or not, is left out of the parts; a closing tag without its opening one is passed over, and one that
closes an outer element closes what is open within it.  Time grows with the length of the page.
"""

from __future__ import annotations

import html
import re

NOISE = frozenset(["script", "style", "svg", "noscript", "iframe", "template", "header", "footer", "nav", "aside", "form"])
NOISE_ROLES = frozenset(["navigation", "banner", "contentinfo"])
#: Elements whose content is no markup, elements without content, and text that is nobody's.
RAW, VOID, SILENT = frozenset(["script", "style"]), frozenset("area base br col embed hr img input link meta source track wbr".split()), frozenset(["script", "style", "noscript", "template"])
#: What ends an open paragraph, and items that end one of their own kind.
BLOCKS = frozenset("address article aside blockquote body div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
ITEMS = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
PARTS = ["main", "role", "article", "body", "h1", "title"]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^\"'<>]++|\"[^\"]{0,20000}+\"|'[^']{0,20000}+'){0,500}+)>|<[!?][^<>]*+>", re.S)
#: A tag has 500 attributes and quoted values of 20,000 signs at most; what goes beyond is text, so that time stays linear.
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile("[ \\t\\n\\r\\f\\u00A0]+")


def collapsed(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def attributes(text: str) -> dict[str, str]:
    """By lower-cased name; of equal names the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _employer(named: dict[str, str]) -> bool:
    kind = named.get("class", "").lower()
    return named.get("itemprop") == "hiringOrganization" or "company" in named.get("data-testid", "").lower() or "company" in kind or "employer" in kind


class Page:
    """What one reading of a page finds."""

    def __init__(self, page: str) -> None:
        self.texts: list[str] = []  # pieces of text
        self.calm: list[bool] = []  # whether a piece is content
        self.spans: dict[str, list[int]] = {}  # part: first and last piece
        self.employers: list[list[int]] = []
        self.metas: dict[str, str] = {}
        self.scripts: list[tuple[str, str]] = []  # attributes, body
        self._stack: list[tuple[str, bool, bool, list]] = []  # name, noise, silent, spans that end with it
        self._open: dict[str, int] = {}
        self._noise = self._silent = 0
        self._read(page)

    def _read(self, page: str) -> None:
        at = 0
        while True:
            token = _TOKEN.search(page, at)
            self._text(page[at : token.start()] if token else page[at:])
            if not token:
                break
            at = token.end()
            closing, name, rest = token.group(1), (token.group(2) or "").lower(), token.group(3)
            if not name:
                continue
            if closing:
                self._close(name)
                continue
            self._begin(name, rest)
            if name in RAW:
                end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                stop = end.start() if end else len(page)
                if name == "script":
                    self.scripts.append((rest, page[at:stop]))
                at = end.end() if end else len(page)
                self._close(name)
        while self._stack:
            self._pop()

    def _text(self, raw: str) -> None:
        if raw and not self._silent:
            self.texts.append(html.unescape(raw) if "&" in raw else raw)
            self.calm.append(not self._noise)

    def _begin(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self._end_within(("p",), BLOCKS)
        if name in ITEMS:
            self._end_within(ITEMS[name], frozenset(["ul", "ol", "dl", "table", "select", "tbody", "thead"]))
        named = attributes(rest) if "=" in rest else {}
        if name == "meta":
            key = named.get("property") or named.get("name")
            if key and collapsed(named.get("content", "")):
                self.metas.setdefault(key.lower(), collapsed(named["content"]))
        if name in VOID or rest.endswith("/"):
            return
        role = named.get("role", "").lower()
        noise, silent = name in NOISE or role in NOISE_ROLES, name in SILENT
        spans = []
        here = len(self.texts)
        for part in (name, "role" if role == "main" else ""):
            outside = part in ("h1", "title") or not (self._noise or noise)
            if part in PARTS and part not in self.spans and outside:
                spans.append(self.spans.setdefault(part, [here, here]))
        if named and _employer(named):
            self.employers.append([here, here])
            spans.append(self.employers[-1])
        self._stack.append((name, noise, silent, spans))
        self._open[name] = self._open.get(name, 0) + 1
        self._noise += noise
        self._silent += silent

    def _end_within(self, names: tuple[str, ...], bounds: frozenset[str]) -> None:
        """Closes the innermost of the names, unless one of the bounds lies within it."""
        if not any(self._open.get(n) for n in names):
            return
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] in names:
                while len(self._stack) > depth:
                    self._pop()
                return
            if self._stack[depth][0] in bounds:
                return

    def _close(self, name: str) -> None:
        if self._open.get(name):
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name, noise, silent, spans = self._stack.pop()
        self._open[name] -= 1
        self._noise -= noise
        self._silent -= silent
        for span in spans:
            span[1] = len(self.texts)
        return name

    def part(self, name: str) -> str:
        """A part's text: of containers without noise, of headings and titles whole; empty where there is none."""
        if name not in self.spans:
            return ""
        low, high = self.spans[name]
        whole = name in ("h1", "title")
        return collapsed(" ".join(t for t, calm in zip(self.texts[low:high], self.calm[low:high], strict=True) if whole or calm))

    def main(self, least: int, most: int) -> str | None:
        """The first of main, the role of it, article and body with ``least`` signs of text, cut at ``most``."""
        found = next((t for t in map(self.part, PARTS[:4]) if len(t) >= least), None)
        return found[:most] if found else None

    def employer(self) -> str | None:
        """The first text of 2 to 80 signs of an element that its markup names as an employer."""
        texts = (collapsed(" ".join(self.texts[a:b])) for a, b in self.employers if sum(map(len, self.texts[a : min(b, a + 80)])) <= 4000)
        return next((t for t in texts if 2 <= len(t) <= 80), None)
