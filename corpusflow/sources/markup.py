"""Text of HTML and XML: the text nodes of a document, one per line."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.parsers import expat

# Elements without an end tag.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
# Elements whose text never counts as page text, and elements that keep blank text as it is.
_SILENT = frozenset("rp rt script style template".split())
_PREFORMATTED = frozenset("pre textarea".split())
_ASCII_BLANK = " \n\t\f\r"


class _TextNodes:
    """Collects text nodes; a node made of blanks only shrinks to one newline or one space."""

    def __init__(self):
        self.nodes: list[str] = []
        self._open: list[str] = []

    def add(self, data: str):
        self._open.append(data)

    def close(self, keep: bool = True, as_is: bool = False):
        if not self._open:
            return
        text = "".join(self._open)
        self._open = []
        if not keep or not text:
            return
        if not as_is and not text.strip(_ASCII_BLANK):
            text = "\n" if "\n" in text else " "
        self.nodes.append(text)


class _HtmlText(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self._skipped = dropped | _SILENT
        self._stack: list[str] = []
        self._skip_depth = 0
        self._pre_depth = 0
        self._text = _TextNodes()

    def _close_text(self):
        self._text.close(keep=not self._skip_depth, as_is=bool(self._pre_depth))

    def _count(self, tag: str, by: int):
        self._skip_depth += by * (tag in self._skipped)
        self._pre_depth += by * (tag in _PREFORMATTED)

    def handle_starttag(self, tag, attrs):
        self._close_text()
        if tag not in _VOID:
            self._stack.append(tag)
            self._count(tag, 1)

    def handle_startendtag(self, tag, attrs):
        self._close_text()

    def handle_endtag(self, tag):
        self._close_text()
        if tag in self._stack:
            while (top := self._stack.pop()) != tag:
                self._count(top, -1)
            self._count(tag, -1)

    def handle_data(self, data):
        self._text.add(data)

    def handle_comment(self, data):
        self._close_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._close_text()
        if data.upper().startswith("CDATA["):
            self._text.add(data[6:])
            self._close_text()

    def result(self) -> str:
        self.close()
        self._close_text()
        return "\n".join(self._text.nodes)


def html_text(markup: str, dropped: tuple[str, ...] = ()) -> str:
    """The text nodes of ``markup`` outside ``dropped`` elements, joined by newlines."""
    parser = _HtmlText(frozenset(dropped))
    parser.feed(markup)
    return parser.result()


# Elements whose text is left out of a web page.
PAGE_DROPPED = ("script", "style", "noscript", "head")


def page_text(markup: str) -> str:
    """The text of a web page: no head, script, style or noscript, at most one blank line in a row."""
    text = html_text(markup, PAGE_DROPPED).strip()
    return re.sub(r"\n{3,}", "\n\n", text)


def xml_text(markup: str) -> str:
    """All text nodes joined by newlines. Of a malformed document, the nodes before the fault."""
    text = _TextNodes()
    parser = expat.ParserCreate("utf-8")

    def boundary(*_):
        text.close()

    parser.StartElementHandler = parser.EndElementHandler = boundary
    parser.CommentHandler = parser.ProcessingInstructionHandler = boundary
    parser.CharacterDataHandler = text.add
    try:
        parser.Parse(markup.encode("utf-8"), True)
    except expat.ExpatError:
        text.close()
        if not text.nodes:
            raise
    return "\n".join(text.nodes)
