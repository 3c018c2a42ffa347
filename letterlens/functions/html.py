"""Visible text of HTML, as an Arrow job around the standard library's parser."""

import re
from functools import cache
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Elements whose text a reader does not see as running text.
HIDDEN = frozenset(("script", "style", "template", "rt", "rp"))
AMPERSAND = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


class _TextNodes(HTMLParser):
    """Collects stripped text nodes; any tag, comment or declaration ends a node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.current, self.hidden = [], [], []

    def end_node(self):
        node = "".join(self.current).strip()
        self.current.clear()
        if node and not self.hidden:
            self.nodes.append(node)

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag):]

    def handle_data(self, data):
        self.current.append(data)

    def handle_comment(self, data):
        self.end_node()

    handle_decl = handle_pi = unknown_decl = handle_comment


def _bare_kept(match: re.Match) -> str:
    ended = match[1]
    return match[0] if ended and (ended[0] == "#" or ended in html5) else "&amp;" + (ended or "")


def visible_text_of(html: str, bare_references: bool = True) -> str:
    """Browsers also decode some character references that no semicolon ends; bare_references=False leaves these as they stand."""
    parser = _TextNodes()
    parser.feed(html if bare_references else AMPERSAND.sub(_bare_kept, html))
    parser.close()
    parser.end_node()
    return " ".join(parser.nodes)


@cache
def _visible_text(bare_references: bool):
    @F.arrow_udf(T.StringType())
    def visible(html: pa.Array) -> pa.Array:
        return pa.array([visible_text_of(h, bare_references) if h else "" for h in html.to_pylist()], pa.string())

    return visible


def visible_text(html: Column | str, bare_references: bool = True) -> Column:
    return _visible_text(bare_references)(html)
