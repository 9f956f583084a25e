"""One-pass HTML parse (X3, X4, X7) as an Arrow UDF that works block by block.

Per page it returns a struct:
  title  - text of the first <title> when that element holds a single string
  text   - every text node outside script/style/header/footer/nav, in document
           order, joined by a newline (squash it with ``squash_lines``)
  links  - every <a href> in document order: raw href, absolute URL
           (``urljoin`` against the page URL) and the anchor's text

The tree rules follow a lenient parser over the stdlib tokenizer: void
elements do not nest, an end tag closes the most recent open element of that
name (and everything opened inside it), an unmatched end tag is ignored, and
comments split text nodes while character references do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Subtrees dropped before text extraction, and void elements.
DROPPED = {"script", "style", "header", "footer", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
        "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
        "command", "frame", "image", "isindex", "nextid", "spacer"}

BLOCK_BYTES = 1 << 20   # pages parsed at a time

PARSED = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("href", T.StringType()),
        T.StructField("abs_url", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
    T.StructField("error", T.StringType()),
])
ARROW = pa.struct([("title", pa.string()), ("text", pa.string()),
                   ("links", pa.list_(pa.struct([("href", pa.string()), ("abs_url", pa.string()), ("text", pa.string())]))),
                   ("error", pa.string())])


class _PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[list] = []        # [name, link_index or None, is_title]
        self.dropped = 0
        self.pending: list[str] = []
        self.nodes: list[str] = []
        self.links: list[list] = []        # [href, [text parts]]
        self.open_links: list[int] = []
        self.title_state = 0               # 0 none yet, 1 inside first title, 2 done
        self.title_children: list = []

    # text nodes ---------------------------------------------------------
    def _flush(self):
        if not self.pending:
            return
        s = "".join(self.pending)
        self.pending = []
        if not self.dropped:
            self.nodes.append(s)
        if self.title_state == 1 and self._title_is_parent():
            self.title_children.append(("s", s))

    def _title_is_parent(self):
        return bool(self.stack) and self.stack[-1][2]

    def handle_data(self, data):
        self.pending.append(data)
        for i in self.open_links:
            self.links[i][1].append(data)

    # tags ---------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        if self.title_state == 1 and self._title_is_parent():
            self.title_children.append(("e", tag))
        if tag == "a":
            d = dict(attrs)
            if "href" in d:
                self.links.append([d["href"] if d["href"] is not None else "", []])
                if tag not in VOID:
                    link_idx = len(self.links) - 1
                else:
                    link_idx = None
            else:
                link_idx = None
        else:
            link_idx = None
        if tag in VOID:
            return
        is_title = tag == "title" and self.title_state == 0
        if is_title:
            self.title_state = 1
        self.stack.append([tag, link_idx, is_title])
        if tag in DROPPED:
            self.dropped += 1
        if link_idx is not None:
            self.open_links.append(link_idx)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for pos in range(len(self.stack) - 1, -1, -1):
            if self.stack[pos][0] == tag:
                for name, link_idx, is_title in reversed(self.stack[pos:]):
                    self._close(name, link_idx, is_title)
                del self.stack[pos:]
                return

    def _close(self, name, link_idx, is_title):
        if name in DROPPED:
            self.dropped -= 1
        if link_idx is not None:
            self.open_links.remove(link_idx)
        if is_title:
            self.title_state = 2

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def finish(self):
        self.close()
        self._flush()
        for name, link_idx, is_title in reversed(self.stack):
            self._close(name, link_idx, is_title)
        self.stack = []

    def title(self):
        if self.title_state == 0:
            return None
        kids = self.title_children
        if len(kids) == 1 and kids[0][0] == "s":
            return kids[0][1]
        return None


def parse_page(html: str | None, base_url: str | None) -> dict:
    if html is None:
        return {"title": None, "text": None, "links": [], "error": None}
    p = _PageParser()
    error = None
    try:
        p.feed(html)
        p.finish()
    except Exception as exc:  # noqa: BLE001 - one page must not end the job: its receipt names the error
        error = f"{type(exc).__name__}: {exc}"
        p._flush()
    links = []
    for href, parts in p.links:
        try:
            absolute = urljoin(base_url or "", href)
        except ValueError:
            absolute = None
        links.append({"href": href, "abs_url": absolute, "text": "".join(parts)})
    return {"title": p.title(), "text": "\n".join(p.nodes), "links": links, "error": error}


def _blocks(html: pa.Array):
    """Ranges [a, b) of rows whose pages hold about BLOCK_BYTES together (a longer page is a range of its own)."""
    a = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(html), 0).to_pylist()):
        if i > a and size + n > BLOCK_BYTES:
            yield a, i
            a, size = i, 0
        size += n
    if len(html) > a:
        yield a, len(html)


def _parse_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Pages are decoded, parsed and sent on block by block, so a worker holds the Arrow batch it was given and the
    objects of one block, however many rows the batch has."""
    for html, url in batches:
        for a, b in _blocks(html):
            yield pa.array([parse_page(h, u) for h, u in zip(html.slice(a, b - a).to_pylist(),
                                                             url.slice(a, b - a).to_pylist(), strict=True)], ARROW)


# Declared nondeterministic so the optimizer never copies the call into a
# pushed-down filter: each page is parsed exactly once per plan.
parse_html = F.arrow_udf(_parse_batches, PARSED).asNondeterministic()
