"""One pass over HTML documents: a node table per page.

Only reading a document is Python, one document at a time inside ``mapInArrow``.
Choosing, scoring and deduplicating happens in ``pageloom.operators.html`` on the
resulting rows.

Elements are numbered in document order; an element spans the numbers from its
own ``pos`` to ``last``.  The shown texts of a page are stored once, in its
``page`` row; blocks and paragraphs hold only the interval of their texts there.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pageloom.constants import BLOCK_TAGS, BOILERPLATE_TAGS

VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
_SPAN = pa.struct([("pos", pa.int32()), ("first", pa.int32()), ("stop", pa.int32())])
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("pos", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("around", pa.list_(pa.string())),
    ("last", pa.int32()), ("first", pa.int32()), ("stop", pa.int32()), ("length", pa.int32()), ("paragraphs", pa.int32()),
    ("texts", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)),
])
NODE_SCHEMA = (
    "page_id bigint, url string, pos int, kind string, tag string, attrs map<string,string>, text string, "
    "around array<string>, last int, first int, stop int, length int, paragraphs int, texts array<string>, "
    "spans array<struct<pos: int, first: int, stop: int>>"
)
HEADINGS = ("h1",)
# classes of elements whose text is kept
TITLE_CLASSES = frozenset({"post-title"})
BATCH_CHARS = 4 << 20


class _Open:
    """An element that is still open, and how many texts and paragraphs came before it."""

    __slots__ = ("tag", "attrs", "image", "hidden", "pos", "words", "shown", "spans", "raw", "marks")

    def __init__(self, tag, attrs, hidden, pos, words, shown, spans, marks):
        self.tag, self.attrs, self.hidden, self.pos = tag, attrs, hidden, pos
        self.words, self.shown, self.spans, self.marks = words, shown, spans, marks
        self.image, self.raw = None, []


class NodeReader(HTMLParser):
    """Collects node rows; unclosed elements reach to the end of their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.rows: list[dict] = []
        self.count = 0
        self.words: list[str] = []    # every text
        self.shown: list[str] = []    # those outside of boilerplate
        self.lengths = [0]            # running cleaned length of the shown ones
        self.spans: list[tuple] = []  # (pos, first, stop) of paragraphs, in closing order

    def _row(self, node: _Open, kind: str, text: str | None = None, **more) -> None:
        attrs = dict(node.attrs)
        if node.image:
            attrs.update({f"img.{k}": v for k, v in node.image.items()})
        self.rows.append({
            "pos": node.pos, "kind": kind, "tag": node.tag, "attrs": list(attrs.items()), "text": text,
            "around": self._around(node), "last": self.count, **more,
        })

    def _around(self, node: _Open) -> list[str]:
        """Tags and classes of the element, for selectors; of an anchor also those around it.

        Only anchors are chosen by what is around them, so deep nesting is not written out for each element.
        """
        outer = [m for n in self.stack for m in n.marks] if node.tag == "a" else []
        return outer + ["self:" + m for m in node.marks]

    def handle_starttag(self, tag, attrs):
        self.count += 1
        hidden = (self.stack[-1].hidden if self.stack else False) or tag in BOILERPLATE_TAGS
        named = {k: (v if v is not None else "") for k, v in attrs}
        classes = (named.get("class") or "").split()
        marks = [tag, *[f".{c}" for c in classes], *[f"{tag}.{c}" for c in classes]]
        node = _Open(tag, named, hidden, self.count, len(self.words), len(self.shown), len(self.spans), marks)
        if tag == "img":
            for outer in self.stack:
                if outer.tag == "a" and outer.image is None:
                    outer.image = node.attrs
        if tag in VOID:
            if tag in ("meta", "img", "link"):
                self._row(node, {"meta": "meta", "img": "image", "link": "rel"}[tag])
            return
        self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.stack):
            while self.stack[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.stack:
            return
        inner = self.stack[-1]
        if inner.tag in ("script", "style"):
            inner.raw.append(data)
            return
        data = data.strip()
        if not data:
            return
        self.words.append(data)
        if not inner.hidden:
            self.shown.append(data)
            self.lengths.append(self.lengths[-1] + len(" ".join(data.split())))

    def _text(self, node: _Open) -> str:
        return " ".join(" ".join(self.words[node.words:]).split())

    def _close(self):
        node = self.stack.pop()
        if node.tag == "script":
            if node.attrs.get("type") == "application/ld+json":
                self._row(node, "jsonld", "".join(node.raw).strip())
            return
        if node.tag == "style":
            return
        stop = len(self.shown)
        if node.tag == "title":
            self._row(node, "title", self._text(node))
        elif node.tag == "a" and "href" in node.attrs:
            self._row(node, "link", self._text(node))
        elif node.tag == "p" and not node.hidden:
            if stop > node.shown:
                self.spans.append((node.pos, node.shown, stop))
        elif node.tag in (*BLOCK_TAGS, "body") and not node.hidden:
            pieces = stop - node.shown
            self._row(
                node, "block", first=node.shown, stop=stop, paragraphs=len(self.spans) - node.spans,
                # as long as the texts with one space between them
                length=self.lengths[stop] - self.lengths[node.shown] + max(pieces - 1, 0),
            )
        classes = node.attrs.get("class")
        if node.tag in HEADINGS or classes:
            kept = node.tag in HEADINGS or not TITLE_CLASSES.isdisjoint(classes.split())
            self._row(node, "element", self._text(node) if kept else None)

    def read(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        while self.stack:
            self._close()
        spans = [dict(zip(("pos", "first", "stop"), s)) for s in sorted(self.spans)]
        self.rows.append({"pos": 0, "kind": "page", "last": self.count, "texts": self.shown, "spans": spans})
        return self.rows


def extract_nodes(pages: DataFrame) -> DataFrame:
    """Node rows of every page: page, meta, title, jsonld, link, image, rel, block, element.

    ``pages``: page_id, url, html; a null page reads as an empty one.  ``pos``
    orders the nodes of a page.  Every page has one ``page`` row.  Rows leave in
    batches of a few million characters of html.  The texts of blocks and
    paragraphs are stored once, so nesting does not multiply them; links, titles
    and headings hold their own text, and one inside another holds it again.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for page_id, url, html in zip(*[batch.column(c) for c in ("page_id", "url", "html")]):
                html, known = html.as_py() or "", {"page_id": page_id.as_py(), "url": url.as_py()}
                rows += [{**known, **row} for row in NodeReader().read(html)]
                size += len(html)
                if size >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return pages.selectExpr("cast(page_id as bigint) AS page_id", "url", "html").mapInArrow(read, NODE_SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)
