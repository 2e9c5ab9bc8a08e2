"""HTML string to page outline: the one Python hop of the extraction."""

from collections import Counter
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# `texts` holds the page's text nodes once. A node names its own subtree by two ranges:
# nodes (node_id, end_id] and texts [text_from, text_to). So the outline grows with the page,
# however deep unclosed tags nest. node_id is the node's position in `nodes`.
_NODE_FIELDS = {
    "node_id": T.IntegerType(),
    "end_id": T.IntegerType(),
    "tag": T.StringType(),
    "id": T.StringType(),
    "class_attr": T.StringType(),
    "classes": T.ArrayType(T.StringType()),
    "href": T.StringType(),
    "text_from": T.IntegerType(),
    "text_to": T.IntegerType(),
}
NODE = T.StructType([T.StructField(name, kind) for name, kind in _NODE_FIELDS.items()])
OUTLINE = T.StructType(
    [
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("nodes", T.ArrayType(NODE)),
    ]
)

# Elements that never stay open, and elements whose text is not page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
MUTED = frozenset(["script", "style", "template", "rp", "rt"])

_KEPT = ("id", "class", "href")
_END_ID, _TAG, _TEXT_TO = (NODE.names.index(f) for f in ("end_id", "tag", "text_to"))


class OutlineParser(HTMLParser):
    """Collects one page's nodes (as lists in `NODE` field order) and text nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=False)

    def read(self, html):
        self.reset()
        self.texts, self.nodes = [], []
        self._open, self._open_tags, self._muted, self._run = [], Counter(), 0, []
        self.feed(html)
        self.close()
        self._end_text()
        while self._open:
            self._close_last()
        return self.texts, self.nodes

    def _end_text(self):
        if self._run:
            if not self._muted:
                self.texts.append("".join(self._run))
            self._run = []

    def _close_last(self):
        node = self._open.pop()
        tag = node[_TAG]
        self._open_tags[tag] -= 1
        self._muted -= tag in MUTED
        node[_END_ID], node[_TEXT_TO] = len(self.nodes) - 1, len(self.texts)

    def handle_starttag(self, tag, attrs):
        self._end_text()
        given = dict(attrs)
        name, cls, href = (given[key] or "" if key in given else None for key in _KEPT)
        here, texts = len(self.nodes), len(self.texts)
        node = [here, here, tag, name, cls, cls.split() if cls else [], href, texts, texts]
        self.nodes.append(node)
        if tag not in VOID:
            self._open.append(node)
            self._open_tags[tag] += 1
            self._muted += tag in MUTED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_last()

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self._end_text()
        if self._open_tags[tag]:
            while self._open[-1][_TAG] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self._run.append(data)

    def handle_entityref(self, name):
        self._run.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self._run.append(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self._end_text()
        if data.startswith("CDATA["):
            self._run.append(data[len("CDATA["):])
            self._end_text()


def outline(html):
    """Outline of one page, or None when the markup cannot be tokenised at all."""
    if html is None:
        return None
    try:
        return OutlineParser().read(html)
    except (AssertionError, ValueError):
        return None


_CHUNK_CHARS = 4 << 20
_ARROW_TYPES = {name: to_arrow_type(kind) for name, kind in _NODE_FIELDS.items()}


def _to_arrow(pages) -> pa.Array:
    """Outlines of some pages as one Arrow array, built column by column."""
    text_ends, node_ends, texts, rows = [0], [0], [], []
    for page in pages:
        page_texts, page_nodes = page or ([], [])
        texts.extend(page_texts)
        rows.extend(page_nodes)
        text_ends.append(len(texts))
        node_ends.append(len(rows))
    columns = zip(*rows) if rows else [[] for _ in _ARROW_TYPES]
    nodes = pa.StructArray.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, _ARROW_TYPES.values())],
        names=list(_ARROW_TYPES),
    )
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(text_ends, pa.int32()), pa.array(texts, pa.string())),
            pa.ListArray.from_arrays(pa.array(node_ends, pa.int32()), nodes),
        ],
        names=["texts", "nodes"],
        mask=pa.array([page is None for page in pages], pa.bool_()),
    )


def _outlines(html: pa.Array) -> pa.Array:
    """Arrow batch of pages to Arrow batch of outlines. Python objects are turned into Arrow
    every few megabytes of html, so that a batch of large pages does not pile them up."""
    done, pages, size = [], [], 0
    for value in html:
        page = value.as_py()
        pages.append(outline(page))
        size += len(page or "")
        if size > _CHUNK_CHARS:
            done.append(_to_arrow(pages))
            pages, size = [], 0
    done.append(_to_arrow(pages))
    return pa.concat_arrays(done)


# Non-deterministic so that a filter on the result never makes Spark parse each page twice;
# filter pages on their own columns before this call.
parse_html = F.arrow_udf(_outlines, OUTLINE).asNondeterministic()
