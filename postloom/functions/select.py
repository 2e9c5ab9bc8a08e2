"""Element selectors over a page outline, as column expressions: page-local, no shuffle."""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.text import squeeze, strip


@dataclass(frozen=True)
class Selector:
    """All given conditions must hold. `cls` is a whole class word, `cls_contains` a substring
    of the raw attribute: `class="post_message_x"` passes only the second."""

    tag: str | None = None
    cls: str | None = None
    cls_contains: str | None = None
    id_prefix: str | None = None
    has_href: bool = False
    href_prefix: str | None = None

    def matches(self, node: Column) -> Column:
        tests = []
        if self.tag is not None:
            tests.append(node["tag"] == self.tag)
        if self.cls is not None:
            tests.append(F.array_contains(node["classes"], self.cls))
        if self.cls_contains is not None:
            tests.append(node["class_attr"].contains(self.cls_contains))
        if self.id_prefix is not None:
            tests.append(node["id"].startswith(self.id_prefix))
        if self.has_href:
            tests.append(node["href"].isNotNull())
        if self.href_prefix is not None:
            tests.append(node["href"].startswith(self.href_prefix))
        return reduce(and_, tests) if tests else F.lit(True)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def find_all(nodes: Column, selector: Selector) -> Column:
    """Matching nodes in document order."""
    return F.filter(nodes, selector.matches)


def find(nodes: Column, selector: Selector) -> Column:
    """First match, or null."""
    return F.get(find_all(nodes, selector), 0)


def below(nodes: Column, node: Column) -> Column:
    """Descendants of a node: one slice, as `nodes` is in document order."""
    return F.slice(nodes, node["node_id"] + 2, node["end_id"] - node["node_id"])


def text_parts(texts: Column, node: Column) -> Column:
    """Text nodes under a node, as they stand on the page."""
    return F.slice(texts, node["text_from"] + 1, node["text_to"] - node["text_from"])


def text_joined(texts: Column, node: Column, separator: str = "\n") -> Column:
    """Each text node stripped, empty ones left out, the rest joined. Null for a null node."""
    parts = F.filter(F.transform(text_parts(texts, node), strip), lambda p: p != "")
    return F.array_join(parts, separator)


def text_fused(texts: Column, node: Column) -> Column:
    """As `text_joined` with nothing between: words of neighbouring elements run together."""
    return text_joined(texts, node, "")


def text_inline(texts: Column, node: Column) -> Column:
    """Text of a one-line element (a title, a link) as it reads on screen."""
    return squeeze(F.array_join(text_parts(texts, node), ""))


def zip_truncate(left: Column, right: Column, build) -> Column:
    """`build(l, r, position from 0)` over pairs, up to the shorter list."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.slice(F.arrays_zip(left.alias("l"), right.alias("r")), 1, n)
    return F.transform(pairs, lambda pair, i: build(pair["l"], pair["r"], i))
