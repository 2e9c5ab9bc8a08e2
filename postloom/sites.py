"""What differs between forums: a page layout each, no code."""

from dataclasses import dataclass

from postloom.functions.select import Selector


@dataclass(frozen=True)
class Site:
    """`child` pairing looks for date and body inside each item; `zip` pairs the page's items
    with the page's dates by position, up to the shorter list, and takes the item's own text."""

    name: str
    source_url: str
    links: Selector
    items: Selector
    date: Selector
    body: Selector | None = None
    title: Selector | None = None  # on the thread page; None: the listing's link text
    pairing: str = "zip"
    date_inline: bool = False  # date as it reads on screen, not fused text nodes
    last_page_only: bool = False
    page_label: Selector | None = None


# The three layouts and the address each source is recorded under.
SITE_1 = Site(
    name="site1",
    source_url="https://borssnack.di.se/#/",
    links=Selector(tag="a", cls="bn_thread__link"),
    title=Selector(cls="bn_thread-body__title"),
    items=Selector(tag="div", cls="bn_thread-comment__container"),
    date=Selector(tag="span", cls="bn_thread-comment__date"),
    body=Selector(tag="div", cls="bn_thread-comment__body"),
    pairing="child",
)
SITE_2 = Site(
    name="site2",
    source_url="https://www.flashback.org/f487",
    links=Selector(tag="a", id_prefix="thread_title_"),
    items=Selector(tag="div", cls="post_message"),
    date=Selector(tag="div", cls="post-heading"),
    last_page_only=True,
    page_label=Selector(tag="span", cls_contains="select2-selection__placeholder"),
)
SITE_3 = Site(
    name="site3",
    source_url="https://forum.placera.se/upptack/populart",
    links=Selector(tag="a", cls_contains="text-surface-strong"),
    items=Selector(cls="post-body"),
    date=Selector(cls="text-regular-m"),
    date_inline=True,
)
SITES = [SITE_1, SITE_2, SITE_3]

# The prototype listing, a link in each title cell under a site prefix.
CELL = Selector(tag="td", cls="td_title")
CELL_LINK = Selector(tag="a", has_href=True)
CELL_LINK_BASE = "https://www.flashback.org"
