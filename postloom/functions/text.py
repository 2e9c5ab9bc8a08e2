"""Whitespace, blankness and URL helpers: one definition, used everywhere."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class that Java and RE2 both read.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same set as Java finds it soonest: one look-up below 256, and most others ruled out by a range.
_WS_JAVA = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)

# Whole-field spellings of "missing" in CSV text.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Fixed value: the page counter shown on a thread page, "page X of Y".
PAGE_COUNT = r"Sidan \d+ av (\d+)"


def strip(c: Column) -> Column:
    """Both ends without white space. `trim` alone takes only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; looks no further than the first real character."""
    return c.isNull() | (F.ltrim(c, F.lit(WHITESPACE)) == "")


def squeeze(c: Column) -> Column:
    """Stripped, with each inner run of white space as one space."""
    return strip(F.regexp_replace(c, WS + "+", " "))


def words(c: Column) -> Column:
    """White-space separated tokens; blank text has none."""
    return F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.split(strip(c), _WS_JAVA + "+"))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def shown_page_count(label: Column) -> Column:
    """Y of "page X of Y"; null when the label is absent or reads otherwise."""
    return F.regexp_extract(label, PAGE_COUNT, 1).try_cast("int")


def page_count(label: Column) -> Column:
    """Y of "page X of Y"; 1 when the label is absent or reads otherwise."""
    return F.coalesce(shown_page_count(label), F.lit(1))


def last_page_url(thread_url: Column, pages: Column) -> Column:
    return F.concat(thread_url, F.lit("p"), pages.cast("string"))


def absolute_url(href: Column, base: Column) -> Column:
    """A link as a browser reports it: blanks around it and line breaks inside go; it may be
    absolute, protocol-, root-, page-, query- or fragment-relative; `.` and `..` are followed."""
    given = F.regexp_replace(
        F.regexp_replace(href, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""
    )
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    page = F.regexp_replace(base, "#.*$", "")
    path = F.regexp_replace(base, "[?#].*$", "")
    whole = (
        F.when(given.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), given)
        .when(given.startswith("//"), F.concat(scheme, given))
        .when(given.startswith("/"), F.concat(root, given))
        .when(given.startswith("#"), F.concat(page, given))
        .when(given.startswith("?"), F.concat(path, F.when(path == root, "/").otherwise(""), given))
        .when(given == "", given)
        .otherwise(F.concat(folder, F.when(folder == root, "/").otherwise(""), given))
    )
    return without_dots(whole)


_DOTS = r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.{1,2}(?:[/?#]|$)"


def without_dots(url: Column) -> Column:
    """An address whose path has no `.` and `..` steps left; others stay as they are."""
    host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    steps = F.split(path, "/")

    def follow(done, step):
        return (
            F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(step == ".", done)
            .otherwise(F.concat(done, F.array(step)))
        )

    # The path begins with a slash, so its first step is empty.
    kept = F.aggregate(
        F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), follow
    )
    open_end = F.element_at(steps, -1).isin(".", "..")
    kept = F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(
        url.rlike(_DOTS), F.concat(host, F.lit("/"), F.array_join(kept, "/"), tail)
    ).otherwise(url)


def prefixed_url(href: Column, base: str) -> Column:
    """A root-relative link under a fixed site address."""
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).otherwise(
        F.concat(F.lit(base), href)
    )
