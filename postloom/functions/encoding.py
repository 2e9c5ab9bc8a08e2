"""Bytes of a page to its text, in the encoding a browser would take it to be in."""

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a page is searched for a declaration.
HEAD_BYTES = 1024

# Labels that pages declare, by the encoding they mean. A page that declares UTF-16
# in its own ASCII-readable head is not in UTF-16.
UTF_8 = ["utf-8", "utf8", "unicode-1-1-utf-8", "unicode11utf8", "unicode20utf8", "x-unicode20utf8",
         "utf-16", "utf-16le", "utf-16be"]
WINDOWS_1252 = ["ascii", "us-ascii", "ansi_x3.4-1968", "iso-8859-1", "iso8859-1", "iso88591",
                "iso_8859-1", "iso_8859-1:1987", "iso-ir-100", "csisolatin1", "latin1", "l1",
                "ibm819", "cp819", "cp1252", "x-cp1252", "windows-1252"]
# What bytes 80 to 9F mean in windows-1252 where they are not control characters.
_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ",
    0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“",
    0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
CONTROLS, LETTERS = "".join(map(chr, _HIGH)), "".join(_HIGH.values())


def encoding_of(content: Column) -> Column:
    """The encoding of a page's bytes: by its byte order mark, else by the first `meta` in its head
    that declares one we know, else UTF-8 where the bytes are valid UTF-8, else windows-1252.
    Null for null."""
    mark = F.hex(F.substring(content, 1, 3))
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    head = F.regexp_replace(head, r"(?s)<!--.*?-->", "")
    label = F.lower(
        F.regexp_extract(head, r"""(?is)<meta\s[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.-]+)""", 1)
    )
    return (
        F.when(content.isNull(), F.lit(None))
        .when(mark == "EFBBBF", "utf-8")
        .when(mark.startswith("FEFF"), "utf-16be")
        .when(mark.startswith("FFFE"), "utf-16le")
        .when(label.isin(UTF_8), "utf-8")
        .when(label.isin(WINDOWS_1252), "windows-1252")
        .when(_known(label), label)
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("windows-1252")
    )


#: Further encodings that pages declare, as Python names them.
OTHERS = sorted(
    {"windows-1250", "windows-1251", "windows-1253", "windows-1254", "windows-1255", "windows-1256",
     "windows-1257", "windows-1258", "windows-874", "koi8-r", "koi8-u", "macintosh", "big5", "gbk",
     "gb2312", "gb18030", "euc-jp", "euc-kr", "shift_jis", "iso-2022-jp", "ibm866"}
    | {f"iso-8859-{i}" for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15, 16)}
)
_PYTHON = {"windows-874": "cp874", "macintosh": "mac_roman", "ibm866": "cp866", "gb2312": "gbk"}


def _known(label: Column) -> Column:
    return label.isin(OTHERS)


def decoder():
    """A column function (bytes, encoding) to text, for the encodings that Spark's own functions do
    not read or not without failing on a broken byte. Null bytes in, null out."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, names in batches:
            yield pd.Series(
                [
                    None if c is None else codecs.decode(bytes(c), _PYTHON.get(n, n), "replace")
                    for c, n in zip(contents, names)
                ],
                dtype=object,
            )

    return F.pandas_udf(run, "string")


def decoded(content: Column, encoding: Column) -> Column:
    """The text of the bytes, without a byte order mark. Bytes that are none in the encoding
    become U+FFFD. UTF-8 and windows-1252 are read in the JVM; only the others go through
    Python."""
    mark = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", 3).when(
        F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE"), 2
    )
    body = F.substring(content, F.coalesce(mark, F.lit(0)) + 1, F.length(content))
    native = encoding.isin("utf-8", "windows-1252")
    other = decoder()(F.when(~native, body), encoding)
    return (
        F.when(encoding == "utf-8", F.make_valid_utf8(body.cast("string")))
        .when(encoding == "windows-1252", F.translate(F.decode(body, "ISO-8859-1"), CONTROLS, LETTERS))
        .otherwise(other)
    )
