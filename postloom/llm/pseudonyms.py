"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

One pattern finds e-mail addresses, access keys, dates, IPv4 addresses, phone numbers, social
security numbers and payment cards. What passes its kind's validation is permuted within the
values of that kind by a keyed Feistel network, so a value has the same pseudonym in every
document, two values never share one, and the pseudonym is valid again. What fails validation
stays as it is.

The network has two halves, numbers below A and B. Each round adds to one half, modulo its size,
a keyed hash of the other, which can be undone; so it permutes all A * B values whatever the sizes.
Strings of letters and digits are two halves of characters, each shifted within its own class.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: What each kind looks like. Repetitions are possessive or short, so a match takes
#: neither deep recursion nor more than linear time.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DATE = r"(?<![0-9A-Za-z./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
)
KINDS = [EMAIL, KEY, ISO_DATE, DAY_DATE, IPV4, PHONE, SSN, CARD]
PATTERN = "|".join(KINDS)
#: Every kind has one of these.
HINT = "[0-9@]|AKIA"
#: Dates of one full Gregorian cycle: 146,097 days, which is 189 * 773.
FIRST_DAY = "1700-01-01"
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def keyed_hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest, as a non-negative long."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)
    digest = F.sha2(F.concat(F.lit(key), digest), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(kind: str, key: str, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Struct (a, b) permuted within size_a * size_b values."""

    def turn(state, number):
        one = F.pmod(state["a"] + keyed_hash(key, F.lit(kind), number, state["b"]), size_a)
        return F.struct(
            one.alias("a"),
            F.pmod(
                state["b"] + keyed_hash(key, F.lit(kind + "'"), number, one), size_b
            ).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _number(text: Column, at: int | Column, size: int | Column) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.substr(text, as_column(at), as_column(size)).cast("long")


def _padded(number: Column, size: int | Column) -> Column:
    """Digits of a number, zeros in front; of a number of no digits, nothing."""
    return F.call_function(
        "lpad", number.cast("string"), size if isinstance(size, Column) else F.lit(size), F.lit("0")
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, one by one, by the given ones."""

    def put(state, c):
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(
                state["s"], F.when(is_digit, F.substr(digits, state["i"], F.lit(1))).otherwise(c)
            ).alias("s"),
            (state["i"] + is_digit.cast("int")).alias("i"),
        )

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    return F.aggregate(F.split(text, ""), start, put)["s"]


def _shifted(text: Column, seed: Callable[[Column], Column]) -> Column:
    """Each letter and digit moved on within its class by its own hash."""

    def move(c: Column, i: Column) -> Column:
        out = c
        for letters in CLASSES:
            at = F.instr(F.lit(letters), c)
            moved = F.pmod(at - 1 + seed(i), F.lit(len(letters))).cast("int") + 1
            out = F.when(at > 0, F.substr(F.lit(letters), moved, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), move), "")).otherwise("")


def permute_text(kind: str, key: str, text: Column) -> Column:
    """Letters and digits of a short text permuted within their classes, all else in place."""

    def turn(state, number):
        one = lambda s: _shifted(
            s["a"], lambda i: keyed_hash(key, F.lit(kind), number, i, s["b"])
        )
        two = lambda s, a: _shifted(
            s["b"], lambda i: keyed_hash(key, F.lit(kind + "'"), number, i, a)
        )
        return _bind(
            one(state), lambda a: F.struct(a.alias("a"), two(state, a).alias("b"))
        )

    half = (F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1).alias("b")
    )
    return _bind(
        F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn),
        lambda s: F.concat(s["a"], s["b"]),
    )


def luhn_sum(digits: Column) -> Column:
    """The check sum of a card number whose last digit is its check digit."""
    size = F.length(digits)

    def worth(c, i):
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((size - i) % 2 == 0, twice).otherwise(d)

    worths = F.transform(F.split(digits, ""), worth)
    return F.aggregate(worths, F.lit(0), lambda n, w: n + w)


def card(found: Column, key: str) -> Column:
    """Keeps the first digit and the length; the last digit is made to check."""

    def permuted(digits):
        body = F.length(digits) - 2
        left = (body / 2).cast("int")
        size = lambda n: F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")
        state = feistel(
            "card", key,
            _number(digits, 2, left), _number(digits, left + 2, body - left),
            size(left), size(body - left),
        )
        return _bind(
            state,
            lambda s: F.concat(
                F.substr(digits, F.lit(1), F.lit(1)), _padded(s["a"], left), _padded(s["b"], body - left)
            ),
        )

    def checked(most):
        missing = F.pmod(-luhn_sum(F.concat(most, F.lit("0"))), F.lit(10))
        return F.concat(most, missing.cast("string"))

    return _bind(
        _digits(found),
        lambda d: F.when(
            luhn_sum(d) % 10 == 0, _refill(found, _bind(permuted(d), checked))
        ).otherwise(found),
    )


#: Least area and exchange, and how many areas and exchanges: numbers that can be dialled, and the
#: two parts of all others. Each part is permuted within itself.
DIALLED = ("phone", 200, 200, 800, 800)
NOT_DIALLED = (("phone-area", 0, 0, 200, 1000), ("phone-exchange", 200, 0, 800, 200))


def phone(found: Column, key: str, every: bool = False) -> Column:
    """North American numbers: area and exchange from 200 to 999; a country code stays. With
    `every`, the other numbers of this shape too, among themselves."""

    def permuted(d):
        lead = F.length(d) - 10
        area, exchange, line = (_number(d, lead + at, n) for at, n in ((1, 3), (4, 3), (7, 4)))

        def within(kind, least_area, least_exchange, areas, exchanges):
            state = feistel(
                kind, key, area - least_area, (exchange - least_exchange) * 10_000 + line,
                F.lit(areas), F.lit(exchanges * 10_000),
            )
            new = _bind(
                state,
                lambda s: F.concat(
                    F.substr(d, F.lit(1), lead),
                    _padded(s["a"] + least_area, 3),
                    _padded(F.floor(s["b"] / 10_000) + least_exchange, 3),
                    _padded(s["b"] % 10_000, 4),
                ),
            )
            return _refill(found, new)

        out = F.when((area >= 200) & (exchange >= 200), within(*DIALLED))
        if every:
            low_area, low_exchange = NOT_DIALLED
            out = out.when(area < 200, within(*low_area))
            out = out.when(exchange < 200, within(*low_exchange))
        return out.otherwise(found)

    return _bind(_digits(found), permuted)


def ssn(found: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    def permuted(d):
        area, group, serial = (_number(d, at, n) for at, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        state = feistel(
            "ssn", key,
            area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1,
            F.lit(898), F.lit(99 * 9999),
        )
        new = _bind(
            state,
            lambda s: F.concat(
                _padded(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3),
                _padded(F.floor(s["b"] / 9999) + 1, 2),
                _padded(s["b"] % 9999 + 1, 4),
            ),
        )
        return F.when(valid, _refill(found, new)).otherwise(found)

    return _bind(_digits(found), permuted)


def ipv4(found: Column, key: str) -> Column:
    """Four numbers up to 255, without zeros in front."""

    def permuted(parts):
        plain = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p == p.cast("int").cast("string")))
        number = lambda i: parts[i].cast("long")
        state = feistel(
            "ipv4", key, number(0) * 256 + number(1), number(2) * 256 + number(3),
            F.lit(65536), F.lit(65536),
        )
        new = _bind(
            state,
            lambda s: F.array_join(
                F.flatten(
                    F.transform(
                        F.array(s["a"], s["b"]),
                        lambda v: F.array(F.floor(v / 256).cast("string"), (v % 256).cast("string")),
                    )
                ),
                ".",
            ),
        )
        return F.when(plain, new).otherwise(found)

    return _bind(F.split(found, r"\."), permuted)


def _date(found: Column, key: str, year: Column, month: Column, day: Column, write) -> Column:
    """Days of the calendar from 1700 to 2099; all three kinds of dates share one permutation."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = (
        F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
    )
    valid = year.between(1700, 2099) & month.between(1, 12) & day.between(1, last)
    first = F.lit(FIRST_DAY).cast("date")
    whole = F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    new = _bind(
        _bind(
            F.datediff(whole, first),
            lambda n: feistel(
                "date", key, F.floor(n / 773), n % 773, F.lit(189), F.lit(773)
            ),
        ),
        lambda s: F.date_format(F.date_add(first, (s["a"] * 773 + s["b"]).cast("int")), write),
    )
    return F.when(valid, new).otherwise(found)


def iso_date(found: Column, key: str) -> Column:
    year, month, day = (_number(found, at, n) for at, n in ((1, 4), (6, 2), (9, 2)))
    return _date(found, key, year, month, day, "yyyy-MM-dd")


def day_date(found: Column, key: str) -> Column:
    """Day, month, year, with dots or slashes. A month written first is only seen as a date where
    it also reads as a day."""
    day, month, year = (_number(found, at, n) for at, n in ((1, 2), (4, 2), (7, 4)))
    mark = F.substr(found, F.lit(3), F.lit(1))
    return F.when(
        mark == ".", _date(found, key, year, month, day, "dd.MM.yyyy")
    ).otherwise(_date(found, key, year, month, day, "dd/MM/yyyy"))


def email(found: Column, key: str) -> Column:
    """The part before the @; the domain stays."""
    at = F.instr(found, "@")
    return F.concat(permute_text("email", key, F.substr(found, F.lit(1), at - 1)), F.substr(found, at))


def access_key(found: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permute_text("key", key, F.substr(found, F.lit(5))))


def pseudonym(found: Column, key: str, every_phone: bool = False) -> Column:
    """The pseudonym of one match, or the match where it is not valid."""
    whole = lambda pattern: found.rlike("^(?:" + pattern + ")$")
    return (
        F.when(F.instr(found, "@") > 0, email(found, key))
        .when(found.startswith("AKIA"), access_key(found, key))
        .when(whole("[0-9]{4}-[0-9]{2}-[0-9]{2}"), iso_date(found, key))
        .when(whole("[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), day_date(found, key))
        .when(whole("[0-9]{1,3}(?:[.][0-9]{1,3}){3}"), ipv4(found, key))
        .when(whole("[0-9]{3}-[0-9]{2}-[0-9]{4}"), ssn(found, key))
        .when(whole(PHONE), phone(found, key, every_phone))
        .otherwise(card(found, key))
    )


def pseudonymise(
    docs: DataFrame,
    key: str,
    text: str = "text",
    changed: str | None = None,
    every_phone: bool = False,
    length: str | None = None,
) -> DataFrame:
    """`docs` with pseudonyms in `text`; with `changed`, a column of how many values were replaced
    (null for a null text), in place of any column of that name. `every_phone` also replaces numbers
    shaped like a phone whose area or exchange is below 200, which else count as not valid. IPv4
    addresses may grow or shrink by a few digits; a column named by `length` follows. Null and
    empty texts stay as they are, and so do all other columns. Rows are independent, so repeated
    rows stay equal."""
    columns = docs.columns
    hinted = F.col(f"`{text}`").rlike(HINT)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    none = F.lit(None).cast("array<string>")
    found = docs.select(
        row,
        F.when(hinted, F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), F.lit(0)))
        .otherwise(none)
        .alias("_found"),
    )
    hit = F.size("_found") > 0
    old = F.col("_row")[text]
    renamed = found.select(
        "_row",
        "_found",
        F.when(hit, F.transform("_found", lambda m: pseudonym(m, key, every_phone)))
        .otherwise(none)
        .alias("_new"),
    )
    between = F.split(old, PATTERN, -1)
    pieces = F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    new = F.when(hit, F.array_join(pieces, "")).otherwise(old)
    grown = F.aggregate(
        F.zip_with("_found", "_new", lambda a, b: F.length(b) - F.length(a)),
        F.lit(0),
        lambda n, d: n + d,
    )
    made = {text: new}
    if length:
        size = F.col("_row")[length]
        kind = docs.schema[length].dataType
        made[length] = F.when(hit, (size + grown).cast(kind)).otherwise(size)
    out = [made.get(c, F.col("_row")[c]).alias(c) for c in columns if c != changed]
    if changed:
        differs = F.zip_with("_found", "_new", lambda a, b: (a != b).cast("int"))
        n = F.when(hit, F.aggregate(differs, F.lit(0), lambda n, d: n + d)).otherwise(F.lit(0))
        out.append(F.when(old.isNotNull(), n).alias(changed))
    return renamed.select(*out)
