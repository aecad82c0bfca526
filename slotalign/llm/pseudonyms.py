r"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values are permuted with a key inside their own format, so a value has the same pseudonym in every
document and no table of replacements is kept:

* ``card``: 13 to 19 digits with a valid check digit; the digits before it are permuted, it is computed anew.
* ``phone``: international or North American spellings; the digits after the country code are permuted.
* ``ssn``: US social security numbers that can have been issued; the nine digits are permuted.
* ``ipv4``: dotted quads with parts up to 255; the 32 bits are permuted.
* ``date``: calendar dates of 1900 to 2099 as ``y-m-d``, ``d.m.y``, ``d/m/y`` or ``m/d/y``; the day is permuted, so
  equal days stay equal across spellings.
* ``email``: has no numeric format; both sides of the sign become keyed digests. A domain has up to 127 labels of up to 63
  characters, as names may have; of longer runs of labels the first ones count.

Numbers go through a Feistel network over their two halves of digits (or bits), whose round function is a
keyed SHA-256. Days use one over 271 x 270 and walk along its cycle until they are back in range: only 121 of its
values are outside, so 122 steps always suffice.

Defined results: NULL and empty texts stay as they are. Candidates that fail validation stay as they are. Leftmost
matches win, in the order of ``PATTERN``. Repeated rows and equal values get equal results. Other columns
pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?!-?\d)|(?<![\d./])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)|(?<![\d./])\d{1,2}/\d{1,2}/\d{4}(?!/?\d)"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
PHONE = (r"(?<![\d+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
         r"|(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
         r"|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?!-?\d)")
CARD = r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{13,19})(?!\d)"
PATTERN = "|".join((EMAIL, DATE, IPV4, SSN, PHONE, CARD))
KINDS = ("email", "date", "ipv4", "ssn", "phone", "card")

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049
DAY_LEFT, DAY_RIGHT = 271, 270


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once; plain nesting would evaluate it at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def keyed_number(key: str, *parts: Column) -> Column:
    """60 keyed bits as BIGINT."""
    return F.conv(F.substring(keyed(key, *parts), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation of the pairs below ``left_size`` and ``right_size``."""

    def step(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return let(keyed_number(key, *tweak, i, F.when(odd, state["r"]).otherwise(state["l"])), lambda moved: F.struct(
            F.when(odd, F.pmod(state["l"] + moved, left_size)).otherwise(state["l"]).cast("long").alias("l"),
            F.when(odd, state["r"]).otherwise(F.pmod(state["r"] + moved, right_size)).cast("long").alias("r")))

    start = F.struct(F.coalesce(left.try_cast("long"), F.lit(0)).alias("l"), F.coalesce(right.try_cast("long"), F.lit(0)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def power_of_ten(digits: Column) -> Column:
    return F.rpad(F.lit("1"), digits + 1, "0").try_cast("long")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digit strings of up to 36 digits, permuted within their length."""
    size = F.char_length(digits)
    half = F.floor(size / 2).cast("int")
    other = size - half
    mixed = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, other), power_of_ten(half),
                    power_of_ten(other), key, F.lit(kind), size)
    return let(mixed, lambda pair: F.concat(F.lpad(pair["l"].cast("string"), half, "0"), F.lpad(pair["r"].cast("string"), other, "0")))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def fill(given: Column) -> Column:
        def step(state: Column, letter: Column) -> Column:
            digit = letter.between("0", "9")
            return F.struct(
                F.concat(state["out"], F.when(digit, F.substring(given, state["used"] + 1, F.lit(1))).otherwise(letter)).alias("out"),
                F.when(digit, state["used"] + 1).otherwise(state["used"]).alias("used"))

        return F.aggregate(F.split(value, ""), start, step)["out"]

    return let(digits, fill)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The weighted digit sum; places counted from the right, from 0, of the given parity are doubled."""
    size = F.char_length(digits)
    places = F.sequence(F.lit(0), size - 1)

    def step(total: Column, place: Column) -> Column:
        digit = F.substring(digits, size - place, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(place % 2 == doubled_from_right, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(places, F.lit(0), step)


def card(value: Column, key: str) -> Column:
    def valid_card(digits: Column) -> Column:
        valid = F.char_length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0)
        body = permuted_digits(F.substring(digits, F.lit(1), F.char_length(digits) - 1), key, "card")
        checked = let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))
        return F.when(valid, refill(value, checked))

    return let(digits_of(value), valid_card)


def phone(value: Column, key: str) -> Column:
    code = F.regexp_extract(value, r"^\+(?:1|\d{1,3}(?=[ .(-])|\d{2})", 0)

    def valid_phone(code: Column) -> Column:
        rest = F.substring(value, F.char_length(code) + 1, F.char_length(value))
        new = let(rest, lambda r: refill(r, let(digits_of(r), lambda d: permuted_digits(d, key, "phone"))))
        return F.when(F.char_length(digits_of(rest)).between(7, 14), F.concat(code, new))

    return let(code, valid_phone)


def ssn(value: Column, key: str) -> Column:
    valid = ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, refill(value, let(digits_of(value), lambda d: permuted_digits(d, key, "ssn"))))


def ipv4(value: Column, key: str) -> Column:
    part = [F.substring_index(F.substring_index(value, ".", i + 1), ".", -1).try_cast("long") for i in range(4)]
    size = F.lit(65_536)
    mixed = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], size, size, key, F.lit("ipv4"))

    def quad(pair: Column) -> Column:
        octets = [F.floor(pair["l"] / 256), pair["l"] % 256, F.floor(pair["r"] / 256), pair["r"] % 256]
        return F.concat_ws(".", *[o.cast("string") for o in octets])

    return F.when(F.greatest(*part) <= 255, let(mixed, quad))


def date(value: Column, key: str) -> Column:
    ways = [("yyyy-MM-dd", "yyyy-MM-dd", r"^\d{4}-"), ("d.M.yyyy", "dd.MM.yyyy", r"^\d+\."), ("M/d/yyyy", "MM/dd/yyyy", r"^\d+/"),
            ("d/M/yyyy", "dd/MM/yyyy", r"^\d+/")]

    def step(state: Column, _: Column) -> Column:
        mixed = feistel(F.floor(state["day"] / DAY_RIGHT), state["day"] % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT), key, F.lit("date"))

        def moved(pair: Column) -> Column:
            day = pair["l"] * DAY_RIGHT + pair["r"]
            return F.struct(day.alias("day"), (day >= DAYS).alias("walking"))

        return F.when(state["walking"], let(mixed, moved)).otherwise(state)

    def shifted(day: Column) -> Column:
        start = F.struct(day.cast("long").alias("day"), F.lit(True).alias("walking"))
        walked = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_LEFT * DAY_RIGHT - DAYS)), start, step)["day"].cast("int")
        return F.date_add(F.lit(FIRST_DAY).cast("date"), walked)

    def spelled(plain: str, padded: str) -> Callable[[Column], Column]:
        short = value.rlike(r"^\d[./]|[./]\d[./]")
        return lambda new: F.when(short, F.date_format(new, plain)).otherwise(F.date_format(new, padded))

    result = F.lit(None).cast("string")
    for plain, padded, shape in reversed(ways):
        day = F.datediff(F.try_to_date(value, plain), F.lit(FIRST_DAY).cast("date"))
        result = F.when(value.rlike(shape) & day.between(0, DAYS - 1), let(shifted(day), spelled(plain, padded))).otherwise(result)
    return result


def email(value: Column, key: str) -> Column:
    low = F.lower(value)
    local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    return F.concat(F.lit("u"), F.substring(keyed(key, F.lit("local"), local, domain), 1, 12), F.lit("@d"),
                    F.substring(keyed(key, F.lit("domain"), domain), 1, 8), F.lit(".example"))


MAKERS = {"email": email, "date": date, "ipv4": ipv4, "ssn": ssn, "phone": phone, "card": card}
# Which spelling a match of PATTERN has; tried in this order.
SHAPES = {"email": "@", "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})$",
          "ipv4": r"^\d{1,3}(?:\.\d{1,3}){3}$", "ssn": r"^\d{3}-\d{2}-\d{4}$",
          "card": r"^(?:\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{13,19})$", "phone": ""}


def pseudonym(value: Column, key: str) -> Column:
    """``kind, value, pseudonym`` of a match; kind and pseudonym are NULL if it is not valid."""
    kind = F.lit("phone")
    for name, shape in reversed([x for x in SHAPES.items() if x[1]]):
        kind = F.when(value.rlike(shape), F.lit(name)).otherwise(kind)

    def of_kind(kind: Column) -> Column:
        made = F.lit(None).cast("string")
        for name, maker in MAKERS.items():
            made = F.when(kind == name, maker(value, key)).otherwise(made)
        return let(made, lambda new: F.struct(F.when(new.isNotNull(), kind).alias("kind"), value.alias("value"), new.alias("pseudonym")))

    return let(kind, of_kind)


def pseudonymise(frame: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """``frame`` with pseudonyms in ``text`` and ``found``, the valid values as ``kind, value, pseudonym``."""
    # Every alternative of the pattern needs a digit or the sign; other texts are not searched further.
    searched = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    matches = frame.withColumn("_matches", searched)
    cut = matches.withColumns({
        "_made": F.when(F.size("_matches") > 0, F.transform("_matches", lambda value: pseudonym(value, key))),
        "_pieces": F.when(F.size("_matches") > 0, F.split(text, PATTERN, -1))})
    # The written values are needed twice, so they are computed in a step of their own.
    new = F.transform("_made", lambda m: F.coalesce(m["pseudonym"], m["value"]))
    woven = F.zip_with("_pieces", F.concat(new, F.array(F.lit(""))), lambda piece, value: F.concat(piece, value))
    valid = F.coalesce(F.filter("_made", lambda m: m["kind"].isNotNull()),
                       F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))
    result = cut.withColumns({text: F.when(F.size("_matches") > 0, F.array_join(woven, "")).otherwise(F.col(text)), found: valid})
    return result.drop("_matches", "_made", "_pieces")
