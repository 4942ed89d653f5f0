"""Format-preserving pseudonyms for personal numbers, dates and addresses.

What a pattern finds is validated first: card numbers by their check digit, phone and social
security numbers by the ranges in use, IPv4 addresses by their octets, dates by the calendar.
A valid value is then permuted within the values of its own kind by a keyed Feistel network
over a mixed radix, and written back in the spelling it had. So a pseudonym is valid too, equal
values (also in different spellings) get equal pseudonyms in every document, different values
different ones, and whoever has the key can invert it. Mail addresses keep their domain; the
letters and digits of their local part are permuted in place.

Everything is one projection of Column expressions; nothing is shuffled. Patterns look at each
run of characters once, so very long texts take time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.llm.common import col, unused

ROUNDS = 8

# Fixed patterns, in the order in which they are tried at a place.
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
# Numbers that are spelled like a phone's, in any range.
_OTHER = r"(?<![0-9+])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)|\([0-9]{3}\) ?)[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
_ABROAD = r"(?<![0-9+])\+[2-9](?:[ .-]?\(?[0-9]\)?){7,13}(?![0-9])"
# Cards in usual groups, or unbroken.
_GROUPED = r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{5})"
_STRICT = rf"(?<![0-9])(?:{_GROUPED}|[0-9]{{13,19}})(?![0-9])"
# A blank or hyphen within a card, behind which no other number begins.
_GAP = rf"[ -](?!{'|'.join((_DATE, _SSN, _PHONE, _STRICT)).replace('(?<![0-9/.-])', '').replace('(?<![0-9-])', '')})"
_CARD = rf"(?<![0-9])(?:{_GROUPED}(?:{_GAP}[0-9]{{1,3}})?|[0-9](?:(?:{_GAP})?[0-9]){{12,18}})(?![0-9])"
PATTERN = "|".join((_MAIL, _DATE, _IP, _SSN, _CARD, _PHONE, _OTHER, _ABROAD))
# What is looked for, one after the other, inside a card that failed its check.
_WITHIN = ("|".join((_DATE, _SSN, _STRICT, _PHONE)), "|".join((_DATE, _SSN, _PHONE)))

# Days of 400 years of the calendar, 189 * 773, and their first day.
_FIRST_DAY, _DAY_RADIX = "1800-01-01", (189, 773)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _draw(key: str, *parts: Column) -> Column:
    """A pseudo-random number below 2**60 from a secret key and anything."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.left(hashed, F.lit(15)), 16, 10).cast("long")


def feistel(number: Column, left: Column | int, right: Column | int, key: str, tweak: str = "") -> Column:
    """Permutes the numbers below ``left * right``, which must be below 2**62."""
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))
    start = F.struct(((number - F.pmod(number, right)) / right).cast("long").alias("l"), F.pmod(number, right).alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        drawn = _draw(key, F.lit(tweak), i, F.when(even, x["r"]).otherwise(x["l"]))
        return F.struct(
            F.when(even, F.pmod(x["l"] + drawn, left)).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise(F.pmod(x["r"] + drawn, right)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: x["l"] * right + x["r"])


def feistel_text(text: Column, key: str) -> Column:
    """Permutes texts of one form: letters stay letters of their case, digits digits, and all
    else stays as it is. Halves take turns to shift the characters of the other."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            code = F.ascii(c)
            by = _draw(key, F.lit("text"), i, k, other)

            def within(first: str, n: int) -> Column:
                base = F.lit(ord(first))
                return F.char((F.pmod(code - base + F.pmod(by, F.lit(n)), F.lit(n)) + base).cast("long"))

            return (
                F.when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26))
                .when(c.between("0", "9"), within("0", 10)).otherwise(c)
            )

        return F.array_join(F.transform(F.regexp_extract_all(half, F.lit("(?s)."), F.lit(0)), one), "")

    cut = F.floor(F.char_length(text) / 2).cast("int")
    start = F.struct(F.left(text, cut).alias("l"), F.substr(text, cut + 1).alias("r"))

    def step(x: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, shifted(x["l"], x["r"], i)).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise(shifted(x["r"], x["l"], i)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda x: F.concat(x["l"], x["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _respelled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits``, one after the other."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(x: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(x["out"], F.when(digit, F.substr(digits, x["at"], F.lit(1))).otherwise(c)).alias("out"),
            (x["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(chars, start, step, lambda x: x["out"])


def _padded(number: Column, digits: Column | int) -> Column:
    return F.lpad(number.cast("string"), digits, F.lit("0") if isinstance(digits, Column) else "0")


def _power(n: Column) -> Column:
    """10 to the n, exactly, for n from 0 to 18."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _luhn(digits: Column) -> Column:
    """Check sum of digits, the last one being the check digit; 0 modulo 10 if valid."""
    backwards = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))

    def part(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when(F.pmod(i, F.lit(2)) == 0, c.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.pmod(F.aggregate(F.transform(backwards, part), F.lit(0), lambda a, b: a + b), F.lit(10))


def _card(value: Column, key: str) -> Column:
    """The first digit, which names the network, stays; the check digit is made anew."""

    def permuted(d: Column) -> Column:
        n = F.char_length(d) - 2
        small = F.floor(n / 2).cast("int")
        middle = F.substr(d, F.lit(2), n).cast("long")
        new = F.concat(F.left(d, F.lit(1)), _padded(feistel(middle, _power(small), _power(n - small), key, "card"), n))
        checked = _once(new, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn(d) == 0, _respelled(value, checked))

    return _once(_digits(value), permuted)


def _phone(value: Column, key: str) -> Column:
    """Area and exchange from 200 to 999, any line; all other numbers among themselves."""

    def permuted(d: Column) -> Column:
        local = F.right(d, F.lit(10))
        area, line = F.left(local, F.lit(3)).cast("long") - 200, F.right(local, F.lit(7)).cast("long") - 2_000_000
        new = feistel(area * 8_000_000 + line, 800, 8_000_000, key, "phone")
        spelled = _once(new, lambda x: F.concat(
            (F.floor(x / 8_000_000) + 200).cast("string"), (F.pmod(x, F.lit(8_000_000)) + 2_000_000).cast("string")))
        low = F.left(local, F.lit(3)).cast("long") < 200
        # The others: 200 areas of 10,000,000 lines, and 800 of 2,000,000; in all 60,000 * 60,000.
        at = F.when(low, local.cast("long")).otherwise(2_000_000_000 + area * 2_000_000 + line + 2_000_000)
        others = _once(feistel(at, 60_000, 60_000, key, "other"), lambda x: _padded(
            F.when(x < 2_000_000_000, x).otherwise(
                (F.floor((x - 2_000_000_000) / 2_000_000) + 200) * 10_000_000
                + F.pmod(x - 2_000_000_000, F.lit(2_000_000))), 10))
        return F.concat(F.left(d, F.char_length(d) - 10), F.when(low | (line < 0), others).otherwise(spelled))

    return _respelled(value, _once(_digits(value), permuted))


def _abroad(value: Column, key: str) -> Column:
    """The first two digits, which name the country, stay."""

    def permuted(d: Column) -> Column:
        n = F.char_length(d) - 2
        small = F.floor(n / 2).cast("int")
        rest = F.substr(d, F.lit(3)).cast("long")
        return F.concat(F.left(d, F.lit(2)), _padded(feistel(rest, _power(small), _power(n - small), key, "abroad"), n))

    return _respelled(value, _once(_digits(value), permuted))


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    at = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 989_901 + (group - 1) * 9_999 + serial - 1

    def spelled(x: Column) -> Column:
        a = F.floor(x / 989_901) + 1
        rest = F.pmod(x, F.lit(989_901))
        return F.concat_ws(
            "-", _padded(a + F.when(a >= 666, 1).otherwise(0), 3),
            _padded(F.floor(rest / 9_999) + 1, 2), _padded(F.pmod(rest, F.lit(9_999)) + 1, 4),
        )

    return F.when(valid, _once(feistel(at, 898, 989_901, key, "ssn"), spelled))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    valid = F.array_max(parts) < 256
    at = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    spelled = _once(feistel(at, 1 << 16, 1 << 16, key, "ip"), lambda x: F.concat_ws(
        ".", *[F.pmod(F.floor(x / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(valid, spelled)


def _date(value: Column, key: str) -> Column:
    """Days of the years 1800 to 2199, as year-month-day, month/day/year or day.month.year.

    With slashes, a first part beyond 12 is the day. Its pseudonym is written with the day first
    too, so if that day is at most 12 the spelling alone no longer shows the order.
    """
    iso = value.contains("-")
    us = value.contains("/") & (F.left(value, F.lit(2)) <= "12")
    european = F.when(value.contains("/"), "/").otherwise(".")

    def part(i: int, u: int, e: int, n: int) -> Column:
        return F.when(iso, F.substring(value, i, n)).when(us, F.substring(value, u, n)).otherwise(F.substring(value, e, n))

    day = F.concat_ws("-", part(1, 7, 7, 4), part(6, 1, 4, 2), part(9, 4, 1, 2)).try_cast("date")

    def spelled(x: Column) -> Column:
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), x.cast("int"))
        return (
            F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(us, F.date_format(new, "MM/dd/yyyy"))
            .otherwise(F.concat(
                F.date_format(new, "dd"), european, F.date_format(new, "MM"), european, F.date_format(new, "yyyy")))
        )

    at = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    valid = day.isNotNull() & (at >= 0) & (at < _DAY_RADIX[0] * _DAY_RADIX[1])
    return F.when(valid, _once(feistel(at, *_DAY_RADIX, key, "date"), spelled))


def _mail(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(feistel_text(F.left(value, at - 1), key), F.substr(value, at))


def pseudonym(value: Column, key: str) -> Column:
    """Struct ``kind, new`` of one found value; both NULL if it is not valid."""

    def whole(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    kinds = [
        ("mail", value.contains("@"), _mail), ("date", whole(_DATE), _date), ("ip", whole(_IP), _ip),
        ("ssn", whole(_SSN), _ssn), ("card", whole(_CARD), _card), ("phone", whole(_PHONE) | whole(_OTHER), _phone),
        ("abroad", whole(_ABROAD), _abroad),
    ]
    out = F.lit(None).cast("struct<kind:string,new:string>")
    for kind, found, permuted in reversed(kinds):
        out = F.when(found, F.struct(F.lit(kind).alias("kind"), permuted(value, key).alias("new"))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, ``n_private`` (values replaced) and ``private``,
    an array of ``kind, new`` in order of their places.

    ``key`` is the secret. Values that a pattern finds but that are not valid stay as they are,
    but inside a card that fails its check the other patterns, and shorter cards, are tried.
    NULL texts stay NULL with nothing found; so do empty ones. Rows are neither added nor lost,
    repeated rows get the same result, an empty table an empty one. Columns ``n_private`` and
    ``private`` of ``docs`` are replaced, all others stay.
    """
    parts, hits = unused(docs, "parts", "hits")
    kind = "struct<text:string,valid:array<struct<kind:string,new:string>>>"
    none = F.array().cast(f"array<{kind}>")

    def found(value: Column, within: tuple[str, ...] = _WITHIN) -> Column:
        """Struct ``text, valid``: what stands for a found value, and the valid ones in it."""

        def named(p: Column) -> Column:
            one = F.struct(p["new"].alias("text"), F.array(p).alias("valid"))
            out = F.struct(value.alias("text"), F.array().alias("valid")).cast(kind)
            if within:
                out = F.when(value.rlike(f"^(?:{_CARD})$"), again()).otherwise(out)
            return F.when(p["new"].isNotNull(), one.cast(kind)).otherwise(out)

        def again() -> Column:
            inner = F.transform(F.regexp_extract_all(value, F.lit(within[0]), F.lit(0)), lambda v: found(v, within[1:]))
            return _once(inner, lambda hits: F.struct(
                joined(F.split(value, within[0], -1), hits).alias("text"),
                F.flatten(F.transform(hits, lambda h: h["valid"])).alias("valid"),
            ).cast(kind))

        return _once(pseudonym(value, key), named)

    def joined(between: Column, hits: Column) -> Column:
        return F.array_join(F.zip_with(between, hits, lambda b, h: F.concat(
            F.coalesce(b, F.lit("")), F.coalesce(h["text"], F.lit("")))), "")

    # Without a digit or an at sign there is nothing to look for.
    possible = col(text).rlike("[0-9@]")
    values = F.regexp_extract_all(col(text), F.lit(PATTERN), F.lit(0))
    marked = docs.withColumn(hits, F.when(possible, F.transform(values, lambda v: found(v))).otherwise(none))
    valid = F.flatten(F.transform(col(hits), lambda h: h["valid"]))
    some = F.exists(col(hits), lambda h: F.size(h["valid"]) > 0)
    new_text = F.when(some, joined(F.split(col(text), PATTERN, -1), col(hits))).otherwise(col(text))
    others = [c for c in docs.columns if c.lower() not in ("n_private", "private")]
    return marked.select(
        *[(new_text if c == text else col(c)).alias(c) for c in others],
        F.size(valid).cast("long").alias("n_private"), valid.alias("private"),
    )
