"""Scalar cleaning rules as Column expressions; all of them stay in the JVM.

Patterns that use ``$`` carry ``(?d)``: with it ``$`` also matches before one final line
feed, and before no other line end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapengine.model import (
    AUDITED_POSTCODE_PREFIX,
    EXPECTED_STREET_TYPES,
    PHONE_STARTS,
    PROBLEM_CHARS,
    REGULAR,
)

# Fixed patterns.
# A key that starts like this is split at its first colon. Nothing anchors the end.
_SPLIT_KEY = r"^[a-z_]+:[a-z_]"
_LOWER = r"(?d)^[a-z_]*$"
_LOWER_COLON = r"(?d)^[a-z_]*:[a-z_]*$"
# From the first word character of the last blank-delimited piece to the end. Word characters
# are spelled out: what a word boundary is to non-ASCII letters differs between Java releases.
_STREET_TYPE = r"(?d)[A-Za-z0-9_]\S*$"


# --- predicates on a raw tag --------------------------------------------------------

def has_problem_chars(key: Column, pattern: str = PROBLEM_CHARS) -> Column:
    return key.rlike(pattern)


def is_street_name(key: Column) -> Column:
    return key == F.lit("addr:street")


def is_zipcode(key: Column) -> Column:
    """Case-sensitive."""
    return key.contains("zip")


def is_phone(key: Column) -> Column:
    """Case-sensitive; see ``is_any_phone``."""
    return key.contains("phone")


def is_any_phone(key: Column) -> Column:
    return F.lower(key).contains("phone")


def starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    """True where ``value`` starts with one of a small, fixed set of prefixes."""
    found = F.lit(False)
    for prefix in prefixes:
        found = found | value.startswith(prefix)
    return found


def is_audited_postcode(
    key: Column, value: Column, prefix: str = AUDITED_POSTCODE_PREFIX
) -> Column:
    return (key == F.lit("addr:postcode")) & value.startswith(prefix)


def is_local_phone(key: Column, value: Column) -> Column:
    """A phone tag, in any letter case, with a value that is to be reformatted."""
    return is_any_phone(key) & starts_with_any(value, PHONE_STARTS)


# --- keys ---------------------------------------------------------------------------

def splits(key: Column) -> Column:
    return key.rlike(_SPLIT_KEY)


def split_key_type(key: Column, default: str = REGULAR) -> Column:
    return F.when(splits(key), F.substring_index(key, ":", 1)).otherwise(F.lit(default))


def split_key_name(key: Column) -> Column:
    rest = F.substring(key, F.instr(key, ":") + 1, F.length(key))
    return F.when(splits(key), rest).otherwise(key)


def key_type(key: Column) -> Column:
    """Class of a key: the first of ``KEY_CLASSES`` that applies."""
    return (
        F.when(key.rlike(_LOWER), "lower")
        .when(key.rlike(_LOWER_COLON), "lower_colon")
        .when(key.rlike(PROBLEM_CHARS), "problemchars")
        .otherwise("other")
    )


# --- values -------------------------------------------------------------------------

def phone_format(phone: Column) -> Column:
    """Digits only, the last one set apart, the others grouped in threes from the right.

    ``(404) 555-1234`` gives ``404-555-1234``. Leading zeros go. Fewer than two digits give
    NULL. Text only, never a number: a value may exceed 64 bits.
    """
    digits = F.regexp_replace(phone, "[^0-9]+", "")
    head = F.regexp_replace(F.left(digits, F.length(digits) - 1), "^0+", "")
    head = F.when(head == "", "0").otherwise(head)
    grouped = F.reverse(F.rtrim(F.regexp_replace(F.reverse(head), "([0-9]{3})", "$1-"), F.lit("-")))
    return F.when(F.length(digits) > 1, F.concat(grouped, F.right(digits, F.lit(1))))


def clean_tag_value(key: Column, value: Column) -> Column:
    """Value of a point's tag: local phones reformatted, anything else as it is."""
    return F.when(
        is_local_phone(key, value), F.coalesce(phone_format(value), value)
    ).otherwise(value)


def street_type(name: Column) -> Column:
    """Last piece of a street name from its first word character; NULL if there is none."""
    found = F.regexp_extract(name, _STREET_TYPE, 0)
    return F.when(found != "", found)


def unexpected_street_type(
    name: Column, expected: Sequence[str] = EXPECTED_STREET_TYPES
) -> Column:
    """The street type if it is none of ``expected``, else NULL."""
    found = street_type(name)
    return F.when(~found.isin(*expected), found)


def update_name(name: Column, mapping: Mapping[str, str]) -> Column:
    """Replaces every occurrence of every key of ``mapping``, longest key first.

    Keys of one length go in alphabetical order. Substrings are replaced, not words, and a
    later key sees the result of an earlier one. ``mapping`` is small configuration.
    """
    for key in sorted(mapping, key=lambda k: (-len(k), k)):
        name = F.replace(name, F.lit(key), F.lit(mapping[key]))
    return name


def clean_phone(phone: Column, mapping: Mapping[str, str]) -> Column:
    """The replacement of ``update_name`` for phone values."""
    return update_name(phone, mapping)
