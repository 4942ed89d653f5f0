"""Profiles of the markup and audits of raw tags.

Audits see the tags of points and paths with raw keys, before any key is dropped or split.
Sets are returned as distinct rows, never as one collected value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.functions import clean
from mapengine.model import AUDITED_POSTCODE_PREFIX, EXPECTED_STREET_TYPES, KEY_CLASSES


def count_tags(elements: DataFrame) -> DataFrame:
    """Number of elements per name, at all depths."""
    return elements.groupBy("name").agg(F.count("*").alias("n"))


def key_classes(keys: DataFrame, key: str = "k") -> DataFrame:
    """Number of tag keys per class; all four classes, 0 where none is found."""
    cls = clean.key_type(F.col(key))
    counts = keys.agg(*[F.count_if(cls == c).alias(c) for c in KEY_CLASSES])
    pairs = [F.struct(F.lit(c).alias("key_class"), F.col(c).alias("n")) for c in KEY_CLASSES]
    return counts.select(F.inline(F.array(*pairs)))


def distinct_users(elements: DataFrame, uid: str = "uid") -> DataFrame:
    """Every contributor id that occurs on an element."""
    return elements.select(uid).distinct().where(F.col(uid).isNotNull())


def count_users(elements: DataFrame, uid: str = "uid") -> DataFrame:
    return distinct_users(elements, uid).agg(F.count("*").alias("n"))


def audit_street_types(
    tags: DataFrame, expected: Sequence[str] = EXPECTED_STREET_TYPES
) -> DataFrame:
    """Unexpected street types with the names that end in them."""
    # Names are made distinct first: the pattern then runs once per name, not per tag, and no
    # filter on its result is moved below.
    names = tags.where(clean.is_street_name(F.col("k"))).select(F.col("v").alias("street_name")).distinct()
    kind = clean.unexpected_street_type(F.col("street_name"), expected)
    return names.select(F.inline(F.array(F.struct(kind.alias("street_type"), "street_name")))).where(
        F.col("street_type").isNotNull()
    )


def audit_zipcodes(tags: DataFrame, prefix: str = AUDITED_POSTCODE_PREFIX) -> DataFrame:
    """Distinct post codes that start with ``prefix``."""
    wanted = clean.is_audited_postcode(F.col("k"), F.col("v"), prefix)
    return tags.where(wanted).select(F.col("v").alias("postcode")).distinct()


def audit_phone(tags: DataFrame) -> DataFrame:
    """Distinct local phone values, raw and reformatted.

    A value with fewer than two digits has no reformatted form (NULL).
    """
    return (
        tags.where(clean.is_local_phone(F.col("k"), F.col("v")))
        .select(F.col("v").alias("phone")).distinct()
        .select("phone", clean.phone_format(F.col("phone")).alias("formatted"))
    )


# --- all at once --------------------------------------------------------------------

def _facts(rows: DataFrame, served: dict[str, Column]) -> DataFrame:
    """``profile, value`` for every profile that a row serves with a value."""
    facts = [F.when(value.isNotNull(), F.struct(F.lit(name).alias("profile"), value.alias("value"))) for name, value in served.items()]
    return rows.select(F.inline(F.array_compact(F.array(*facts))))


def facts(elements: DataFrame, tags: DataFrame) -> DataFrame:
    """``profile, value, n``: everything the six profiles need, in one aggregation over one scan of either table.

    Counted are values, map-side first; street types and phone forms are worked out later, once a value.
    """
    k, v = F.col("k"), F.col("v")
    return _facts(elements, {
        "count_tags": F.col("name"), "distinct_users": F.col("uid"),
        "key_classes": F.when(F.col("name") == "tag", clean.key_type(k)),
    }).unionByName(_facts(tags, {
        "audit_street_types": F.when(clean.is_street_name(k), v),
        "audit_zipcodes": F.when(clean.is_audited_postcode(k, v), v),
        "audit_phone": F.when(clean.is_local_phone(k, v), v),
    })).groupBy("profile", "value").agg(F.count("*").alias("n"))


def profiles(found: DataFrame) -> dict[str, DataFrame]:
    """The six profiles by name from stored ``facts``; equal to the functions above."""
    own = {
        name: found.where(F.col("profile") == name).select("value", "n")
        for name in ("count_tags", "key_classes", "distinct_users", "audit_street_types", "audit_zipcodes", "audit_phone")
    }
    classes = found.sparkSession.createDataFrame([(c,) for c in KEY_CLASSES], "key_class STRING")
    counted = own["key_classes"].withColumnRenamed("value", "key_class")
    tag_of = {"k": F.lit("addr:street"), "v": F.col("value")}
    return {
        "count_tags": own["count_tags"].withColumnRenamed("value", "name"),
        "key_classes": classes.join(counted, "key_class", "left").select("key_class", F.coalesce("n", F.lit(0)).alias("n")),
        "distinct_users": own["distinct_users"].select(F.col("value").alias("uid")),
        "audit_street_types": audit_street_types(own["audit_street_types"].select(*[c.alias(n) for n, c in tag_of.items()])),
        "audit_zipcodes": own["audit_zipcodes"].select(F.col("value").alias("postcode")),
        "audit_phone": own["audit_phone"].select(F.col("value").alias("phone"), clean.phone_format(F.col("value")).alias("formatted")),
    }
