"""Questions asked of the five tables.

Counts are aggregated map-side before they are shuffled, so one hot value costs one row per
task. Every order ends with the value itself: results do not depend on how ties fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_tags(node_tags: DataFrame, way_tags: DataFrame) -> DataFrame:
    """All tags of points and paths, duplicates kept."""
    return node_tags.unionByName(way_tags)


def key_is(key: str) -> Column:
    return F.col("key") == F.lit(key)


def key_ends_with(suffix: str) -> Column:
    """Keys that end in ``suffix``, in any letter case (``city`` also finds ``capacity``)."""
    return F.lower("key").endswith(suffix.lower())


def _ranked(counts: DataFrame, column: str, limit: int | None) -> DataFrame:
    ordered = counts.orderBy(F.col("n").desc(), F.col(column).asc())
    return ordered if limit is None else ordered.limit(limit)


def value_counts(tags: DataFrame, keys: Column, limit: int | None = None) -> DataFrame:
    """How often each value occurs under the given keys, most frequent first."""
    counts = tags.where(keys).groupBy("value").agg(F.count("*").alias("n"))
    return _ranked(counts, "value", limit)


def distinct_tagged_ids(tags: DataFrame, value: str) -> DataFrame:
    """Ids that have ``value`` under any key."""
    return tags.where(F.col("value") == F.lit(value)).select("id").distinct()


def tags_of(tags: DataFrame, ids: DataFrame) -> DataFrame:
    """Tags whose id is among ``ids``; each tag once, so nothing is multiplied."""
    return tags.join(ids, "id", "left_semi")


def value_counts_for(
    tags: DataFrame, having_value: str, key: str, limit: int | None = None
) -> DataFrame:
    """Values of ``key`` on the ids that have ``having_value`` under any key.

    Each side is shuffled once by id, and the values once for the count, after being counted
    map-side. An id with very many tags stands on the left of a semi join, whose partitions
    adaptive execution splits; for that the ids come straight from their shuffle, and a semi
    join does not mind that some are repeated.
    """
    values = tags.where(key_is(key)).select("id", "value")
    kept = tags_of(values, tags.where(F.col("value") == F.lit(having_value)).select("id"))
    return _ranked(kept.groupBy("value").agg(F.count("*").alias("n")), "value", limit)


def top_postcodes(tags: DataFrame) -> DataFrame:
    return value_counts(tags, key_is("postcode"))


def top_phones(tags: DataFrame) -> DataFrame:
    return value_counts(tags, key_is("phone"))


def top_cities(tags: DataFrame) -> DataFrame:
    return value_counts(tags, key_ends_with("city"))


def count_rows(table: DataFrame) -> DataFrame:
    """Number of points, or of paths."""
    return table.agg(F.count("*").alias("n"))


def contributions(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """One row per point and path: the user who last touched it."""
    return nodes.select("user").unionByName(ways.select("user"))


def top_users(users: DataFrame, limit: int | None = 10) -> DataFrame:
    counts = users.groupBy("user").agg(F.count("*").alias("n"))
    return _ranked(counts, "user", limit)


def one_time_users(users: DataFrame) -> DataFrame:
    """Number of users with exactly one contribution."""
    counts = users.groupBy("user").agg(F.count("*").alias("n"))
    return counts.where("n = 1").agg(F.count("*").alias("n"))


def top_amenities(node_tags: DataFrame, limit: int | None = 10) -> DataFrame:
    return value_counts(node_tags, key_is("amenity"), limit)


def religions(node_tags: DataFrame) -> DataFrame:
    return value_counts_for(node_tags, "place_of_worship", "religion")


def cuisines(node_tags: DataFrame) -> DataFrame:
    return value_counts_for(node_tags, "restaurant", "cuisine")


# Questions about the values of one key on the ids that have a value under any key.
_HAVING = {"religions": ("place_of_worship", "religion"), "cuisines": ("restaurant", "cuisine")}


def facts(tables: dict[str, DataFrame]) -> DataFrame:
    """``question, value, id, having, n``: each row routed to the questions it serves, counted in one pass.

    Every table is read once. ``id`` is set only where a question depends on other tags of the same id: such rows
    carry a value, or, with ``having``, the id alone.
    """
    key, value, none = F.col("key"), F.col("value"), F.lit(None)

    def fact(when: Column | None, question: str, value: Column = none, id_: Column = none, having: bool = False) -> Column:
        row = F.struct(
            F.lit(question).alias("question"), value.cast("string").alias("value"), id_.cast("long").alias("id"), F.lit(having).alias("having"))
        return row if when is None else F.when(when, row)

    def routed(rows: DataFrame, *found: Column) -> DataFrame:
        return rows.select(F.inline(F.array_compact(F.array(*found))))

    both = [
        fact(key_is("postcode"), "top_postcodes", value), fact(key_is("phone"), "top_phones", value),
        fact(key_ends_with("city"), "top_cities", value),
    ]
    of_nodes = [fact(key_is("amenity"), "top_amenities", value)]
    for question, (had, asked) in _HAVING.items():
        of_nodes += [fact(key_is(asked), question, value, F.col("id")), fact(value == had, question, id_=F.col("id"), having=True)]
    user = fact(None, "top_users", F.col("user"))
    return (
        routed(tables["nodes_tags"], *both, *of_nodes)
        .unionByName(routed(tables["ways_tags"], *both))
        .unionByName(routed(tables["nodes"], user, fact(None, "count_nodes")))
        .unionByName(routed(tables["ways"], user, fact(None, "count_ways")))
        .groupBy("question", "value", "id", "having").agg(F.count("*").alias("n"))
    )


def answered(found: DataFrame) -> dict[str, DataFrame]:
    """The ten standard questions from stored ``facts``; equal to ``answers``."""

    def counts(question: str) -> DataFrame:
        return found.where((F.col("question") == question) & F.col("id").isNull()).select("value", "n")

    def total(question: str) -> DataFrame:
        return counts(question).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def having(question: str) -> DataFrame:
        own = found.where((F.col("question") == question) & F.col("id").isNotNull())
        ids = own.where("having").select("id")
        return _ranked(tags_of(own.where("not having"), ids).groupBy("value").agg(F.sum("n").alias("n")), "value", None)

    users = counts("top_users").withColumnRenamed("value", "user")
    return {
        **{q: _ranked(counts(q), "value", None) for q in ("top_postcodes", "top_phones", "top_cities")},
        "count_nodes": total("count_nodes"),
        "count_ways": total("count_ways"),
        "top_users": _ranked(users, "user", 10),
        "one_time_users": users.where("n = 1").agg(F.count("*").alias("n")),
        "top_amenities": _ranked(counts("top_amenities"), "value", 10),
        **{q: having(q) for q in _HAVING},
    }


def answers(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ten standard questions over the five tables."""
    tags = union_tags(tables["nodes_tags"], tables["ways_tags"])
    users = contributions(tables["nodes"], tables["ways"])
    return {
        "top_postcodes": top_postcodes(tags),
        "top_phones": top_phones(tags),
        "top_cities": top_cities(tags),
        "count_nodes": count_rows(tables["nodes"]),
        "count_ways": count_rows(tables["ways"]),
        "top_users": top_users(users),
        "one_time_users": one_time_users(users),
        "top_amenities": top_amenities(tables["nodes_tags"]),
        "religions": religions(tables["nodes_tags"]),
        "cuisines": cuisines(tables["nodes_tags"]),
    }
