"""Shaping: elements and their children into the five flat tables (raw, text columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapengine.functions import clean
from mapengine.model import (
    NODE_FIELDS,
    NODE_TAG_FIELDS,
    PROBLEM_CHARS,
    REGULAR,
    SHAPED,
    WAY_FIELDS,
    WAY_NODE_FIELDS,
)


def shape_nodes(elements: DataFrame, fields: Sequence[str] = NODE_FIELDS) -> DataFrame:
    """Fixed fields of every point; a missing attribute is NULL, for validation to report."""
    return elements.where(F.col("kind") == "node").select(*fields)


def shape_ways(elements: DataFrame, fields: Sequence[str] = WAY_FIELDS) -> DataFrame:
    return elements.where(F.col("kind") == "way").select(*fields)


def raw_tags(children: DataFrame) -> DataFrame:
    """Tags of points and paths before any cleaning: ``elem, id, k, v``."""
    return children.where(
        (F.col("name") == "tag") & F.col("parent.name").isin(*SHAPED)
    ).select(F.col("parent.name").alias("elem"), F.col("parent.id").alias("id"), "k", "v")


def _shape_tags(
    tags: DataFrame, elem: str, value, problem_chars: str, default_type: str, *more: str
) -> DataFrame:
    key = F.col("k")
    return (
        tags.where((F.col("elem") == elem) & ~clean.has_problem_chars(key, problem_chars))
        .select(
            *more, "id",
            clean.split_key_name(key).alias("key"),
            value.alias("value"),
            clean.split_key_type(key, default_type).alias("type"),
        )
        .select(*more, *NODE_TAG_FIELDS)
    )


def shape_node_tags(
    tags: DataFrame, problem_chars: str = PROBLEM_CHARS, default_type: str = REGULAR
) -> DataFrame:
    """Tags of points: problem keys dropped, keys split, local phones reformatted."""
    value = clean.clean_tag_value(F.col("k"), F.col("v"))
    return _shape_tags(tags, "node", value, problem_chars, default_type)


def shape_way_tags(
    tags: DataFrame, problem_chars: str = PROBLEM_CHARS, default_type: str = REGULAR
) -> DataFrame:
    """Tags of paths: as for points, but values stay as they are."""
    return _shape_tags(tags, "way", F.col("v"), problem_chars, default_type)


def way_node_positions(children: DataFrame) -> DataFrame:
    """Refs of every path, numbered from 0 in document order; other children do not count."""
    return (
        children.where((F.col("name") == "nd") & (F.col("parent.name") == "way"))
        .select(F.col("parent.id").alias("id"), F.col("ref").alias("node_id"), "position")
        .select(*WAY_NODE_FIELDS)
    )


def routed(elements: DataFrame, children: DataFrame) -> DataFrame:
    """Rows of all five tables as one DataFrame, elements and children read once each.

    ``table_name``, ``element`` (the same for an element and all its children), the fields of all tables, NULL where
    a table lacks one, and the position of the row.
    """
    key, is_tag = F.col("k"), F.col("name") == "tag"
    owner, none = F.col("parent.name"), F.lit(None).cast("string")
    tops = elements.where(F.col("kind").isin(*SHAPED))
    own = children.where(
        (is_tag & owner.isin(*SHAPED) & ~clean.has_problem_chars(key, PROBLEM_CHARS)) | ((F.col("name") == "nd") & (owner == "way")))
    where = ("file", "block", "seq")
    top_fields = [
        F.when((F.col("kind") == "node") | F.lit(f in WAY_FIELDS), F.col(f)).alias(f) for f in NODE_FIELDS
    ]
    return tops.select(
        F.when(F.col("kind") == "node", "nodes").otherwise("ways").alias("table_name"), F.col("seq").alias("element"), *top_fields,
        *[none.alias(f) for f in ("key", "value", "type", "node_id", "position")], *where,
    ).unionByName(own.select(
        F.when(is_tag, F.when(owner == "node", "nodes_tags").otherwise("ways_tags")).otherwise("ways_nodes").alias("table_name"),
        F.col("parent.seq").alias("element"), F.col("parent.id").alias("id"), *[none.alias(f) for f in NODE_FIELDS[1:]],
        F.when(is_tag, clean.split_key_name(key)).alias("key"),
        F.when(is_tag, F.when(owner == "node", clean.clean_tag_value(key, F.col("v"))).otherwise(F.col("v"))).alias("value"),
        F.when(is_tag, clean.split_key_type(key, REGULAR)).alias("type"),
        F.when(~is_tag, F.col("ref")).alias("node_id"), F.when(~is_tag, F.col("position").cast("string")).alias("position"), *where,
    ))


def shape(elements: DataFrame, children: DataFrame) -> dict[str, DataFrame]:
    """All five raw tables by name."""
    tags = raw_tags(children)
    return {
        "nodes": shape_nodes(elements),
        "nodes_tags": shape_node_tags(tags),
        "ways": shape_ways(elements),
        "ways_nodes": way_node_positions(children),
        "ways_tags": shape_way_tags(tags),
    }
