"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import driver_tables as d
from mapengine import workspace
from mapengine.functions import clean
from mapengine.model import RECORDS
from mapengine.operators import analytics, order, profile, shape, validate
from mapengine.plans.wrangle import wrangle
from mapengine.sources import extract, markup, tables

Query = Callable[[SparkSession, str], DataFrame]

# Small configuration for the replacement rules; both have overlapping keys.
NAME_MAPPING = {"ring": "Ring", "in": "IN", "widget": "Widget", "red": "Red", "t": "T"}
PHONE_MAPPING = {"(404) ": "+1 404 ", "(678) ": "+1 678 ", "555-": "555 "}


def all_tags(spark: SparkSession, sf: str, by_key: bool = False) -> DataFrame:
    return analytics.union_tags(d.node_tags(spark, sf, by_key), d.way_tags(spark, sf, by_key))


# --- A: sources and sinks -----------------------------------------------------------

def scan_elements(spark: SparkSession, sf: str) -> DataFrame:
    rows = markup.elements(markup.events(spark, d.markup_path(spark, sf)))
    return rows.select(
        "name", "id", "lat", "lon", "user", "uid", "version", "changeset", "timestamp",
        "k", "v", "ref", "type", "role",
    )


def _top_level_with_counts(rows: DataFrame) -> DataFrame:
    kids = order.children(rows, fields=()).groupBy("parent.seq").agg(
        *[F.count_if(F.col("name") == c).alias(f"n_{c}") for c in ("tag", "nd", "member")])
    index = order.element_index(rows).select("seq", "element")
    return markup.top_level(rows).select("seq", "name", "id").join(index, "seq").join(kids, "seq", "left").select(
        "element", "name", "id", *[F.coalesce(f"n_{c}", F.lit(0)).alias(f"n_{c}") for c in ("tag", "nd", "member")])


def scan_top_level(spark: SparkSession, sf: str) -> DataFrame:
    """Top-level elements in document order with the number of children of each kind."""
    return _top_level_with_counts(d.staged(spark, sf))


def scan_commented(spark: SparkSession, sf: str) -> DataFrame:
    """The same of an extract with elements inside comments and CDATA, one comment reaching into a second file."""
    paths = d.write_commented(spark, sf, workspace.new_dir(spark, "commented"))
    return _top_level_with_counts(markup.stage_events(spark, paths, workspace.new_dir(spark, "outside")))


def _five(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "nodes": d.nodes(spark, sf),
        "nodes_tags": d.node_tags(spark, sf),
        "ways": d.ways(spark, sf),
        "ways_nodes": shape.way_node_positions(d.children(spark, sf)),
        "ways_tags": d.way_tags(spark, sf),
    }


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """All five tables through CSV; texts with line feeds and quotes, some of them missing."""
    source = _five(spark, sf)
    hard = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit('a\n"b", \r\n'), "value"))
    source["nodes_tags"] = d.spread_node_tags(spark, sf)
    for name in ("nodes_tags", "ways_tags"):
        source[name] = source[name].withColumn("value", hard)
    target = workspace.new_dir(spark, "csv")
    tables.write_csv(source, target, compression="gzip")
    back = tables.read_all_csv(spark, target, typed=True)
    shown = {
        "nodes": ("user", F.col("user"), F.col("timestamp")), "ways": ("user", F.col("user"), F.col("timestamp")),
        "ways_nodes": ("position", F.col("node_id").cast("string"), F.col("position").cast("string")),
    }
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit(name).alias("source"), "id", F.lit(shown[name][0]).alias("key"), shown[name][1].alias("value"), shown[name][2].alias("type"))
        if name in shown else rows.select(F.lit(name).alias("source"), "id", "key", "value", "type")
        for name, rows in back.items()
    ])


def csv_roundtrip_nodes(spark: SparkSession, sf: str) -> DataFrame:
    target = workspace.new_dir(spark, "csv")
    tables.write_csv({"nodes": d.nodes(spark, sf)}, target)
    return tables.read_csv(spark, target, "nodes", typed=True)


def load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Loads all five tables twice, so the second load replaces the first, and counts them."""
    source = _five(spark, sf)
    spark.sql("CREATE DATABASE IF NOT EXISTS loaded_extract")
    location = workspace.new_dir(spark, "tables")
    for _ in range(2):
        loaded = tables.load_tables(spark, source, location, "loaded_extract")
    counts = [
        rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"),
                 F.sum(F.col("id").cast("long")).alias("id_sum"))
        for name, rows in loaded.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def sampled_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Writes a sample, scans it back and shows its elements with their children."""
    target = workspace.new_dir(spark, "sample")
    extract.write_sample(d.staged_markup(spark, sf), target)
    kids = order.children(markup.events(spark, target))
    return kids.select(
        F.col("parent.name").alias("parent_name"), F.col("parent.id").cast("long").alias("parent_id"),
        "name", "k", "v", "ref", "position",
    )


# --- B: shaping ---------------------------------------------------------------------

def shape_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return validate.typed(shape.shape_nodes(markup.elements(d.staged(spark, sf))), "nodes")


def shape_ways(spark: SparkSession, sf: str) -> DataFrame:
    return validate.typed(shape.shape_ways(markup.elements(d.staged(spark, sf))), "ways")


def markup_node_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = shape.raw_tags(d.children(spark, sf))
    return validate.typed(shape.shape_node_tags(tags), "nodes_tags")


def markup_way_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = shape.raw_tags(d.children(spark, sf))
    return validate.typed(shape.shape_way_tags(tags), "ways_tags")


def split_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return d.raw_keys(spark, sf).select(
        "k", clean.split_key_type(k).alias("type"), clean.split_key_name(k).alias("key")
    ).distinct()


def way_node_positions(spark: SparkSession, sf: str) -> DataFrame:
    return validate.typed(shape.way_node_positions(d.children(spark, sf)), "ways_nodes")


def tag_predicates(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("k"), F.col("v")
    return d.raw_tags(spark, sf).groupBy("elem", "k").agg(
        F.count_if(clean.is_street_name(k)).alias("street"),
        F.count_if(clean.is_zipcode(k)).alias("zip"),
        F.count_if(clean.is_phone(k)).alias("phone"),
        F.count_if(clean.is_local_phone(k, v)).alias("local_phone"),
        F.count_if(clean.is_audited_postcode(k, v)).alias("audited_postcode"),
        F.count_if(clean.has_problem_chars(k)).alias("problem"),
    )


# --- C: validation ------------------------------------------------------------------

def validate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate(d.dirty_nodes(spark, sf), "nodes")


def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    return validate.quarantine(d.dirty_nodes(spark, sf), "nodes").select(
        "id", "user", F.array_join("errors", ",").alias("errors")
    )


def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.error_counts(d.dirty_nodes(spark, sf), "nodes")


def validated_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Kept and rejected rows of all five tables, and kept children without their element."""
    return _counted_elements(spark, sf, "quarantine").select("table_name", "kept", "rejected", "orphans")


def element_report(spark: SparkSession, sf: str) -> DataFrame:
    """All that is wrong with each bad element, in one line."""
    found = validate.check_elements(d.dirty_tables(spark, sf), workspace.new_dir(spark, "checked"))
    return found.report.groupBy("element").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("path", F.lit(": "), "error"))), ", ").alias("report"))


def record_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of paths as nested records, lists checked in place, by path without index."""
    dirty = d.dirty_tables(spark, sf)
    kinds = {"ways_nodes": ("id", "node_id", "position"), "ways_tags": ("id", "key", "value", "type")}
    rows = dirty["ways"].select("element", F.struct(*[c for c in dirty["ways"].columns if c != "element"]).alias("ways"))
    for name, fields in kinds.items():
        own = dirty[name].groupBy("element").agg(F.collect_list(F.struct(*fields)).alias(name))
        rows = rows.join(own, "element", "left")
    rows = rows.drop("element")
    found = rows.select(F.explode(validate.record_errors(rows, {t: RECORDS[t] for t in ("ways", *kinds)})).alias("e"))
    return found.groupBy(F.regexp_replace("e.path", r"\[[0-9]+\]", "[]").alias("path"), F.col("e.error").alias("error")).agg(F.count("*").alias("n"))


def unvalidated_elements(spark: SparkSession, sf: str) -> DataFrame:
    return _counted_elements(spark, sf, "off").select("table_name", F.col("kept").alias("n"))


def _counted_elements(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    found = validate.check_elements(d.dirty_tables(spark, sf), workspace.new_dir(spark, "checked"), mode)
    out = []
    for owner in ("nodes", "ways"):
        names = [name for name in found.kept if name.startswith(owner)]
        # One row per element: how many kept rows each table has of it, and so whether its own row is among them.
        own = reduce(DataFrame.unionByName, [
            found.kept[name].select("element", *[F.lit(int(n == name)).alias(n) for n in names]) for name in names
        ]).groupBy("element").agg(*[F.sum(n).alias(n) for n in names])
        orphan = F.col(owner) == 0
        counted = own.agg(F.array(*[
            F.struct(F.lit(n).alias("table_name"), F.coalesce(F.sum(n), F.lit(0)).alias("kept"),
                     F.coalesce(F.sum(F.when(orphan, F.col(n))), F.lit(0)).cast("int").alias("orphans")) for n in names
        ]).alias("tables")).select(F.inline("tables"))
        rejected = reduce(DataFrame.unionByName, [
            found.rejected[name].agg(F.lit(name).alias("table_name"), F.count("*").alias("rejected")) for name in names])
        out.append(counted.join(rejected, "table_name").select("table_name", "kept", "rejected", "orphans"))
    return reduce(DataFrame.unionByName, out)


# --- D: scalar cleaning -------------------------------------------------------------

def phone_format(spark: SparkSession, sf: str) -> DataFrame:
    """Phones in running text and in tags."""
    tagged = d.tags_by_key(spark, sf).where(clean.is_any_phone(F.col("k"))).select(F.col("v").alias("phone"))
    phones = d.document_phones(spark, sf).unionByName(tagged).distinct()
    return phones.select("phone", clean.phone_format(F.col("phone")).alias("formatted"))


def update_name(spark: SparkSession, sf: str) -> DataFrame:
    names = d.table(spark, sf, "part").select("p_partkey", "p_name")
    return names.select("*", clean.update_name(F.col("p_name"), NAME_MAPPING).alias("better_name"))


def clean_phone(spark: SparkSession, sf: str) -> DataFrame:
    tagged = d.tags_by_key(spark, sf).where(clean.is_phone(F.col("k")))
    return tagged.select("elem", "id", clean.clean_phone(F.col("v"), PHONE_MAPPING).alias("phone"))


# --- E: profiles and audits ---------------------------------------------------------

def count_tags(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_tags(markup.elements(d.staged(spark, sf)))


def distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    users = profile.distinct_users(markup.elements(d.staged(spark, sf)))
    return users.select(F.col("uid").cast("long").alias("uid"))


def count_users(spark: SparkSession, sf: str) -> DataFrame:
    return profile.count_users(markup.elements(d.staged(spark, sf)))


def all_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The six profiles of the markup from one scan of its staged rows and one of its tags."""
    tags = shape.raw_tags(d.children(spark, sf))
    found = workspace.store(profile.facts(markup.elements(d.staged(spark, sf)), tags), workspace.new_dir(spark, "profiles"))
    shown = {
        "count_tags": ("name", None, "n"), "key_classes": ("key_class", None, "n"), "distinct_users": ("uid", None, None),
        "audit_street_types": ("street_type", "street_name", None), "audit_zipcodes": ("postcode", None, None),
        "audit_phone": ("phone", "formatted", None),
    }
    return reduce(DataFrame.unionByName, [
        rows.select(
            F.lit(name).alias("profile"), F.col(shown[name][0]).alias("value"),
            (F.col(shown[name][1]) if shown[name][1] else F.lit(None).cast("string")).alias("more"),
            (F.col("n") if shown[name][2] else F.lit(None).cast("long")).alias("n"))
        for name, rows in profile.profiles(found).items()
    ])


# --- G: primitives ------------------------------------------------------------------

def every_kth(spark: SparkSession, sf: str) -> DataFrame:
    return order.every_kth(d.staged(spark, sf)).select(
        "name", F.col("id").cast("long").alias("id"), "element"
    )


def semi_join_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = d.node_tags(spark, sf)
    return analytics.tags_of(tags, analytics.distinct_tagged_ids(tags, "PROMO"))


# --- whole chain --------------------------------------------------------------------

def _whole_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Markup to answers; one row per answer row."""
    run = wrangle(spark, d.markup_path(spark, sf))
    rows = []
    for question, answer in run.answers().items():
        column = next((c for c in answer.columns if c != "n"), None)
        value = F.col(column) if column else F.lit(None).cast("string")
        rows.append(answer.select(F.lit(question).alias("question"), value.alias("value"), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def queries() -> dict[str, Query]:
    return {
        "scan_elements": scan_elements,
        "scan_top_level": scan_top_level,
        "scan_commented": scan_commented,
        "csv_roundtrip": csv_roundtrip,
        "csv_roundtrip_nodes": csv_roundtrip_nodes,
        "load_tables": load_tables,
        "sampled_extract": sampled_extract,
        "shape_nodes": shape_nodes,
        "shape_ways": shape_ways,
        "shape_node_tags": lambda s, sf: d.node_tags(s, sf, True),
        "shape_way_tags": lambda s, sf: d.way_tags(s, sf, True),
        "markup_node_tags": markup_node_tags,
        "markup_way_tags": markup_way_tags,
        "split_key": split_key,
        "way_node_positions": way_node_positions,
        "tag_predicates": tag_predicates,
        "validate_rows": validate_rows,
        "quarantine_rows": quarantine_rows,
        "quarantine_counts": quarantine_counts,
        "validated_elements": validated_elements,
        "unvalidated_elements": unvalidated_elements,
        "element_report": element_report,
        "record_errors": record_errors,
        "phone_format": phone_format,
        "update_name": update_name,
        "clean_phone": clean_phone,
        "count_tags": count_tags,
        "count_tags_pages": lambda s, sf: profile.count_tags(d.page_elements(s, sf)),
        "key_classes": lambda s, sf: profile.key_classes(d.raw_keys(s, sf)),
        "distinct_users": distinct_users,
        "all_profiles": all_profiles,
        "count_users": count_users,
        "audit_street_types": lambda s, sf: profile.audit_street_types(d.tags_by_key(s, sf)),
        "audit_zipcodes": lambda s, sf: profile.audit_zipcodes(d.tags_by_key(s, sf)),
        "audit_phone": lambda s, sf: profile.audit_phone(d.tags_by_key(s, sf)),
        "top_postcodes": lambda s, sf: analytics.top_postcodes(all_tags(s, sf, True)),
        "top_phones": lambda s, sf: analytics.top_phones(all_tags(s, sf, True)),
        "top_cities": lambda s, sf: analytics.top_cities(all_tags(s, sf, True)),
        "count_nodes": lambda s, sf: analytics.count_rows(d.nodes(s, sf)),
        "count_ways": lambda s, sf: analytics.count_rows(d.ways(s, sf)),
        "top_users": lambda s, sf: analytics.top_users(d.contributions(s, sf)),
        "one_time_users": lambda s, sf: analytics.one_time_users(d.contributions(s, sf)),
        "top_amenities": lambda s, sf: analytics.top_amenities(d.node_tags(s, sf, True)),
        "value_counts_religion":
            lambda s, sf: analytics.value_counts_for(d.node_tags(s, sf, True), "PROMO", "name"),
        "value_counts_cuisine":
            lambda s, sf: analytics.value_counts_for(d.node_tags(s, sf, True), "ECONOMY", "city"),
        "union_tags": all_tags,
        "distinct_tagged_ids":
            lambda s, sf: analytics.distinct_tagged_ids(d.node_tags(s, sf), "PROMO"),
        "every_kth": every_kth,
        "semi_join_tags": semi_join_tags,
        "key_suffix": lambda s, sf: all_tags(s, sf).where(analytics.key_ends_with("CITY")),
        "whole_chain": _whole_chain,
    }
