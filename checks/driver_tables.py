"""The given tables seen as a map extract.

Parts are points, orders are paths with one ref per line item, customers are relations.
``oracle`` states the same expressions in SQL. What is cached here are plans, not data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapengine import workspace
from mapengine.operators import order, shape
from mapengine.sources import markup

# Digits in front with or without a plus, an area code in brackets, digits joined by a hyphen.
PHONES = r"(?:\+?[0-9]+ )?\([0-9]{3}\) [0-9]+-[0-9]+"

STAMP = "2024-01-01T00:00:00Z"


@cache
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


# --- the five tables without markup -------------------------------------------------

def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("lat"),
        F.col("p_size").cast("double").alias("lon"),
        F.col("p_brand").alias("user"),
        F.col("p_size").cast("long").alias("uid"),
        F.lit("1").alias("version"),
        (F.col("p_partkey") % 100).alias("changeset"),
        F.lit(STAMP).alias("timestamp"),
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        _text("o_custkey").alias("user"),
        F.col("o_custkey").alias("uid"),
        F.lit("1").alias("version"),
        (F.col("o_orderkey") % 100).alias("changeset"),
        F.lit(STAMP).alias("timestamp"),
    )


def _postcode(number: Column) -> Column:
    return (number + 29980).cast("string")


def _phone(area: str, number: Column) -> Column:
    return F.concat(F.lit(f"({area}) 555-"), F.lpad((number % 1000).cast("string"), 4, "0"))


def _street(p: Mapping[str, Column]) -> Column:
    kind = p["p_size"] % 3
    end = F.when(kind == 0, " St.").when(kind == 1, " Street").otherwise("")
    return F.concat(p["p_name"], end)


class _Named(dict):
    """Columns by name; those not given are the columns of the table."""

    def __missing__(self, name: str) -> Column:
        return F.col(name)


def node_tag_values(given: Mapping[str, Column] | None = None) -> dict[str, Column]:
    p = _Named(given or {})
    return {
        "amenity": F.concat(p["p_type"], F.lit(" "), p["p_size"].cast("string")),
        "kind": p["p_type"],
        "building": F.when(p["p_size"] % 3 == 0, "place_of_worship").when(p["p_size"] % 3 == 1, "restaurant").otherwise("other"),
        "religion": p["p_brand"],
        "cuisine": p["p_type"],
        "addr:zipcode": _postcode(p["p_size"]),
        "addr:city": p["p_brand"],
        "name": p["p_name"],
        "size.code": p["p_size"].cast("string"),
        "contact:phone": _phone("404", p["p_partkey"]),
        "addr:postcode": _postcode(p["p_size"]),
        "addr:street": _street(p),
        "note": F.concat(p["p_name"], F.lit(" & \""), p["p_brand"], F.lit("\" <'x'> ")),
    }


def way_tag_values(given: Mapping[str, Column] | None = None) -> dict[str, Column]:
    o = _Named(given or {})
    return {
        "addr:postcode": _postcode(o["o_custkey"] % 50),
        "order:priority:level": o["o_orderpriority"],
        "Status": o["o_orderstatus"],
        "phone": _phone("678", o["o_custkey"]),
    }


_OWNERS = (("part", "node", "p_partkey", node_tag_values), ("orders", "way", "o_orderkey", way_tag_values))


def _all_tags(rows: DataFrame, elem: str, key: str, values: Callable[[], dict[str, Column]]) -> DataFrame:
    return rows.select(
        F.lit(elem).alias("elem"), F.col(key).alias("id"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values().items()])),
    )


@cache
def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``elem, id, k, v``; each table is read once."""
    return reduce(DataFrame.unionByName, [
        _all_tags(table(spark, sf_dir, name), elem, key, values) for name, elem, key, values in _OWNERS
    ])


def spread_node_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_tags`` in more tasks than the file of parts has splits: a row of it becomes 13 tags."""
    return shape.shape_node_tags(_all_tags(table(spark, sf_dir, "part").repartition("p_partkey"), *_OWNERS[0][1:]))


@cache
def tags_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a branch per key, of which a filter on the key drops all but one."""
    return reduce(DataFrame.unionByName, [
        table(spark, sf_dir, name).select(F.lit(elem).alias("elem"), F.col(key).alias("id"), F.lit(k).alias("k"), v.alias("v"))
        for name, elem, key, values in _OWNERS for k, v in values().items()
    ])


@cache
def node_tags(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    return shape.shape_node_tags((tags_by_key if by_key else raw_tags)(spark, sf_dir))


@cache
def way_tags(spark: SparkSession, sf_dir: str, by_key: bool = False) -> DataFrame:
    return shape.shape_way_tags((tags_by_key if by_key else raw_tags)(spark, sf_dir))


def raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all four classes, from tags, event types and part names."""
    events = table(spark, sf_dir, "events").select("event_type")
    doubled = F.concat_ws(":", "event_type", "event_type")
    return (
        tags_by_key(spark, sf_dir).select("k")
        .unionByName(events.select(F.col("event_type").alias("k")))
        .unionByName(events.select(doubled.alias("k")))
        .unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("k")))
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events").select(_text("user_id").alias("user"))
        .unionByName(table(spark, sf_dir, "orders").select(_text("o_custkey").alias("user")))
    )


def dirty_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as text; some ids do not parse and some users are missing."""
    key = F.col("p_partkey")
    return nodes(spark, sf_dir).select(
        F.when(F.col("id") % 97 == 0, F.concat(F.lit("x"), _text("id"))).otherwise(_text("id")).alias("id"),
        _text("lat").alias("lat"), _text("lon").alias("lon"),
        F.when(F.col("id") % 89 != 0, F.col("user")).alias("user"),
        _text("uid").alias("uid"), "version", _text("changeset").alias("changeset"), "timestamp",
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refs of paths with their positions; only the columns they are placed by are shuffled."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    placed = table(spark, sf_dir, "lineitem").select("l_orderkey", *order).withColumn("position", position)
    return placed.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("node_id"), "position")


def dirty_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All five tables as text with their ``element``; integers, floats and required fields fail."""
    node, way = F.col("id") * 2, F.col("id") * 2 + 1
    text = lambda df: df.select(*[c if c == "element" else F.col(c).cast("string").alias(c) for c in df.columns])

    def bad(df: DataFrame, column: str, when: Column, value: str | None) -> DataFrame:
        return df.withColumn(column, F.when(when, F.lit(value)).otherwise(F.col(column)))

    i = F.shiftright("element", 1)
    every = lambda n: i % n == 0
    out = {
        "nodes": text(nodes(spark, sf_dir).withColumn("element", node)),
        "nodes_tags": text(spread_node_tags(spark, sf_dir).withColumn("element", node)),
        "ways": text(ways(spark, sf_dir).withColumn("element", way)),
        "ways_nodes": text(refs(spark, sf_dir).withColumn("element", way)),
        "ways_tags": text(way_tags(spark, sf_dir).withColumn("element", way)),
    }
    out["nodes"] = bad(bad(bad(out["nodes"], "id", every(97), "x"), "user", every(89), None), "lat", every(83), "north")
    out["nodes_tags"] = bad(out["nodes_tags"], "value", every(79) & (F.col("key") == "name"), None)
    out["ways"] = bad(bad(out["ways"], "user", every(101), None), "changeset", every(103), "c")
    out["ways_nodes"] = bad(out["ways_nodes"], "node_id", every(109) & (F.col("position") == "0"), "r")
    out["ways_tags"] = bad(out["ways_tags"], "type", every(107) & (F.col("key") == "Status"), None)
    return out


def document_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole phone numbers in running text: every digit right before and after is a part of the number."""
    found = F.regexp_extract_all("text", F.lit(PHONES), F.lit(0))
    # Most texts hold no area code; looking for one is much cheaper than trying the whole pattern at every digit.
    texts = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\([0-9]{3}\) [0-9]"))
    return texts.select(F.explode(found).alias("phone"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of whatever looks like an opening tag, in comments and scripts as well."""
    names = F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9:._-]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.explode(names).alias("name"))


# --- the same as markup -------------------------------------------------------------

def _escaped(value: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _tag(name: str, attributes: dict[str, Column], end: str) -> Column:
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        parts += [F.lit(f' {key}="'), _escaped(value.cast("string")), F.lit('"')]
    return F.concat(*parts, F.lit(end))


_SORT = ("sort0", "sort1", "sort2", "sort3")
_ORDER = ("section", "key", "rank", *_SORT)


def _placed(rows: DataFrame, section: int, key: str, rank: int, of: str, *columns: str, sort: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns that put their lines in document order; ``columns`` are held as the struct ``of``."""
    padded = [F.col(c).cast("double") for c in sort] + [F.lit(0.0)] * (len(_SORT) - len(sort))
    return rows.select(
        F.lit(section).alias("section"), F.col(key).alias("key"), F.lit(rank).alias("rank"),
        *[c.alias(name) for name, c in zip(_SORT, padded, strict=True)], F.struct(*columns).alias(of),
    )


def _edge(spark: SparkSession, section: int, key: int, rank: int, line: str) -> DataFrame:
    return _placed(spark.range(1).select(F.lit(key).cast("long").alias("key"), F.lit(line).alias("line")), section, "key", rank, "edge", "line")


def markup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the extract in no order yet: values alone, so that they and not their markup are sorted and shuffled."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    items, customers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        _edge(spark, 0, 0, 0, '<?xml version="1.0" encoding="UTF-8"?>'),
        _edge(spark, 0, 0, 1, '<map version="0.6">'),
        _edge(spark, 0, 0, 2, '<bounds minlat="0" maxlat="1"/>'),
        _placed(part, 1, "p_partkey", 0, "node", "p_brand", "p_size", "p_retailprice", "p_type", "p_name"),
        _placed(orders, 2, "o_orderkey", 0, "way", "o_custkey"),
        _placed(items, 2, "l_orderkey", 1, "nd", "l_partkey", sort=("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")),
        _placed(orders, 2, "o_orderkey", 2, "way_end", "o_custkey", "o_orderpriority", "o_orderstatus"),
        _placed(customers, 3, "c_custkey", 0, "relation", "c_name", "c_nationkey", "c_mktsegment"),
        _edge(spark, 9, 0, 0, "</map>"),
    ])


def _joined(*lines: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(line, F.lit("")) for line in lines])


def _tags(values: Callable[..., dict[str, Column]], known: dict[str, Column]) -> list[Column]:
    return [_tag("tag", {"k": F.lit(k), "v": v}, "/>") for k, v in values(known).items()]


def _interpreted(make: Callable[[Column, Column], Column]) -> Column:
    given = F.struct(F.col("key"), F.col(make.__name__).alias("row"))
    return F.transform(F.array(given), lambda x: make(x["key"], x["row"]))[0]


def _text_of(commented: bool) -> Column:
    """The markup of a row. Elements stand in interpreted lambdas, so the loop over refs stays small enough to compile."""
    common = {"visible": F.lit("true"), "version": F.lit("1"), "timestamp": F.lit(STAMP)}

    def node(key: Column, r: Column) -> Column:
        head = {"id": key, **common, "changeset": key % 100, "user": r["p_brand"], "uid": r["p_size"], "lat": r["p_retailprice"], "lon": r["p_size"]}
        whole = _joined(_tag("node", head, ">"), *_tags(node_tag_values, {"p_partkey": key, **{c: r[c] for c in ("p_brand", "p_size", "p_type", "p_name")}}), F.lit("</node>"))
        if not commented:
            return whole
        comment = _joined(
            F.concat(F.lit("<!-- <node id='"), key, F.lit("'> a & b")), F.lit('<tag k="a" v="b"/><tag k=c v=d> </way>'), F.lit("</node> -->"))
        return F.when(key % 11 == 0, _joined(comment, whole)).otherwise(whole)

    def way(key: Column, r: Column) -> Column:
        return _tag("way", {"id": key, **common, "changeset": key % 100, "user": r["o_custkey"], "uid": r["o_custkey"]}, ">")

    def way_end(key: Column, r: Column) -> Column:
        tags, end = _tags(way_tag_values, {c: r[c] for c in ("o_custkey", "o_orderpriority", "o_orderstatus")}), F.lit("</way>")
        if not commented:
            return _joined(*tags, end)
        data = F.lit('<![CDATA[ <nd ref="1"/> --> </way> ]]><!-- <tag k="x" v="y"/> -->')
        return F.when(key % 13 == 0, _joined(*tags, data, end)).otherwise(_joined(*tags, end))

    def member(kind: str, ref: Column) -> Column:
        return _tag("member", {"type": F.lit(kind), "ref": ref, "role": F.lit("")}, "/>")

    def relation(key: Column, r: Column) -> Column:
        return _joined(
            _tag("relation", {"id": key, **common, "user": r["c_name"], "uid": key}, ">"), member("node", r["c_nationkey"]), member("way", key),
            _tag("tag", {"k": F.lit("type"), "v": r["c_mktsegment"]}, "/>"), F.lit("</relation>"))

    text = F.when(F.col("nd").isNotNull(), F.concat(F.lit('<nd ref="'), F.col("nd.l_partkey").cast("string"), F.lit('"/>')))
    for make in (node, way, way_end, relation):
        text = text.when(F.col(make.__name__).isNotNull(), _interpreted(make))
    return text.otherwise(F.col("edge.line"))


# The extract is five times as large as text than compressed. A compressed file is read by one task, so files are kept small.
CODEC, ROWS_PER_FILE = "snappy", 100_000


def _write_rows(rows: DataFrame, target: str, commented: bool = False) -> None:
    """Rows as consecutive text files: ranges of rows, so no element is one task's load."""
    lines = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(_text_of(commented).alias("line"))
    lines.write.mode("overwrite").option("compression", CODEC).option("maxRecordsPerFile", ROWS_PER_FILE).text(target)


def write_markup(spark: SparkSession, sf_dir: str, target: str) -> None:
    """The extract as consecutive text files."""
    _write_rows(markup_rows(spark, sf_dir), target)


def write_commented(spark: SparkSession, sf_dir: str, target: str) -> list[str]:
    """The extract in two folders, with points and paths in comments and CDATA; a comment begins in the first
    folder and ends in the second."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        markup_rows(spark, sf_dir),
        _edge(spark, 1, 1 << 60, 10_000, '<!-- <way id="1"> <nd ref="2"/>'),
        _edge(spark, 2, -1, -1, '<nd ref="3"/> </way> -->'),
    ])
    paths = [f"{target}/first", f"{target}/second"]
    _write_rows(rows.where("section < 2"), paths[0], True)
    _write_rows(rows.where("section >= 2"), paths[1], True)
    return paths


_made: dict[tuple[str, str, str], str | DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], str | DataFrame]):
    """What ``make`` returns, made when first asked for and once per application."""
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _made:
        _made[key] = make(workspace.new_dir(spark, name))
    return _made[key]


def markup_path(spark: SparkSession, sf_dir: str) -> str:
    """The extract as text files."""
    def written(target: str) -> str:
        write_markup(spark, sf_dir, target)
        return target

    return _once(spark, sf_dir, "markup", written)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its staged rows."""
    return _once(spark, sf_dir, "staged", lambda target: markup.stage_events(spark, markup_path(spark, sf_dir), target))


def staged_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the text of every tag."""
    return _once(spark, sf_dir, "staged_markup", lambda target: markup.stage_events(
        spark, markup_path(spark, sf_dir), target, keep_markup=True))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its stored children."""
    return _once(spark, sf_dir, "children", lambda target: order.store_children(staged(spark, sf_dir), target))
