import pytest

from mapengine.model import typed_schema
from mapengine.operators import analytics
from tests.plans import final_plan, plan


def tags(spark, name, rows):
    return spark.createDataFrame(rows, typed_schema(name))


@pytest.fixture(scope="module")
def tables(spark):
    node = lambda i, user: (i, 1.0, 1.0, user, 1, "1", 1, "t")
    way = lambda i, user: (i, user, 1, "1", 1, "t")
    node_tags = [
        (1, "postcode", "30043", "addr"), (2, "postcode", "30043", "addr"),
        (3, "postcode", "30301", "addr"), (1, "phone", "1", "contact"), (2, "phone", "1", "regular"),
        (1, "city", "Rome", "addr"), (2, "City", "Bath", "regular"), (3, "capacity", "20", "regular"),
        (3, "city:en", "no", "regular"),
        (1, "amenity", "place_of_worship", "regular"), (1, "religion", "a", "regular"),
        (1, "religion", "b", "regular"), (2, "religion", "a", "regular"),
        (4, "was", "place_of_worship", "regular"), (4, "religion", "b", "regular"),
        (4, "amenity", "place_of_worship", "regular"),
        (5, "amenity", "restaurant", "regular"), (5, "cuisine", "thai", "regular"),
        (6, "shop", "restaurant", "regular"), (6, "cuisine", "pizza", "regular"),
        (7, "cuisine", "none", "regular"),
    ]
    way_tags = [(1, "postcode", "30301", "addr"), (9, "phone", "2", "regular"),
                (1, "cuisine", "way", "regular"), (9, "amenity", "bank", "regular")]
    return {
        "nodes": spark.createDataFrame([node(i, u) for i, u in enumerate("aabbc")], typed_schema("nodes")),
        "ways": spark.createDataFrame([way(i, u) for i, u in enumerate("ade")], typed_schema("ways")),
        "nodes_tags": tags(spark, "nodes_tags", node_tags),
        "ways_tags": tags(spark, "ways_tags", way_tags),
    }


def test_ten_answers(tables):
    found = {k: [tuple(r) for r in df.collect()] for k, df in analytics.answers(tables).items()}
    assert found == {
        "top_postcodes": [("30043", 2), ("30301", 2)],
        "top_phones": [("1", 2), ("2", 1)],
        "top_cities": [("20", 1), ("Bath", 1), ("Rome", 1)],
        "count_nodes": [(5,)],
        "count_ways": [(3,)],
        "top_users": [("a", 3), ("b", 2), ("c", 1), ("d", 1), ("e", 1)],
        "one_time_users": [(3,)],
        "top_amenities": [("place_of_worship", 2), ("restaurant", 1)],
        "religions": [("b", 2), ("a", 1)],
        "cuisines": [("pizza", 1), ("thai", 1)],
    }


def test_limit_breaks_ties_by_value(spark):
    rows = tags(spark, "nodes_tags", [(i, "amenity", f"v{i:02}", "regular") for i in range(30)])
    assert [r.value for r in analytics.top_amenities(rows).collect()] == [f"v{i:02}" for i in range(10)]
    assert analytics.top_amenities(rows, None).count() == 30


def test_hot_id(spark, tmp_path):
    """One id with a third of all tags: shuffled once by id, and split beyond the broadcast size."""
    hot = [(1, "religion", f"{i * 7919 % 30_011}x", "regular") for i in range(30_000)] + [(1, "amenity", "place_of_worship", "regular")]
    cold = [(i, "religion", "y", "regular") for i in range(2, 60_000)]
    worship = [(i, "amenity", "place_of_worship", "regular") for i in range(2, 400)]
    tags(spark, "nodes_tags", hot + cold + worship).write.parquet(str(tmp_path / "hot"))
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        found = analytics.religions(spark.read.parquet(str(tmp_path / "hot")))
        text = final_plan(found)
        rows = [tuple(r) for r in found.collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert rows[0] == ("y", 398) and len(rows) == 30_001 and {n for _, n in rows[1:]} == {1}
    assert text.count("Exchange hashpartitioning(id") == 2 and text.count("Exchange hashpartitioning(value") == 1
    assert "skew=true" in text


def test_plans(spark, tables, tmp_path):
    tables["nodes_tags"].write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    ids = analytics.distinct_tagged_ids(stored, "restaurant")
    assert "LeftSemi" in plan(analytics.tags_of(stored, ids))
    top = plan(analytics.top_amenities(stored))
    assert "TakeOrderedAndProject" in top
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,amenity)]" in top
    assert "ReadSchema: struct<key:string,value:string>" in top
    both = plan(analytics.top_postcodes(analytics.union_tags(stored, stored)))
    assert both.count("EqualTo(key,postcode)") == 2
    assert "partial_count" in both
    assert "SinglePartition" not in final_plan(analytics.value_counts(stored, analytics.key_is("phone")))
