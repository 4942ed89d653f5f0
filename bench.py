"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query runs to the end into
a sink that discards rows; the best of three runs counts, the first one being cold.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import driver_tables as d
from checks.queries import queries
from mapengine import workspace
from mapengine.model import TABLES
from mapengine.operators import order, shape, validate
from mapengine.sources import markup

HEADLINE = (
    "top_postcodes", "top_phones", "top_cities", "count_nodes", "count_ways", "top_users",
    "one_time_users", "top_amenities", "value_counts_religion", "value_counts_cuisine",
    "shape_node_tags", "shape_way_tags", "way_node_positions", "key_classes", "count_tags",
    "count_tags_pages", "distinct_users", "audit_street_types", "audit_zipcodes", "audit_phone",
    "phone_format", "every_kth", "validate_rows", "quarantine_counts",
)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action: Callable[[], object], runs: int = 3) -> float:
    best = float("inf")
    for _ in range(runs):
        start = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - start)
    return round(best, 3)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    seconds: dict[str, float] = {}

    # The markup is test data; writing it is not timed.
    path = d.markup_path(spark, sf_dir)
    seconds["stage_markup"] = timed(
        lambda: markup.stage_events(spark, path, workspace.new_dir(spark, "bench"))
    )
    staged = d.staged(spark, sf_dir)
    seconds["children"] = timed(lambda: drain(order.children(staged)))

    registered = queries()
    for name in HEADLINE:
        seconds[name] = timed(lambda: drain(registered[name](spark, sf_dir)))

    raw = shape.shape(markup.elements(staged), d.children(spark, sf_dir))
    for mode in ("off", "quarantine"):
        seconds[f"five_tables_{mode}"] = timed(
            lambda: [drain(validate.validate(raw[t], t, mode)) for t in TABLES]
        )

    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
