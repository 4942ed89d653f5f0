import random

import pytest
from pyspark.sql import functions as F

from mapengine.llm import common


@pytest.mark.parametrize("block", [4096, 3])
def test_running_total(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice([0, 0, 0, 1, 2]), rng.getrandbits(64) - (1 << 63), i, rng.randint(0, 9)) for i in range(500)]
    table = spark.createDataFrame(rows, "g int, h long, i long, v long")
    found = common.running_total(table, ["g"], ["h", "i"], "v", "fine", rows_per_block=block)
    want, before = set(), {}
    for g, h, i, v in sorted(rows):
        want.add((g, h, i, v, before.get(g, 0)))
        before[g] = before.get(g, 0) + v
    assert {tuple(r) for r in found.collect()} == want
    assert common.running_total(table.where("g > 9"), ["g"], ["h", "i"], "v", "t").count() == 0


def test_lower_case_of_plain_letters_only(column):
    assert column(common.ascii_lower, "ABCxyzÀÉİ", "PLAIN", "", "ß") == ["abcxyzÀÉİ", "plain", "", "ß"]


def test_unused_names(spark):
    rows = spark.range(1).withColumns({"Text": F.lit(1), "_n": F.lit(1), "n": F.lit(1)})
    assert common.unused(rows, "text", "n", "x", "x") == ["_text", "__n", "x", "_x"]
