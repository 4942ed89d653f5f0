"""What the corpus operators share: text expressions, stored tables and prefix sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapengine.workspace import new_dir, store

# Fixed characters: the ASCII blanks that separate words and frame lines.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: lineage ends here."""
    return store(rows, new_dir(rows.sparkSession, name))


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that clash with no column of ``rows``, in any letter case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is NULL."""
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(column, F.lit(""))


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` is much faster than ``translate`` and does the same to plain ASCII.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """All words of a text, in order."""
    return F.filter(F.split(text, BLANK_RUN, -1), lambda w: w != "")


def running_total(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
    rows_per_block: int = 4096,
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows of the row's group.

    The first ``order`` column is a LONG; the others break its ties. Groups may be of any
    size: a group is cut into ranges of that column, twice, so that no window ever sees more
    than about ``rows_per_block`` rows or the square root of the number of blocks. Rows are
    shuffled once; the sums of the ranges, summed map-side, are joined to them. Group columns
    hold no NULLs. Rows that tie on everything may change places.

    Ranges follow the value of the first order column (a hash spreads evenly); a value shared
    by very many rows is one block, so break such ties in the value itself.
    """
    n = rows.count()
    bits = 2 * math.ceil(max(0.0, math.log2(max(n, 1) / rows_per_block)) / 2)
    before = (Window.unboundedPreceding, -1)
    keys, ordered = [col(g) for g in group], [col(o) for o in order]

    def earlier(summed: str, window: Window) -> Column:
        return F.coalesce(F.sum(col(summed)).over(window.rowsBetween(*before)), F.lit(0))

    if bits == 0:
        return rows.withColumn(out, earlier(value, Window.partitionBy(*keys).orderBy(*ordered)))
    (fine,) = unused(rows.withColumn(out, F.lit(0)), "fine")
    blocked = rows.withColumn(fine, F.shiftright(col(order[0]), 64 - bits))
    # Names of the sums' own columns: g0, g1, ... for the group.
    named = [col(g).alias(f"g{i}") for i, g in enumerate(group)]
    g = [F.col(f"g{i}") for i in range(len(group))]
    sums = (
        blocked.groupBy(*named, col(fine).alias("f")).agg(F.sum(col(value)).alias("s"))
        .withColumn("c", F.shiftright("f", bits // 2))
    )
    parts = sums.withColumn("in_c", earlier("s", Window.partitionBy(*g, "c").orderBy("f")))
    tops = (
        sums.groupBy(*g, "c").agg(F.sum("s").alias("s"))
        .withColumn("in_g", earlier("s", Window.partitionBy(*g).orderBy("c")))
        .select(*[x.alias(f"t{i}") for i, x in enumerate(g)], F.col("c").alias("tc"), "in_g")
    )
    same = F.col("c") == F.col("tc")
    for i in range(len(group)):
        same = same & (F.col(f"g{i}") == F.col(f"t{i}"))
    # Unusual names, so that no column of ``rows`` is hidden in the join below.
    mine = [f"\u2211{i}" for i in range(len(group) + 2)]
    offsets = parts.join(tops, same).select(
        *[x.alias(m) for x, m in zip(g, mine, strict=False)],
        F.col("f").alias(mine[-2]), (F.col("in_c") + F.col("in_g")).alias(mine[-1]),
    )
    local = blocked.withColumn(out, earlier(value, Window.partitionBy(*keys, col(fine)).orderBy(*ordered)))
    match = col(fine) == col(mine[-2])
    for name, m in zip(group, mine, strict=False):
        match = match & (col(name) == col(m))
    return local.join(offsets, match, "left").select(
        *[col(c) for c in rows.columns], (col(out) + col(mine[-1])).alias(out)
    )
