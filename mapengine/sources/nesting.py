"""Tags that match at every depth, checked over splits of any size.

A run of tags is summed up by the closing tags it does not open itself and the opening tags it does not
close itself. Two neighbouring summaries give that of both runs: the last opening tags of the first must
be those that the first closing tags of the second close. So runs are summed up in segments, segments
in splits and splits in the extract; what a task holds grows with a segment, with the splits,
and with the depth of what is open, never with the extract. Elements without children take part only
where they are top-level ones: none of these may lie inside another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.model import TOP_LEVEL
from mapengine.sources.lexical import SPLIT

# Rows per segment, as a power of two.
SEGMENT_BITS = 16

_SUMMARY = "struct<closes: array<string>, opens: array<string>, depth: int, problem: string>"
_NOTHING = f"cast(struct(array(), array(), null, null) AS {_SUMMARY})"


def _summary(closes: Column, opens: Column, depth: Column, problem: Column) -> Column:
    return F.struct(closes.alias("closes"), opens.alias("opens"), depth.alias("depth"), problem.alias("problem"))


def _top(names: Column) -> Column:
    return F.exists(names, lambda n: n.isin(*TOP_LEVEL))


def _unmatched(closed: Column, opened: Column) -> Column:
    return F.concat(F.lit("bad nesting: </"), closed, F.lit("> does not close <"), opened, F.lit(">"))


def _inside(name: Column, outer: Column) -> Column:
    return F.concat(F.lit("bad nesting: <"), name, F.lit("> inside <"), F.element_at(F.filter(outer, lambda n: n.isin(*TOP_LEVEL)), -1), F.lit(">"))


def _with_tag(a: Column, tag: Column) -> Column:
    """The summary of a run and the tag after it. ``depth``: of unmatched closing tags before the outermost
    top-level tag that begins outside all tags opened in the run; the fewer, the more is open around it."""
    begins, ends, name = tag["event"] != "close", tag["event"] == "close", tag["name"]
    known = F.size(a["opens"]) > 0
    own_top = begins & name.isin(*TOP_LEVEL)
    return _summary(
        F.when(ends & ~known, F.concat(a["closes"], F.array(name))).otherwise(a["closes"]),
        F.when(tag["event"] == "open", F.concat(a["opens"], F.array(name)))
        .when(ends & known, F.slice(a["opens"], F.lit(1), F.size(a["opens"]) - 1)).otherwise(a["opens"]),
        F.when(own_top, F.least(a["depth"], F.size(a["closes"]))).otherwise(a["depth"]),
        F.when(a["problem"].isNotNull(), a["problem"])
        .when(ends & known & (F.element_at(a["opens"], -1) != name), _unmatched(name, F.element_at(a["opens"], -1)))
        .when(own_top & _top(a["opens"]), _inside(name, a["opens"])),
    )


def _with_run(a: Column, b: Column) -> Column:
    """The summary of two neighbouring runs."""
    opened, closed = F.size(a["opens"]), F.size(b["closes"])
    both = F.least(opened, closed)
    met = F.reverse(F.slice(a["opens"], opened - both + 1, both))
    own = F.slice(b["closes"], F.lit(1), both)
    pairs = F.zip_with(own, met, lambda c, o: F.struct(c.alias("closed"), o.alias("opened")))
    wrong = F.element_at(F.filter(pairs, lambda p: p["closed"] != p["opened"]), 1)
    around = F.when(b["depth"].isNotNull(), F.slice(a["opens"], F.lit(1), F.greatest(opened - b["depth"], F.lit(0))))
    return _summary(
        F.concat(a["closes"], F.slice(b["closes"], both + 1, closed)),
        F.concat(F.slice(a["opens"], F.lit(1), opened - both), b["opens"]),
        F.least(a["depth"], F.when(b["depth"].isNotNull(), F.size(a["closes"]) + F.greatest(b["depth"] - opened, F.lit(0)))),
        F.when(a["problem"].isNotNull(), a["problem"])
        .when(met != own, _unmatched(wrong["closed"], wrong["opened"]))
        .when(_top(around), _inside(F.lit("an element"), around))
        .otherwise(b["problem"]),
    )


def _folded(items: Column, step) -> Column:
    return F.aggregate(items, F.expr(_NOTHING), lambda a, x: step(a, x).cast(_SUMMARY))


def summary(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row: closing tags nothing opens, opening tags nothing closes, and the first problem."""
    tags = rows.where((F.col("event") != "empty") | F.col("name").isin(*TOP_LEVEL)).select(
        *SPLIT, F.shiftright("seq", segment_bits).alias("segment"), "seq", "event", "name")
    listed = F.sort_array(F.collect_list(F.struct("seq", "event", "name")))
    segments = tags.groupBy(*SPLIT, "segment").agg(listed.alias("tags")).select(
        *SPLIT, "segment", _folded(F.col("tags"), _with_tag).alias("run"))
    runs = lambda a, x: _with_run(a, x["run"])
    splits = segments.groupBy(*SPLIT).agg(F.sort_array(F.collect_list(F.struct("segment", "run"))).alias("runs")).select(
        *SPLIT, _folded(F.col("runs"), runs).alias("run"))
    return splits.agg(F.sort_array(F.collect_list(F.struct(*SPLIT, "run"))).alias("runs")).select(
        F.inline(F.array(_folded(F.col("runs"), runs))))


def check(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> None:
    """Stops on the first tag, at any depth, that does not match."""
    found = summary(rows, segment_bits).first()
    if found["problem"] is not None:
        raise ValueError(found["problem"])
    if found["closes"]:
        raise ValueError(f"bad nesting: </{found['closes'][0]}> does not close <>")
    if found["opens"]:
        raise ValueError(f"bad nesting: <{found['opens'][-1]}> is open at the end")
