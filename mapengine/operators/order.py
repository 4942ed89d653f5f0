"""Document order: parents, positions and dense indexes without a global window.

Every value here is a running count, or the latest mark so far, over all rows of an extract
in document order. It is folded in three levels:

1. rows are cut into segments of at most ``2 ** SEGMENT_BITS`` consecutive rows of a split,
   shuffled once, folded inside each segment and stored with what the fold gave. No group of rows is larger
   than a segment, however many children one element has and however large a file is;
2. the last row of each segment sums it up; these are folded inside each split;
3. each split is summed up in one row, and these are folded over the extract. Only this
   table, with one row for each split the driver has planned, is sorted as a whole.

Rows and sums are both read from storage, so the windows over the rows run once. What came before a segment is
stored in one row and joined to its rows; Spark broadcasts that table while its size on disk allows it, and
otherwise shuffles the rows once more.

Rows come from ``sources.markup``, which has checked that tags match and that no top-level element lies
inside another. They must hold every opening and closing tag of top-level elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapengine.model import CHILDREN, SAMPLE_STEP, TOP_LEVEL
from mapengine.sources.lexical import POSITION
from mapengine.workspace import new_dir
from mapengine.workspace import packed as store

# 65,536 rows: a window holds some megabytes, and an extract of a terabyte has a few hundred thousand segments.
SEGMENT_BITS = 16

CHILD_FIELDS = ("k", "v", "ref", "type", "role")

_SPLIT = ("file", "block")
_SEGMENT = ("segment", "block", "file")
_MOVED = "splits moved between two scans of one query; stage the extract first"


def _is(event: str, *names: str) -> Column:
    return (F.col("event") == event) & F.col("name").isin(*names)


def _starts(*names: str) -> Column:
    return (F.col("event") != "close") & F.col("name").isin(*names)


def _mark(refs: Column, name: Column, id_: Column, seq: Column) -> Column:
    """What is open from a row on: a top-level element, or, with a NULL name, none."""
    return F.struct(name.alias("name"), id_.alias("id"), seq.alias("seq"), refs.alias("refs"))


def _shifted(mark: Column, refs: Column) -> Column:
    """``mark`` with its ref count seen from further back; NULL stays NULL."""
    return F.when(
        mark.isNotNull(), _mark(mark["refs"] + refs, mark["name"], mark["id"], mark["seq"])
    )


def _carry(sums: DataFrame, before: Window) -> DataFrame:
    """Replaces counts and last mark of each summary row by those of all rows before it."""
    earlier = sums.withColumns({
        "elements_before": F.coalesce(F.sum("elements").over(before), F.lit(0)),
        "refs_before": F.coalesce(F.sum("refs").over(before), F.lit(0)),
    })
    last = _shifted(F.col("last"), F.col("refs_before"))
    return (
        earlier.withColumn("last", last)
        .withColumn("carried", F.last("last", ignorenulls=True).over(before))
    )


def _carried_in(local: DataFrame) -> DataFrame:
    """Per segment: what precedes it in the whole extract."""
    so_far = (Window.unboundedPreceding, -1)
    per_segment = local.where("_last").select(
        *_SEGMENT, F.col("_elements").alias("elements"), F.col("_refs").alias("refs"), F.col("_mark").alias("last"))
    in_split = _carry(per_segment, Window.partitionBy(*_SPLIT).orderBy("segment").rowsBetween(*so_far))
    per_split = in_split.groupBy(*_SPLIT).agg(
        F.sum("elements").alias("elements"),
        F.sum("refs").alias("refs"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("segment"))).alias("last"),
    )
    splits = _carry(per_split, Window.orderBy(*_SPLIT).rowsBetween(*so_far)).select(
        *_SPLIT,
        F.col("elements_before").alias("split_elements"),
        F.col("refs_before").alias("split_refs"),
        F.col("carried").alias("split_carried"),
    )
    return in_split.join(splits, list(_SPLIT), "left").select(
        *_SEGMENT,
        (F.col("elements_before") + F.col("split_elements")).alias("_elements_before"),
        (F.col("refs_before") + F.col("split_refs")).alias("_refs_before"),
        # Without an earlier mark in the split, what is open comes from the splits before.
        F.coalesce(_shifted(F.col("carried"), F.col("split_refs")), F.col("split_carried"))
        .alias("_carried"),
    )


def _folded(rows: DataFrame, segment_bits: int) -> DataFrame:
    """The rows with what precedes each in its segment, stored in the order of the fold."""
    ordered = Window.partitionBy(*_SEGMENT).orderBy("seq")
    in_segment = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = " AND ".join(f"{c} IS NOT NULL" for c in POSITION)
    local = (
        rows.where(known).withColumn("segment", F.shiftright("seq", segment_bits))
        .withColumns({
            "_elements": F.count_if(_starts(*TOP_LEVEL)).over(in_segment),
            "_refs": F.count_if(_starts("nd")).over(in_segment),
        })
        .withColumn(
            "_own",
            F.when(
                _is("open", *TOP_LEVEL),
                _mark(F.col("_refs"), F.col("name"), F.col("id"), F.col("seq")),
            ).when(
                _is("close", *TOP_LEVEL),
                _mark(F.col("_refs"), *[F.lit(None).cast(t) for t in ("string", "string", "long")]),
            ),
        )
        .withColumns({
            "_mark": F.last("_own", ignorenulls=True).over(in_segment),
            "_last": F.lead("seq").over(ordered).isNull(),
        })
        .drop("_own")
    )
    return store(local, new_dir(rows.sparkSession, "folded"))


def in_document_order(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Adds three columns to ``events`` or staged rows, or to a selection of them that holds
    every opening and closing tag of top-level elements.

    ``element``: index, from 0, of the latest top-level element begun so far;
    ``parent``: name, id and seq of the top-level element the row is inside of, or NULLs;
    ``position``: number of earlier ``nd`` children of the same parent, for ``nd`` rows.
    """
    local = _folded(rows, segment_bits)
    carried = store(_carried_in(local), new_dir(rows.sparkSession, "carried"))
    missing = F.col("_elements_before").isNull()
    refs_so_far = F.col("_refs_before") + F.col("_refs")
    return (
        local.join(carried, list(_SEGMENT), "left")
        .withColumn(
            "parent",
            F.when(missing, F.raise_error(F.lit(_MOVED))).otherwise(
                F.coalesce(_shifted(F.col("_mark"), F.col("_refs_before")), F.col("_carried"))
            ),
        )
        .withColumn(
            "element",
            F.when(missing, F.raise_error(F.lit(_MOVED)))
            .otherwise(F.col("_elements_before") + F.col("_elements") - 1),
        )
        .withColumn(
            "position",
            F.when(_starts("nd"), (refs_so_far - 1 - F.col("parent.refs")).cast("int")),
        )
        .withColumn("parent", F.col("parent").dropFields("refs"))
        .select(*rows.columns, "parent", "element", "position")
    )


def children(rows: DataFrame, segment_bits: int = SEGMENT_BITS, fields: Sequence[str] = CHILD_FIELDS) -> DataFrame:
    """``tag``, ``nd`` and ``member`` rows with their parent and, of their own attributes, ``fields``.

    Elements without children never enter the shuffle, nor do columns other than id. Parents are told apart by ``parent.seq``, not by id: a history extract repeats ids.
    """
    slim = rows.where(
        _starts(*CHILDREN) | _is("open", *TOP_LEVEL) | _is("close", *TOP_LEVEL)
    ).select(*POSITION, "event", "name", "id", *fields)
    return (
        in_document_order(slim, segment_bits)
        .where(F.col("name").isin(*CHILDREN) & F.col("parent.name").isNotNull())
        .select(*POSITION, "name", *fields, "parent", "position")
    )


def store_children(rows: DataFrame, target: str, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``children``, computed once and stored so that each kind of child can be read alone."""
    return store(children(rows, segment_bits), target)


def element_index(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Top-level elements with ``element``, their dense index from 0 in document order."""
    tags = rows.where(F.col("name").isin(*TOP_LEVEL)).select(*POSITION, "event", "name", "id")
    return (
        in_document_order(tags, segment_bits).where(_starts(*TOP_LEVEL))
        .select(*POSITION, "name", "id", "element")
    )


def every_kth(rows: DataFrame, k: int = SAMPLE_STEP, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Every k-th top-level element in document order, the first one included."""
    return element_index(rows, segment_bits).where(F.col("element") % k == 0)
