"""Mixing sources to target weights, by systematic sampling.

Within its source every document expects the same number of copies: the source's target over
its size, both in words. Expected copies are summed up over the documents of the source; one
random offset is added; a document is emitted once for every integer that its part of that sum
crosses. Documents are summed up in order of size, so what a source takes is within about one
document of its target, whatever the sizes. A small source with a few long documents can
still be off by one of these, so the random offset and ``offsets - 1`` more, at even steps
from it, are tried, and each source uses the one that takes it nearest to its target.

Everything is DataFrame operations. A hot source is cut into sizes and ranges (``common.
running_total``), so no task sees all of it. Only the table with one row per source is handled
by one task: it has as many rows as there are names to weigh, not documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapengine.llm.common import WORD, col, running_total, stored, text_of, unused

WEIGHTS = (1.0, 2.0, 3.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Targets of sources: ``source, source_size`` in; ``target`` added.

    Sources by code point, NULL last, weigh ``weights``, repeating. They share the total size
    by weight; a target stops at ``most`` times its source's size, and what is beyond is
    shared again by weight until none is above.

    That is one level: ``target = least(weight * level, most * source_size)``. Sources reach
    their limit in the order of limit over weight, so running sums in that order give it.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("weight", cycle).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    in_turn = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    leveled = limited.select(
        "*",
        F.sum("source_size").over(all_).alias("total"),
        F.coalesce(F.sum("limit").over(so_far), F.lit(0.0)).alias("limits_before"),
        F.sum("weight").over(in_turn.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("weights_left"),
    )
    # The level if all before this source are at their limit and it and those after are not.
    level = (F.col("total") - F.col("limits_before")) / F.col("weights_left")
    fits = level <= F.col("limit") / F.col("weight")
    first = F.first(F.when(fits, level), ignorenulls=True).over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = leveled.withColumn("level", first)
    share = F.col("weight") * F.col("level")
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(share, F.col("limit")))
    return found.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: float = 3.0,
    seed: int = 7,
    offsets: int = 16,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, th, source, size, source_size, target, copies``.

    ``size`` is the number of words, ``th`` a hash of the text, ``copies`` how often the mix
    takes the document: 0 to ``most`` rounded up. Reruns with one ``seed`` agree.

    A NULL source is a source of its own. NULL or empty text has size 0 and adds nothing; a
    source that has no words at all has target 0 and its documents 0 copies. Rows that agree
    in id, source and text share their copies between them; which of them gets how many makes
    no difference. Columns other than the three named are not looked at. An empty table gives
    an empty table.
    """
    sized = stored(
        docs.select(
            col(id).alias("doc_id"), F.xxhash64(text_of(text)).alias("th"),
            col(source).cast("string").alias("source"), word_count(text_of(text)).alias("size"),
        ).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "th")),
        "sizes",
    )
    # Earlier documents of one size, then of smaller ones; both counts come from small sums.
    grouped = sized.withColumns({
        "one": F.lit(1), "none": F.col("source").isNull(), "named": F.coalesce("source", F.lit("")),
    })
    ranked = running_total(grouped, ["none", "named", "size"], ["draw", "doc_id", "th"], "one", "earlier")
    by_size = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    smaller = by_size.withColumn(
        "smaller",
        F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(F.col("source").alias("s"), F.col("size").alias("z"), "smaller")
    targets = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
    ).select(F.col("source").alias("t"), "source_size", "target")
    places = smaller.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    placed = ranked.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # 20 bits, so that adding the offset to a whole number is exact.
    unit = 1 << 20
    first = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(unit))
    placed = stored(placed.select(
        "doc_id", "th", "source", "size", "source_size", "target",
        (F.col("earlier") + F.col("smaller")).alias("place"), expected.alias("expected"),
    ), "placed")

    def copies(offset: Column) -> Column:
        upto = F.floor((F.col("place") + 1) * F.col("expected") + offset)
        return upto - F.floor(F.col("place") * F.col("expected") + offset)

    tried = [F.pmod(first + F.lit(unit * k // offsets), F.lit(unit)) / F.lit(float(unit)) for k in range(offsets)]
    taken = placed.groupBy("source").agg(
        F.max("target").alias("t"), *[F.sum(F.col("size") * copies(u)).alias(f"w{k}") for k, u in enumerate(tried)]
    )
    best = F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("off"), u.alias("offset")) for k, u in enumerate(tried)
    ]))
    chosen = taken.select(F.col("source").alias("s"), best["offset"].alias("offset"))
    return placed.join(chosen, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "th", "source", "size", "source_size", "target", copies(F.col("offset")).alias("copies")
    )


def take(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; columns as they were.

    Edge cases are those of ``mix``. Rows that agree in id, source and text are told apart by
    nothing, so their copies are added up and shared out again: one of them carries the sum.
    """
    mixed = mix(docs, id, text, source, **options).where(F.col("copies") > 0)
    per_row = mixed.groupBy("doc_id", "th", "source").agg(F.sum("copies").alias("copies"))
    i, t, s, n, own = unused(docs, "mix_id", "mix_th", "mix_source", "mix_copies", "own_th")
    per_row = per_row.select(
        F.col("doc_id").alias(i), F.col("th").alias(t), F.col("source").alias(s), F.col("copies").alias(n)
    )
    keyed = docs.withColumn(own, F.xxhash64(text_of(text)))
    (turn,) = unused(keyed, "mix_turn")
    same = Window.partitionBy(col(id), col(own), col(source)).orderBy(col(own))
    firsts = keyed.withColumn(turn, F.row_number().over(same)).where(col(turn) == 1)
    found = col(id).eqNullSafe(col(i)) & (col(own) == col(t)) & col(source).cast("string").eqNullSafe(col(s))
    (copy,) = unused(firsts.join(per_row, found), "copy")
    return firsts.join(per_row, found).withColumn(
        copy, F.explode(F.sequence(F.lit(1), col(n).cast("int")))
    ).select(*[col(c) for c in docs.columns])
