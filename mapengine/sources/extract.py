"""Sampled extracts: markup files that hold every k-th top-level element, children included."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapengine.model import SAMPLE_STEP, TOP_LEVEL
from mapengine.operators.order import SEGMENT_BITS, in_document_order
from mapengine.sources import lexical
from mapengine.sources.lexical import POSITION, SPLIT
from mapengine.workspace import new_dir
from mapengine.workspace import packed as store

_HEADER, _BODY, _FOOTER = 0, 1, 2

TAGS_PER_FILE = 1_000_000


def _sampled_bits(rows: DataFrame, k: int, segment_bits: int) -> DataFrame:
    """Rows of every k-th top-level element, from its first tag to its last, as bits (``lexical.span_bits``).

    Only the tags of top-level elements are put in order. An element may run over from one split to the next ones.
    """
    tops = in_document_order(rows.where(F.col("name").isin(*TOP_LEVEL)).select(*POSITION, "event", "name", "id"), segment_bits)
    own, opened = F.col("element") % k == 0, F.col("event") == "open"
    ends = lexical.bounds(rows)
    last = tops.groupBy(*SPLIT).agg(F.max_by(opened & own, "seq").alias("open"))
    so_far = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = ends.join(last, list(SPLIT), "left").withColumn("inside", F.last("open", ignorenulls=True).over(so_far))
    changes = (
        splits.where("inside").select(*SPLIT, (F.col("first") - 1).alias("seq"), F.lit(True).alias("held"))
        .unionByName(tops.where(own & (F.col("event") != "close")).select(*SPLIT, (F.col("seq") - 1).alias("seq"), F.lit(True).alias("held")))
        .unionByName(tops.where(own & ~opened).select(*POSITION, F.lit(False).alias("held")))
    )
    return lexical.span_bits(changes, ends, new_dir(rows.sparkSession, "sampled_bits"))


def sampled_markup(rows: DataFrame, k: int = SAMPLE_STEP, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Tags of the sampled elements: ``element``, their position and ``markup``.

    ``rows`` are ``events``, or staged rows with ``keep_markup``. Texts of tags outside the sample are neither shuffled nor stored.
    """
    kept = lexical.in_spans(rows.select(*POSITION, "event", "name", "id", "markup"), _sampled_bits(rows, k, segment_bits))
    # The n-th sampled element is element k * n of the extract.
    return in_document_order(kept, segment_bits).select((F.col("element") * k).alias("element"), *POSITION, "markup")


def write_sample(
    rows: DataFrame,
    target: str,
    files: int | None = None,
    k: int = SAMPLE_STEP,
    root: str = "map",
    segment_bits: int = SEGMENT_BITS,
) -> None:
    """Writes the sample below ``target`` as ``files`` parts of one markup file, in document order.

    Each part holds a range of the sampled elements; the header is in the first part alone and the footer in the
    last, so the parts joined in order of their names are the sample. An element is never cut: its tags share a
    part, with their original text. By default parts hold about ``TAGS_PER_FILE`` tags, counted in the
    sample itself, which is stored once before. ``root`` is the name of the enclosing element.
    """
    spark = rows.sparkSession
    body = store(sampled_markup(rows, k, segment_bits), new_dir(spark, "sampled"))
    tags, last = body.agg(F.count("*"), F.coalesce(F.max("element"), F.lit(-1))).first()
    files = files or max(1, math.ceil(tags / TAGS_PER_FILE))
    sampled = last // k + 1
    placed = body.select(
        F.expr(f"cast((element div {k}) * {files} div {max(1, sampled)} as int)").alias("part"),
        F.lit(_BODY).alias("rank"), "element", "file", "block", "seq", "markup",
    )
    first, end = (0, _HEADER, f'<?xml version="1.0" encoding="UTF-8"?>\n<{root}>'), (files - 1, _FOOTER, f"</{root}>")
    edges = spark.createDataFrame([first, end], "part INT, rank INT, markup STRING").select(
        "part", "rank", F.lit(0).cast("long").alias("element"), F.lit(0).alias("file"), F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("seq"), "markup")
    (
        placed.unionByName(edges)
        .repartitionById(files, F.col("part"))
        .sortWithinPartitions("rank", "element", "file", "block", "seq")
        .select("markup")
        .write.mode("overwrite").text(target)
    )
