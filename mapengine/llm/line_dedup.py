"""Line dedup: lines that many documents share stay in one document only.

Method: levelled sorted runs of line hashes. A batch of lines becomes a run, one row per key
(128-bit hash, number of documents, largest document id), sorted by hash. ``fanout`` runs of
one level are merged into one run of the next. To find what a batch may keep, its lines
merge-anti-join the runs. Runs hold hashes and counts only, so they are a small part of the
text, and every line is hashed once.

The number of documents of a key is known when all batches are in, so ``dedup_lines`` adds
every batch first and anti-joins then. ``LineRuns.unseen`` and ``LineRuns.add`` serve a
stream of batches, in which the first batch to bring a line keeps it.

A key that a third of all documents hold is counted map-side and is one row of a run. In the
anti-join its lines stand on the left, whose large partitions adaptive execution splits, or
which is not shuffled at all while Spark's own size check lets it broadcast the few keys that
many documents share.

Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapengine.llm.common import BLANKS, ascii_lower, col, text_of, unused
from mapengine.workspace import new_dir, remove, store

KEY = ("h1", "h2")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def hashed_lines(docs: DataFrame, min_chars: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with a key of at least ``min_chars`` code points: ``doc, th, pos, h1, h2``.

    ``th`` is a hash of the whole text; with ``doc`` it tells rows apart that share an id.
    """
    lines = docs.select(
        col(id).alias("doc"), F.xxhash64(text_of(text)).alias("th"),
        F.posexplode(lines_of(ascii_lower(text_of(text)))).alias("pos", "line"),
    ).select("doc", "th", "pos", _stripped(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        "doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


class LineRuns:
    """Levels of sorted runs: ``h1, h2, docs`` (documents that hold it) and ``last`` (largest id)."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self._schema = None

    def _write(self, rows: DataFrame, level: int) -> None:
        path = new_dir(self.spark, f"run{level}")
        self._schema = store(rows, path, *KEY).schema
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(*paths)

    def _merged(self, paths: list[str]) -> DataFrame:
        rows = self._read(paths)
        if len(paths) == 1:
            return rows
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def _compact(self, level: int) -> None:
        old = self.levels[level]
        self._write(self._merged(old), level + 1)
        self.levels[level] = []
        remove(self.spark, *old)

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of ``hashed_lines`` as a run. No document may be in two batches.

        Copies of a line within a document count once, also if rows share a document id.
        """
        counted = (
            lines.select(*KEY, "doc").distinct()
            .groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        )
        self._write(counted, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def keys(self, min_docs: int = 1) -> DataFrame:
        """All keys in at least ``min_docs`` documents, merged over the runs."""
        paths = [p for level in self.levels for p in level]
        return self._merged(paths).where(F.col("docs") >= min_docs)

    def compact(self) -> None:
        """Merges all runs into one."""
        paths = [p for level in self.levels for p in level]
        if len(paths) > 1:
            top = len(self.levels)
            self._write(self._merged(paths), top)
            self.levels[:top] = [[] for _ in range(top)]
            remove(self.spark, *paths)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines of a new batch that no run holds."""
        paths = [p for level in self.levels for p in level]
        return lines.join(self._read(paths), list(KEY), "left_anti") if paths else lines

    def kept(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """Lines that stay: held by fewer than ``min_docs`` documents, or by no larger id."""
        keys = self.keys(min_docs).select(
            F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("last")
        )
        found = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
        return lines.join(keys, found & ~F.col("doc").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), "left_anti")


def dedup_lines(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = 4,
    fanout: int = 4,
) -> DataFrame:
    """``docs`` with their remaining lines in ``text``, and ``n_lines`` and ``n_dropped``.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold loses all its lines
    but those in the largest document id holding it. Other lines stay, joined by line feeds.

    NULL or empty text is one empty line and stays as empty text. Rows that share an id count
    as one document, and so do rows without an id; where only rows without id hold a key,
    its lines stay. Rows are neither added nor lost. An empty table gives an empty table.
    Other columns pass unchanged; should ``docs`` have columns ``n_lines`` or ``n_dropped``,
    these are replaced. A document is handled whole by one task, whatever its length.
    """
    spark = docs.sparkSession
    spread = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    path = new_dir(spark, "lines")
    lines = hashed_lines(docs, min_chars, id, text)
    lines.withColumn("batch", spread).write.partitionBy("batch").parquet(path)
    batched = T.StructType([*lines.schema.fields, T.StructField("batch", T.IntegerType())])
    lines = spark.read.schema(batched).parquet(path)
    runs = LineRuns(spark, fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).drop("batch"))
    runs.compact()
    kept = (
        runs.kept(lines.drop("batch"), min_docs)
        .groupBy("doc", "th").agg(F.collect_set("pos").alias("kept"))
    )
    doc, th, pos, th0 = unused(docs, "kept_doc", "kept_th", "kept_pos", "text_th")
    kept = kept.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("kept").alias(pos))
    joined = docs.withColumn(th0, F.xxhash64(text_of(text))).join(
        kept, col(id).eqNullSafe(col(doc)) & (col(th0) == col(th)), "left"
    )
    every, stay = unused(joined, "all_lines", "stay")
    short = F.filter(
        F.sequence(F.lit(0), F.size(col(every)) - 1),
        lambda i: F.char_length(_stripped(F.get(col(every), i))) < min_chars,
    )
    stays = F.array_sort(F.concat(short, F.coalesce(col(pos), F.array().cast("array<int>"))))
    text_left = F.array_join(F.transform(col(stay), lambda i: F.get(col(every), i)), "\n")
    new = {"n_lines": F.size(col(every)).cast("long"), "n_dropped": (F.size(col(every)) - F.size(col(stay))).cast("long")}
    others = [c for c in docs.columns if c.lower() not in new]
    return (
        joined.withColumn(every, lines_of(text_of(text))).withColumn(stay, stays)
        .select(*[(text_left if c == text else col(c)).alias(c) for c in others], *[v.alias(k) for k, v in new.items()])
    )
