"""The whole chain: extract -> staged rows -> five tables -> answers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mapengine import workspace
from mapengine.model import TABLES
from mapengine.operators import analytics, order, profile, shape, validate
from mapengine.sources import markup, tables


@dataclass(frozen=True)
class Wrangled:
    """Results of one run. Everything is a DataFrame over stored Parquet.

    ``tags`` are raw tags of points and paths, ``text`` the rows that passed validation with
    values as in the markup, ``tables`` the same rows typed, ``rejects`` the others. An element
    is rejected as a whole, with all its children. ``report`` has a row per wrong field. All five tables are
    read from one store, written in one pass.
    """

    staged: DataFrame
    tags: DataFrame
    text: dict[str, DataFrame]
    tables: dict[str, DataFrame]
    rejects: dict[str, DataFrame]
    report: DataFrame

    def profiles(self) -> dict[str, DataFrame]:
        """The six profiles, from facts that one scan of the staged rows and one of the tags have given."""
        found = profile.facts(markup.elements(self.staged), self.tags)
        return profile.profiles(workspace.store(found, workspace.new_dir(found.sparkSession, "profiles")))

    def answers(self) -> dict[str, DataFrame]:
        """The ten standard questions, from facts that one scan of every table has given."""
        found = analytics.facts(self.tables)
        return analytics.answered(workspace.store(found, workspace.new_dir(found.sparkSession, "answers")))

    def write_csv(self, target: str) -> None:
        """The five tables as CSV, with numbers as they were spelled in the markup."""
        tables.write_csv(self.text, target)


def wrangle(
    spark: SparkSession,
    path: str | Sequence[str],
    target: str | None = None,
    mode: str = "quarantine",
    segment_bits: int = order.SEGMENT_BITS,
) -> Wrangled:
    """Parses, shapes, validates and stores an extract.

    The markup is parsed once and the children are assigned to their parents once; both
    results are written below ``target`` (by default a new folder in the shared one), so a
    lost executor costs a re-read of Parquet and never a second parse.
    """
    target = target or workspace.new_dir(spark, "wrangle")
    staged = markup.stage_events(spark, path, f"{target}/staged")
    children = order.store_children(staged, f"{target}/children", segment_bits)
    rows = shape.routed(markup.elements(staged), children)
    found = validate.check_elements(rows, f"{target}/checked", mode)
    return Wrangled(
        staged, shape.raw_tags(children), {t: rows.drop("element") for t, rows in found.kept.items()}, found.typed,
        {t: rows.drop("element") for t, rows in found.rejected.items()}, found.report,
    )
