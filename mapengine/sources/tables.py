"""CSV and catalog tables of the five record types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapengine.model import TABLE_KINDS, TABLES, raw_schema, typed_schema
from mapengine.workspace import exists, remove, store

# Stands for NULL in a CSV file. XML text cannot hold this character, and the scan stops on it,
# so no value read from markup can be mistaken for it; an empty string stays an empty string.
NULL_MARK = "\u0001"

# Quotes are doubled, as spreadsheet programs do, and blanks and line ends are kept.
_CSV = {
    "header": "true",
    "encoding": "UTF-8",
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": NULL_MARK,
}

# A CSV file whose values may hold line feeds is read by one task, so files are kept small.
ROWS_PER_FILE = 1_000_000

# Sort columns of the stored tables: questions ask for one key, or one value, at a time.
_LAYOUT = {
    "nodes": ("id",),
    "nodes_tags": ("key", "value"),
    "ways": ("id",),
    "ways_nodes": ("id", "position"),
    "ways_tags": ("key", "value"),
}


def write_csv(
    tables: Mapping[str, DataFrame], target: str, rows_per_file: int = ROWS_PER_FILE, compression: str | None = None
) -> None:
    """Writes each table to its own directory below ``target``, header in every file.

    ``compression`` is a codec of Spark's text files, such as ``gzip``; ``read_csv`` knows it by the names of the files. As
    no file is read by more than one task anyway, it costs no parallelism.
    """
    for name, rows in tables.items():
        (
            rows.select(*TABLE_KINDS[name])
            .write.mode("overwrite").options(**_CSV)
            .option("maxRecordsPerFile", rows_per_file).option("compression", compression or "none")
            .csv(f"{target}/{name}")
        )


def read_csv(spark: SparkSession, source: str, name: str, typed: bool = False) -> DataFrame:
    """Reads one table back. The header is checked against the field names, never loaded."""
    schema = typed_schema(name) if typed else raw_schema(name)
    return (
        spark.read.schema(schema).options(**_CSV)
        .option("mode", "FAILFAST").option("enforceSchema", "false")
        .csv(f"{source}/{name}")
    )


def read_all_csv(spark: SparkSession, source: str, typed: bool = False) -> dict[str, DataFrame]:
    return {name: read_csv(spark, source, name, typed) for name in TABLES}


# --- tables of the catalog ----------------------------------------------------------
#
# A table is a view of a folder with all its versions. Which version counts is said by a log that
# all tables below one location share, and one appended file of that log is the only step that makes a load
# visible, for all its tables at once. What an interrupted load has written has no line in the log; the
# next load takes the same number and writes over it.

_LOG = "_loads"
_ROOT = "load_root"


def _store(rows: DataFrame, name: str, path: str) -> DataFrame:
    return store(rows.select(*TABLE_KINDS[name]), path, *_LAYOUT[name])


def _version(spark: SparkSession, location: str) -> int:
    """The number of the last load, 0 before the first. Starts the log."""
    if not exists(spark, f"{location}/{_LOG}"):
        _commit(spark, location, 0, [""])
    return spark.read.parquet(f"{location}/{_LOG}").agg(F.max("version")).first()[0]


def _commit(spark: SparkSession, location: str, version: int, names: Sequence[str]) -> None:
    """Makes a version of the named tables the one that counts: one task, one file, renamed into the log."""
    lines = spark.createDataFrame([(version, n) for n in names], "version INT, table_name STRING")
    lines.coalesce(1).write.mode("append").parquet(f"{location}/{_LOG}")


def _show(spark: SparkSession, name: str, full: str, location: str) -> None:
    """Creates the view of a table, unless it is there. A table of that name that is no such view is dropped."""
    if spark.catalog.tableExists(full):
        if spark.catalog.getTable(full).tableType != "VIEW":
            spark.sql(f"DROP TABLE {full}")
        elif any(r[0] == _ROOT and r[1] == location for r in spark.sql(f"SHOW TBLPROPERTIES {full}").collect()):
            return
    fields = ", ".join(f"`{f}`" for f in TABLE_KINDS[name])
    spark.sql(
        f"CREATE OR REPLACE VIEW {full} TBLPROPERTIES ('{_ROOT}' = '{location}') AS SELECT {fields} FROM parquet.`{location}/{name}` "
        f"WHERE version = (SELECT max(version) FROM parquet.`{location}/{_LOG}` WHERE table_name = '{name}')")


def load_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    location: str,
    database: str | None = None,
) -> dict[str, DataFrame]:
    """Replaces the named tables of the catalog by ``tables``, stored as Parquet below ``location``, in one step.

    All are written as a new version; then one line of a log makes it the version that counts. A load that
    fails anywhere leaves all old tables or all new ones. Rows may come from the tables they replace. Loads
    into one location go one at a time. Only a load into another location than the last, or over tables that
    are no views of a location, creates its views one by one, before its step. Versions stay until ``forget``.
    """
    version = _version(spark, location) + 1
    for name, rows in tables.items():
        _store(rows, name, f"{location}/{name}/version={version}")
    full = {name: name if database is None else f"{database}.{name}" for name in tables}
    for name in tables:
        _show(spark, name, full[name], location)
    _commit(spark, location, version, list(tables))
    return {name: spark.table(full[name]) for name in tables}


def forget(spark: SparkSession, location: str) -> None:
    """Deletes all versions below ``location`` that no longer count."""
    log = spark.read.parquet(f"{location}/{_LOG}").where("version > 0")
    last = log.groupBy("table_name").agg(F.max("version").alias("last"))
    old = log.join(last, "table_name").where("version < last").distinct().collect()
    remove(spark, *[f"{location}/{r['table_name']}/version={r['version']}" for r in old])
