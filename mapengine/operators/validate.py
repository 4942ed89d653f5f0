"""Validation of the five tables, as one more projection over the rows.

Every field is required (an empty string counts as present) and integers and floats must
parse. What happens to a bad row is the caller's choice: set aside, stop, or not checked.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapengine.model import TABLE_KINDS, spark_type
from mapengine.workspace import store

MODES = ("quarantine", "failfast", "off")

# Float spellings Java reads and the checked grammar does not have: hexadecimal, and a
# type suffix after the number.
_NOT_A_FLOAT = r"(?i)0x|[0-9.][df]\s*$"


def _typed(field: str, kind: str) -> Column:
    return _parsed(F.col(field), kind)


def _parsed(value: Column, kind: str) -> Column:
    parsed = value.try_cast(spark_type(kind))
    if kind == "float":
        parsed = F.when(~value.cast("string").rlike(_NOT_A_FLOAT), parsed)
    return parsed


def row_errors(table: str) -> Column:
    """``required:<field>`` and ``type:<field>`` errors of a row; empty for a good row."""
    errors = []
    for field, kind in TABLE_KINDS[table].items():
        error = F.when(F.col(field).isNull(), F.lit(f"required:{field}"))
        if kind != "string":
            error = error.when(_typed(field, kind).isNull(), F.lit(f"type:{field}"))
        errors.append(F.coalesce(error, F.lit("")))
    # Not ``array_compact``: its lambda would keep all expressions beside it from being compiled.
    return F.array_remove(F.array(*errors), "")


def is_wrong(table: str) -> Column:
    """Whether a row has any error, without listing them."""
    bad = [F.col(f).isNull() if kind == "string" else _typed(f, kind).isNull() for f, kind in TABLE_KINDS[table].items()]
    return reduce(lambda a, b: a | b, bad)


def with_errors(rows: DataFrame, table: str) -> DataFrame:
    return rows.withColumn("errors", row_errors(table))


def typed(rows: DataFrame, table: str) -> DataFrame:
    """The typed layer; what does not parse becomes NULL."""
    return rows.select(*[_typed(f, k).alias(f) for f, k in TABLE_KINDS[table].items()])


def quarantine(rows: DataFrame, table: str) -> DataFrame:
    """The bad rows as text, with their errors."""
    return with_errors(rows, table).where(F.size("errors") > 0)


def passing(rows: DataFrame, table: str, mode: str = "quarantine") -> DataFrame:
    """Rows of ``table`` that may go on, still as text.

    ``quarantine`` keeps the good rows (``quarantine()`` gives the others), ``failfast``
    stops the job at the first bad row with its errors in the message, ``off`` keeps all.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if mode == "off":
        return rows
    errors = row_errors(table)
    if mode == "quarantine":
        return rows.where(F.size(errors) == 0)
    message = F.concat(F.lit(f"bad row in {table}: "), F.array_join(errors, ", "))
    return rows.where(F.when(F.size(errors) == 0, True).otherwise(F.raise_error(message)))


def validate(rows: DataFrame, table: str, mode: str = "quarantine") -> DataFrame:
    """The typed layer of the rows that pass."""
    return typed(passing(rows, table, mode), table)


def error_counts(rows: DataFrame, table: str) -> DataFrame:
    """Number of rows per error."""
    return (
        with_errors(rows, table)
        .select(F.explode("errors").alias("error"))
        .groupBy("error").agg(F.count("*").alias("n"))
    )


# --- declared records ---------------------------------------------------------------
#
# A schema is data: field -> rule. A rule has a ``type``: one of the model's kinds, ``dict`` or ``list``. The last two
# have a ``schema`` of their own, a list that of its items. ``required`` fields must not be NULL, and
# fields that the schema does not name must be, unless ``allow_unknown``.

Schema = Mapping[str, Mapping]


def _found(path: Column, error: str) -> Column:
    return F.struct(path.alias("path"), F.lit(error).alias("error"))


def _record_errors(schema: Schema, fields: T.StructType, get: Callable[[str], Column], path: Column, allow_unknown: bool) -> Column:
    """Errors of one record, an ARRAY of ``path, error`` in the order of the schema."""
    own, nested = [], []
    here = lambda name: F.concat(path, F.lit(name))
    for name, rule in schema.items():
        if name not in fields.names:
            own.append(F.when(F.lit(bool(rule.get("required"))), _found(here(name), "required")))
            continue
        value, kind = get(name), rule["type"]
        missing = F.when(value.isNull() & F.lit(bool(rule.get("required"))), _found(here(name), "required"))
        if kind in ("dict", "list"):
            own.append(missing)
            nested.append(_nested_errors(rule, fields[name].dataType, value, here(name)))
        elif kind == "string":
            own.append(missing)
        else:
            own.append(missing.when(value.isNotNull() & _parsed(value, kind).isNull(), _found(here(name), "type")))
    if not allow_unknown:
        own += [F.when(get(n).isNotNull(), _found(here(n), "unknown")) for n in fields.names if n not in schema]
    return F.concat(F.array_compact(F.array(*own)), *nested)


def _nested_errors(rule: Mapping, type_: T.DataType, value: Column, path: Column) -> Column:
    inner, unknown = rule["schema"], bool(rule.get("allow_unknown"))
    none = F.array().cast("array<struct<path:string,error:string>>")
    if rule["type"] == "dict":
        errors = _record_errors(inner, type_, lambda n: value[n], F.concat(path, F.lit(".")), unknown)
        return F.when(value.isNotNull(), errors).otherwise(none)
    each = F.transform(value, lambda item, i: _record_errors(
        inner, type_.elementType, lambda n: item[n], F.concat(path, F.lit("["), i.cast("string"), F.lit("].")), unknown))
    return F.coalesce(F.flatten(each), none)


def record_errors(rows: DataFrame, schema: Schema, allow_unknown: bool = True) -> Column:
    """Errors of every row against a declared schema: an ARRAY of ``path`` (``ways_nodes[3].node_id``) and ``error``
    (``required``, ``type`` or ``unknown``), empty for a good row. Lists are checked where they are, without a shuffle."""
    return _record_errors(schema, rows.schema, F.col, F.lit(""), allow_unknown)


# --- whole elements -----------------------------------------------------------------

# Error of a good row whose element has a bad row elsewhere.
ELEMENT_REJECTED = "element:rejected"

# Fields of all tables; one name has one kind wherever it occurs.
FIELDS = {f: k for kinds in TABLE_KINDS.values() for f, k in kinds.items()}
_PLACE = ("file", "block", "seq")


@dataclass(frozen=True)
class Checked:
    """Rows by table. ``kept`` and ``rejected`` have ``element`` and fields as text, ``typed`` the
    typed layer of the kept rows, ``rejected`` also ``errors``. ``report`` has a row per wrong field."""

    kept: dict[str, DataFrame]
    typed: dict[str, DataFrame]
    rejected: dict[str, DataFrame]
    report: DataFrame


def _as_text(rows: DataFrame, table: str) -> DataFrame:
    """``table_name``, ``element``, the fields of the table as text, and where rows stood."""
    return rows.select(
        F.lit(table).alias("table_name"), "element", *[F.col(f).cast("string").alias(f) for f in TABLE_KINDS[table]],
        *[c for c in _PLACE if c in rows.columns])


def routed(raw: dict[str, DataFrame]) -> DataFrame:
    """Tables with ``element`` as one DataFrame: ``table_name``, ``element``, all fields, and where rows stood."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_as_text(rows, t) for t, rows in raw.items()])
    for name, kind in (*((f, "string") for f in FIELDS), ("file", "int"), ("block", "long"), ("seq", "long")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def _held(field: str) -> Column:
    """Whether the row's own table has the field."""
    return F.col("table_name").isin(*[t for t, kinds in TABLE_KINDS.items() if field in kinds])


def _is_wrong_anywhere() -> Column:
    """``is_wrong`` of rows of all tables, by the rules of the row's own table."""
    bad = [_held(f) & (F.col(f).isNull() if kind == "string" else _typed(f, kind).isNull()) for f, kind in FIELDS.items()]
    return reduce(lambda a, b: a | b, bad)


def _errors_anywhere() -> Column:
    """``row_errors`` of rows of all tables; a field's rule stands once, so the loop stays small enough to compile."""
    errors = []
    for field, kind in FIELDS.items():
        error = F.when(_held(field) & F.col(field).isNull(), F.lit(f"required:{field}"))
        if kind != "string":
            error = error.when(_held(field) & _typed(field, kind).isNull(), F.lit(f"type:{field}"))
        errors.append(F.coalesce(error, F.lit("")))
    return F.array_remove(F.array(*errors), "")


def _mark(wrong: Column, errors: Column, fields: Collection[str]) -> Column:
    """What the report needs of a wrong row, in a column of its own: NULL in all others, so the report reads little else."""
    held = [(F.col(f) if f in fields else F.lit(None).cast("string")).alias(f) for f in ("id", "key", "position")]
    return F.when(wrong, F.struct(*held, errors.alias("errors")))


def _reported(wrong: DataFrame) -> DataFrame:
    """A row per wrong field: where it is in its element, and what is wrong. Paths name a tag by its key, a ref by
    its position."""
    inner = F.coalesce(F.when(F.col("table_name") == "ways_nodes", F.col("position")), F.col("key"))
    path = F.concat(
        "table_name", F.when(F.col("table_name").isin("nodes", "ways"), "").otherwise(F.concat(F.lit("["), F.coalesce(inner, F.lit("")), F.lit("]"))),
        F.lit("."), F.substring_index("error", ":", -1))
    fields = wrong.select("element", "id", "table_name", "key", "position", *_PLACE, F.explode("errors").alias("error"))
    return fields.select("element", "id", "table_name", *_PLACE, path.alias("path"), F.substring_index("error", ":", 1).alias("error"))


def _stop_at_first(report: DataFrame) -> None:
    """Raises with all that is wrong with the first bad element in document order."""
    first = report.orderBy(*[F.col(c).asc_nulls_last() for c in _PLACE], "element", "path").first()
    if first is None:
        return
    own = report.where(F.col("element") == first["element"]).orderBy(*_PLACE, "path").collect()
    ids = [r["id"] for r in own if r["id"] is not None]
    found = ", ".join(f"{r['path']}: {r['error']}" for r in own)
    raise ValueError(f"bad row in {first['table_name']}: element {ids[0] if ids else None} has {found}")


def _check_apart(raw: dict[str, DataFrame], target: str, mode: str) -> Checked:
    """``check_elements`` of tables given apart: every table is parsed and written once, as text, as it comes."""
    written = f"{target}/rows"

    def write(table: str) -> None:
        wrong = F.lit(False) if mode == "off" else is_wrong(table)
        text = _as_text(raw[table], table).drop("table_name")
        store(text.withColumn("wrong", _mark(wrong, row_errors(table), TABLE_KINDS[table])), f"{written}/table_name={table}")

    rows = routed(raw)
    # A table may have fewer tasks than there are cores: the jobs of all fill them together.
    with ThreadPoolExecutor(len(raw)) as jobs:
        list(jobs.map(inheritable_thread_target(rows.sparkSession)(write), raw))
    mark = "struct<id: string, key: string, position: string, errors: array<string>>"
    schema = rows.select("element", *FIELDS, *_PLACE, F.lit(None).cast(mark).alias("wrong"), "table_name").schema
    stored = rows.sparkSession.read.schema(schema).parquet(written)
    marked = stored.where(F.col("wrong").isNotNull()).select("element", "table_name", *_PLACE, "wrong.*")
    report = store(_reported(marked), f"{target}/report")
    if mode == "failfast":
        _stop_at_first(report)
    bad = store(report.select("element").distinct(), f"{target}/bad", "element")
    kept, typed_, rejected = {}, {}, {}
    for t, kinds in TABLE_KINDS.items():
        mine = stored.where(F.col("table_name") == t).select("element", *kinds)
        kept[t] = mine.join(bad, "element", "left_anti")
        typed_[t] = typed(kept[t], t)
        errors = row_errors(t)
        own = F.when(F.size(errors) > 0, errors).otherwise(F.array(F.lit(ELEMENT_REJECTED)))
        rejected[t] = mine.join(bad, "element", "left_semi").select("element", *kinds, own.alias("errors"))
    return Checked(kept, typed_, rejected, report)


def check_elements(raw: dict[str, DataFrame] | DataFrame, target: str, mode: str = "quarantine") -> Checked:
    """Checks elements as a whole: one bad row of an element or of its children rejects them all.

    ``raw`` are tables with ``element``, or all their rows as one DataFrame (``routed``). Of tables given apart, one pass
    parses every field and writes each row once, as text with its own fields, with a mark on the wrong ones; report and bad
    elements come from the marks, and kept rows are told from rejected ones as they are read. Of one DataFrame, one pass finds
    the wrong rows, which are stored and make the report; a second writes all rows once below ``target``, as text and as they
    come, with their verdict: a folder per table and verdict would have the wide rows sorted. The bad elements are joined
    to rows by a side that Spark broadcasts while it is small. ``failfast`` stops with all that is wrong with the first bad
    element in document order; ``off`` rejects nothing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if isinstance(raw, dict):
        return _check_apart(raw, target, mode)
    rows, where = raw.select("table_name", "element", *FIELDS), ("table_name", "element", *_PLACE)
    if mode == "off":
        report = _reported(raw.where(F.lit(False)).withColumn("errors", _errors_anywhere()))
        marked = rows.withColumn("rejected", F.lit(False))
    else:
        # Wrong rows, their errors, a row per error, stored one by one: a loop with more code in it is too large for the JVM to
        # compile. A filter would work out the fields of every row a second time, inside its own condition.
        found = raw.select(F.inline(F.array(F.when(_is_wrong_anywhere(), F.struct(*where, *FIELDS)))))
        wrong = store(found.where(F.col("table_name").isNotNull()), f"{target}/wrong")
        listed = store(wrong.select(*where, "id", "key", "position", _errors_anywhere().alias("errors")), f"{target}/errors")
        report = store(_reported(listed), f"{target}/report")
        if mode == "failfast":
            _stop_at_first(report)
        bad = store(report.select("element").distinct(), f"{target}/bad")
        marked = rows.join(bad.withColumn("rejected", F.lit(True)), "element", "left").withColumn(
            "rejected", F.coalesce("rejected", F.lit(False)))
    stored = store(marked, f"{target}/rows")
    kept, typed_, rejected = {}, {}, {}
    for t, kinds in TABLE_KINDS.items():
        mine = stored.where(F.col("table_name") == t)
        kept[t] = mine.where(~F.col("rejected")).select("element", *kinds)
        typed_[t] = typed(kept[t], t)
        errors = row_errors(t)
        own = F.when(F.size(errors) > 0, errors).otherwise(F.array(F.lit(ELEMENT_REJECTED)))
        rejected[t] = mine.where("rejected").select("element", *kinds, own.alias("errors"))
    return Checked(kept, typed_, rejected, report)
