import re

import pytest

from mapengine.model import RECORDS, TABLES, raw_schema, typed_schema
from mapengine.operators import order, shape, validate
from mapengine.sources import markup
from tests import fixtures as fx
from tests.plans import plan

GOOD = ("1", "1.5", "2", "ann", "11", "2", "7", "2020")


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), raw_schema("nodes"))


def changed(**fields):
    names = raw_schema("nodes").names
    return tuple(fields.get(n, v) for n, v in zip(names, GOOD, strict=True))


@pytest.fixture
def errors(spark):
    def of(*rows):
        checked = validate.with_errors(nodes(spark, *rows).coalesce(1), "nodes")
        return [r.errors for r in checked.collect()]

    return of


def test_errors(errors):
    assert errors(
        GOOD, changed(user=None), changed(id="x1"), changed(user=""), changed(id=str(2 ** 63)),
        changed(id="7.5"), changed(id=" 7 "), changed(id="+7"), changed(id=""),
        changed(id=None, uid="a", timestamp=None),
    ) == [
        [], ["required:user"], ["type:id"], [], ["type:id"], ["type:id"], [], [], ["type:id"],
        ["required:id", "type:uid", "required:timestamp"],
    ]


def test_float_grammar(errors):
    good = ["1", "-1.5", "1e3", " 2.5 ", "nan", "inf", "-inf", "Infinity", ".5", "5."]
    bad = ["1.5f", "1d", "1.0D ", "0x1p3", "one", "", "1,5"]
    assert errors(*[changed(lat=v) for v in good + bad]) == [[]] * len(good) + [["type:lat"]] * len(bad)


def test_quarantine_splits_rows(spark):
    rows = nodes(spark, GOOD, changed(user=None), changed(id="x1"))
    good = validate.validate(rows, "nodes")
    assert good.schema == typed_schema("nodes")
    assert [tuple(r) for r in good.collect()] == [(1, 1.5, 2.0, "ann", 11, "2", 7, "2020")]
    assert validate.quarantine(rows, "nodes").count() == 2
    assert {tuple(r) for r in validate.error_counts(rows, "nodes").collect()} == {
        ("required:user", 1), ("type:id", 1),
    }


def test_failfast_names_the_errors(spark):
    assert validate.validate(nodes(spark, GOOD), "nodes", "failfast").count() == 1
    with pytest.raises(Exception, match="bad row in nodes: required:user, type:uid"):
        validate.validate(nodes(spark, changed(user=None, uid="u")), "nodes", "failfast").collect()


def test_off_keeps_every_row(spark):
    rows = validate.validate(nodes(spark, changed(id="x1")), "nodes", "off").collect()
    assert [r.id for r in rows] == [None]
    with pytest.raises(ValueError, match="mode"):
        validate.validate(nodes(spark, GOOD), "nodes", "maybe")


@pytest.mark.parametrize("table", TABLES)
def test_every_table_has_rules(spark, table):
    schema = raw_schema(table)
    rows = spark.createDataFrame([tuple([None] * len(schema)), tuple(["1"] * len(schema))], schema)
    found = sorted(len(r.errors) for r in validate.with_errors(rows, table).collect())
    assert found == [0, len(schema)]


def test_declared_records(spark):
    """Nested lists, missing and unknown fields, with paths."""
    rows = spark.createDataFrame(
        [(1, ("5", "u", None, "x"), [("5", "1", "0"), ("5", "r", None)], None), (2, None, [], [("5", "k", None, "regular", "more")])],
        "i int, ways struct<id string, user string, uid string, color string>, ways_nodes array<struct<id string, node_id string, position string>>,"
        "ways_tags array<struct<id string, key string, value string, type string, extra string>>")
    schema = {t: RECORDS[t] for t in ("ways", "ways_nodes", "ways_tags")}
    found = rows.select("i", validate.record_errors(rows.drop("i"), schema).alias("e")).orderBy("i").collect()
    assert [[(e.path, e.error) for e in r.e] for r in found] == [
        [("ways.uid", "required"), ("ways.version", "required"), ("ways.changeset", "required"), ("ways.timestamp", "required"),
         ("ways.color", "unknown"), ("ways_nodes[1].node_id", "type"), ("ways_nodes[1].position", "required")],
        [("ways_tags[0].value", "required"), ("ways_tags[0].extra", "unknown")],
    ]
    loose = {"ways": {"type": "dict", "allow_unknown": True, "required": True, "schema": {"id": {"type": "float"}, "none": {"type": "string"}}}}
    assert [[(e.path, e.error) for e in r[0]] for r in rows.orderBy("i").select(validate.record_errors(rows, loose)).collect()] == [
        [], [("ways", "required")]]
    strict = rows.select(validate.record_errors(rows, loose, allow_unknown=False).alias("e")).first().e
    assert ("i", "unknown") in [(e.path, e.error) for e in strict]


@pytest.mark.parametrize("table", TABLES)
def test_declared_records_agree_with_rows(spark, table):
    rows = spark.createDataFrame([tuple([None] * len(raw_schema(table))), tuple(["x"] * len(raw_schema(table)))], raw_schema(table))
    found = rows.select(
        validate.row_errors(table).alias("flat"), validate.record_errors(rows, RECORDS[table]["schema"]).alias("nested")).collect()
    for r in found:
        assert r.flat == [f"{e.error}:{e.path}" for e in r.nested]


def dirty(spark):
    """Five tables: element 2 has a wrong tag, 4 a wrong id and user, 3 a wrong ref; 1 and 6 are good."""
    def of(table, *rows):
        return spark.createDataFrame([(e, *fields) for e, fields in rows], "element long, " + ", ".join(f"{f} string" for f in raw_schema(table).names))

    return {
        "nodes": of("nodes", (2, GOOD), (4, changed(id="x", user=None)), (6, GOOD)),
        "nodes_tags": of("nodes_tags", (2, ("1", "name", None, "regular")), (2, ("1", "a", "b", "regular")), (6, ("1", "a", "b", "regular"))),
        "ways": of("ways", (1, ("1", "u", "2", "1", "3", "s")), (3, ("3", "u", "2", "1", "3", "s"))),
        "ways_nodes": of("ways_nodes", (1, ("1", "5", "0")), (3, ("3", "r", "0")), (3, ("3", "6", "1"))),
        "ways_tags": of("ways_tags", (3, ("3", "k", "v", "regular"))),
    }


def outcome(found):
    rows = lambda df: sorted(map(repr, df.collect()))
    parts = [{t: rows(df) for t, df in part.items()} for part in (found.kept, found.typed, found.rejected)]
    return [*parts, rows(found.report.select("element", "id", "table_name", "path", "error"))]


@pytest.mark.parametrize("mode", ["quarantine", "off"])
def test_tables_apart_and_together_give_the_same(spark, tmp_path, mode):
    apart = validate.check_elements(dirty(spark), str(tmp_path / "apart"), mode)
    together = validate.check_elements(validate.routed(dirty(spark)), str(tmp_path / "together"), mode)
    assert outcome(apart) == outcome(together)
    assert [r.element for r in apart.kept["nodes"].orderBy("element").collect()] == ([6] if mode == "quarantine" else [2, 4, 6])
    assert {t: df.schema for t, df in apart.typed.items()} == {t: typed_schema(t) for t in TABLES}


def test_tables_apart_are_written_once_as_they_come(spark, tmp_path, monkeypatch):
    """Own fields only, no sort, and nothing that keeps the loop over the rows from being compiled."""
    stored, store = {}, validate.store
    monkeypatch.setattr(validate, "store", lambda rows, target, *layout: stored.update({target.rsplit("/", 1)[-1]: (rows, layout)}) or store(rows, target, *layout))
    validate.check_elements(dirty(spark), str(tmp_path / "run"))
    for table in TABLES:
        rows, layout = stored[f"table_name={table}"]
        assert rows.columns == ["element", *raw_schema(table).names, "wrong"]
        assert not layout and "lambda" not in plan(rows)
    # The report is read from the marks, not worked out of the tables again.
    assert "ReadSchema: struct<element:bigint,file:int,block:bigint,seq:bigint,wrong:struct<" in plan(stored["report"][0])


def loop_bytes(df):
    """Bytes of the longest generated method; the JVM compiles none of more than 8,000."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))), default=0)


def test_rows_together_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """As text, as they come, with their verdict; nothing keeps the loops over the rows from being compiled."""
    stored, store = {}, validate.store
    monkeypatch.setattr(validate, "store", lambda rows, target, *layout: stored.update({target.rsplit("/", 1)[-1]: (rows, layout)}) or store(rows, target, *layout))
    validate.routed(dirty(spark)).write.parquet(str(tmp_path / "given"))
    found = validate.check_elements(spark.read.parquet(str(tmp_path / "given")), str(tmp_path / "run"))
    rows, layout = stored["rows"]
    assert set(rows.columns) == {"table_name", "element", *validate.FIELDS, "rejected"}
    assert not layout and "Sort " not in plan(rows)
    assert not any("lambda" in plan(df) for df, _ in stored.values())
    assert all(0 < loop_bytes(stored[name][0]) < 8000 for name in ("wrong", "errors", "report"))
    # Kept rows are read as they are, without a join.
    assert not any("Join" in plan(df) for df in (*found.kept.values(), *found.typed.values()))


def test_wrong_rows_of_an_extract_are_found_in_a_compiled_loop(spark, tmp_path, monkeypatch):
    """The fields of the extract's rows, which take patterns, are not worked out again inside a condition."""
    source = tmp_path / "map.xml"
    source.write_text(fx.document(fx.node(1), fx.node("x2"), fx.way(9, children=[fx.nd("z")])))
    staged = markup.stage_events(spark, str(source), str(tmp_path / "staged"))
    rows = shape.routed(markup.elements(staged), order.store_children(staged, str(tmp_path / "children")))
    stored, store = {}, validate.store
    monkeypatch.setattr(validate, "store", lambda rows, target, *layout: stored.update({target.rsplit("/", 1)[-1]: rows}) or store(rows, target, *layout))
    found = validate.check_elements(rows, str(tmp_path / "run"))
    assert sorted((r.id, r.path) for r in found.report.collect()) == [("9", "ways_nodes[0].node_id"), ("x2", "nodes.id")]
    assert 0 < loop_bytes(stored["wrong"]) < 8000
