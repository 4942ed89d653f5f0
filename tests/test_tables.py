import pytest
from pyspark.sql import functions as F

from mapengine.model import TABLE_KINDS, raw_schema, typed_schema
from mapengine.operators import analytics, order, profile, shape
from mapengine.plans.wrangle import wrangle
from mapengine.sources import extract, lexical, markup, tables
from tests import fixtures as fx
from tests.plans import final_plan

AWKWARD = ["", " outer ", 'q"u"o', '"', "a,b", "line\nfeed", "\\N", "back\\slash", "\\\"", "é€𝄞", "cr\rlf\r\n",
           "NULL", "null", "''", "tab\t", "#x"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [(str(i), v, v, "regular") for i, v in enumerate(AWKWARD)] + [("99", None, None, None)]
    df = spark.createDataFrame(rows, raw_schema("nodes_tags"))
    tables.write_csv({"nodes_tags": df}, str(tmp_path), rows_per_file=3)
    back = tables.read_csv(spark, str(tmp_path), "nodes_tags")
    assert rows_of(back) == sorted(rows, key=repr)
    assert len(list((tmp_path / "nodes_tags").glob("*.csv"))) > 3


def test_compressed_csv_round_trip_keeps_text(spark, tmp_path):
    rows = [(str(i), v, v, "regular") for i, v in enumerate(AWKWARD * 20)]
    df = spark.createDataFrame(rows, raw_schema("nodes_tags"))
    tables.write_csv({"nodes_tags": df}, str(tmp_path / "packed"), rows_per_file=30, compression="gzip")
    tables.write_csv({"nodes_tags": df}, str(tmp_path / "plain"), rows_per_file=30)
    assert rows_of(tables.read_csv(spark, str(tmp_path / "packed"), "nodes_tags")) == sorted(rows, key=repr)
    sizes = {n: [f.stat().st_size for f in (tmp_path / n / "nodes_tags").glob("part-*")] for n in ("packed", "plain")}
    assert len(sizes["packed"]) == len(sizes["plain"]) and sum(sizes["packed"]) < sum(sizes["plain"]) / 2


def test_csv_files_have_a_checked_header_in_field_order(spark, tmp_path):
    df = spark.createDataFrame([("addr", "30043", "postcode", "1")], "type STRING, value STRING, key STRING, id STRING")
    tables.write_csv({"ways_tags": df.coalesce(1)}, str(tmp_path))
    (file,) = (tmp_path / "ways_tags").glob("*.csv")
    assert file.read_text() == "id,key,value,type\n1,postcode,30043,addr\n"
    assert tables.read_csv(spark, str(tmp_path), "ways_tags", typed=True).schema == typed_schema("ways_tags")
    other = tmp_path / "other" / "ways_tags"
    other.mkdir(parents=True)
    (other / "swapped.csv").write_text("id,value,key,type\n1,a,b,c\n")
    with pytest.raises(Exception, match="header"):
        tables.read_csv(spark, str(other.parent), "ways_tags").collect()


def test_load_replaces(spark, tmp_path):
    first = {"ways_nodes": spark.createDataFrame([(1, 2, 0), (1, 3, 1)], typed_schema("ways_nodes"))}
    second = {"ways_nodes": spark.createDataFrame([(7, 8, 0)], typed_schema("ways_nodes"))}
    tables.load_tables(spark, first, str(tmp_path))
    loaded = tables.load_tables(spark, second, str(tmp_path))
    assert rows_of(spark.table("ways_nodes")) == rows_of(loaded["ways_nodes"]) == [(7, 8, 0)]
    assert "version#" in final_plan(loaded["ways_nodes"]).split("PartitionFilters")[1].split("]")[0]
    tables.forget(spark, str(tmp_path))
    assert rows_of(spark.table("ways_nodes")) == [(7, 8, 0)]
    assert [p.name for p in (tmp_path / "ways_nodes").iterdir()] == ["version=2"]
    spark.sql("DROP VIEW ways_nodes")


def test_load_over_plain_tables(spark, tmp_path):
    spark.createDataFrame([(5, 5, 5)], typed_schema("ways_nodes")).write.saveAsTable("ways_nodes")
    rows = {"ways_nodes": spark.createDataFrame([(7, 8, 0)], typed_schema("ways_nodes"))}
    assert rows_of(tables.load_tables(spark, rows, str(tmp_path))["ways_nodes"]) == [(7, 8, 0)]
    moved = tables.load_tables(spark, rows, str(tmp_path / "moved"))["ways_nodes"]
    assert rows_of(moved) == [(7, 8, 0)]
    spark.sql("DROP VIEW ways_nodes")


def test_a_load_that_fails_leaves_all_old_tables(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS half_loaded")
    old = {t: spark.createDataFrame([tuple([1] * len(TABLE_KINDS[t]))], raw_int_schema(t)) for t in TABLE_KINDS}
    tables.load_tables(spark, old, str(tmp_path), "half_loaded")
    new = {t: df.limit(0) for t, df in old.items()}
    new["ways_tags"] = old["ways_tags"].withColumn("value", F.raise_error(F.lit("no fifth table")).cast("int"))
    with pytest.raises(Exception, match="no fifth table"):
        tables.load_tables(spark, new, str(tmp_path), "half_loaded")
    assert [spark.table(f"half_loaded.{t}").count() for t in TABLE_KINDS] == [1] * 5
    spark.sql("DROP DATABASE half_loaded CASCADE")


@pytest.mark.parametrize("step, call", [("_store", 0), ("_store", 4), ("_show", 0), ("_show", 3), ("_commit", 0)])
@pytest.mark.parametrize("after", [False, True])
def test_a_load_stopped_between_any_two_steps(spark, tmp_path, monkeypatch, step, call, after):
    """All five tables are old or all are new, and the next load succeeds."""
    database = f"stopped_{step}_{call}_{after}".lower()
    spark.sql(f"CREATE DATABASE {database}")
    of = lambda n: {t: spark.createDataFrame([tuple([n] * len(TABLE_KINDS[t]))], raw_int_schema(t)) for t in TABLE_KINDS}
    seen = lambda: [spark.table(f"{database}.{t}").first()[0] for t in TABLE_KINDS]
    tables.load_tables(spark, of(1), str(tmp_path), database)
    real, calls = getattr(tables, step), []

    def stopped(*args):
        calls.append(1)
        if len(calls) == call + 1 and not after:
            raise RuntimeError("stopped")
        real(*args)
        if len(calls) == call + 1:
            raise RuntimeError("stopped")

    monkeypatch.setattr(tables, step, stopped)
    with pytest.raises(RuntimeError, match="stopped"):
        tables.load_tables(spark, of(2), str(tmp_path), database)
    assert seen() == ([2] * 5 if step == "_commit" and after else [1] * 5)
    monkeypatch.setattr(tables, step, real)
    tables.load_tables(spark, of(3), str(tmp_path), database)
    assert seen() == [3] * 5
    spark.sql(f"DROP DATABASE {database} CASCADE")


def raw_int_schema(table):
    return ", ".join(f"`{f}` INT" for f in TABLE_KINDS[table])


def test_load_from_the_replaced_table(spark, tmp_path):
    rows = {"ways_nodes": spark.createDataFrame([(1, 2, 0), (1, 3, 1)], typed_schema("ways_nodes"))}
    old = tables.load_tables(spark, rows, str(tmp_path))["ways_nodes"]
    tables.load_tables(spark, {"ways_nodes": old.where("position = 1")}, str(tmp_path))
    assert rows_of(spark.table("ways_nodes")) == [(1, 3, 1)]
    spark.sql("DROP VIEW ways_nodes")


@pytest.mark.parametrize("files", [1, 3, 50])
def test_sampled_extract(spark, tmp_path, files):
    """Parts joined in order of their names are one document in document order."""
    source = tmp_path / "map.xml"
    source.write_text(fx.document(*[
        [fx.node, fx.way, fx.relation][i % 3](i, children=[fx.tag("k", f"a &amp; > {i}"), fx.nd(i)] if i % 2 else [])
        for i in range(95)
    ]))
    rows = markup.events(spark, str(source))
    extract.write_sample(rows, str(tmp_path / "out"), files, k=10, segment_bits=3)
    parts = sorted((tmp_path / "out").glob("part-*"))
    from xml.etree import ElementTree
    root = ElementTree.fromstring("".join(p.read_text() for p in parts))
    assert root.tag == "map" and len(parts) <= files
    assert sum("<?xml" in p.read_text() for p in parts) == sum("</map>" in p.read_text() for p in parts) == 1
    assert [e.get("id") for e in root] == [str(i) for i in range(0, 95, 10)]
    for e in root:
        assert len(e) == (2 if int(e.get("id")) % 2 else 0)
        assert all(t.get("v") == f"a & > {e.get('id')}" for t in e.iter("tag"))
    back = markup.events(spark, str(tmp_path / "out"))
    index = order.element_index(back).orderBy("element")
    assert [(r.element, r.id) for r in index.collect()] == [(n, str(i)) for n, i in enumerate(range(0, 95, 10))]


@pytest.mark.parametrize("sent", [1 << 18, 0])
@pytest.mark.parametrize("split", ["2k", "128m"])
@pytest.mark.parametrize("k", [1, 3])
def test_texts_outside_the_sample_are_not_folded(spark, tmp_path, monkeypatch, split, sent, k):
    """Elements may run over many splits and segments; what is stored on the way holds texts of the sample alone."""
    counts = [300 if i in (3, 7, 9, 24) else i % 4 for i in range(40)]
    elements = [[fx.node, fx.way, fx.relation][i % 3](i, children=[fx.nd(j) for j in range(n)]) for i, n in enumerate(counts)]
    (tmp_path / "map.xml").write_text(fx.document(*elements, fx.tag("stray", "x"), fx.node(99)))
    monkeypatch.setattr(lexical, "MAX_SENT", sent)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", split)
    try:
        rows = markup.stage_events(spark, str(tmp_path / "map.xml"), str(tmp_path / "staged"), keep_markup=True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (rows.select("block").distinct().count() > 10) == (split == "2k")
    stored = []
    real = order.store
    monkeypatch.setattr(order, "store", lambda df, target, *layout: stored.append(real(df, target, *layout)) or stored[-1])
    found = extract.sampled_markup(rows, k, 3).orderBy("element", *markup.POSITION).collect()
    text = "".join(r.markup for r in found)
    # Tags of an element: its own one or two, and its children's.
    want = [i for i in [*range(40), 40] if i % k == 0]
    assert sorted({r.element for r in found}) == want
    sizes = {e: sum(r.element == e for r in found) for e in want}
    assert sizes == {e: 1 if e == 40 or not counts[e] else counts[e] + 2 for e in want}
    assert text.count("<nd ") == sum(counts[e] for e in want if e < 40) and "stray" not in text
    folded = [df.count() for df in stored if "markup" in df.columns]
    assert folded == [len(found)]


def test_sample_of_nothing(spark, tmp_path):
    (tmp_path / "map.xml").write_text(fx.document())
    extract.write_sample(markup.events(spark, str(tmp_path / "map.xml")), str(tmp_path / "out"), files=2)
    back = markup.events(spark, str(tmp_path / "out"))
    assert [r.name for r in markup.elements(back).collect()] == ["map"]


def test_sample_of_everything_keeps_all_children(spark, tmp_path):
    source = tmp_path / "map.xml"
    source.write_text(fx.small())
    rows = markup.events(spark, str(source))
    extract.write_sample(rows, str(tmp_path / "out"), files=2, k=1)
    back = markup.events(spark, str(tmp_path / "out"))
    same = ["name", *markup.ATTRIBUTES]
    inside = "name NOT IN ('map', 'bounds')"
    assert rows_of(markup.elements(back).where(inside).select(same)) == rows_of(
        markup.elements(rows).where(inside).select(same)
    )


@pytest.fixture
def city(tmp_path):
    """A small extract with every kind of trouble the shaping rules know."""
    phone = "(404) 555-1234"
    source = tmp_path / "city.xml"
    source.write_text(fx.document(
        fx.node(1, lat="1.50", children=[fx.tag("phone", phone), fx.tag("telephone", phone), fx.tag("fax", phone),
                             fx.tag("contact:Phone", "1404"), fx.tag("phone.x", phone)]),
        fx.node(2, children=[fx.tag("addr:postcode", "30043"), fx.tag("zip", "30099"),
                             fx.tag("addr:street", "Main St."), fx.tag("amenity", "restaurant"),
                             fx.tag("cuisine", "thai")]),
        fx.way(3, children=[fx.nd(1), fx.tag("phone", phone), fx.nd(2), fx.tag("addr:postcode", "30301"),
                            fx.tag("addr:street", "Elm Street"), fx.nd(1)]),
        fx.way(4, children=[fx.tag("addr:postcode", "30043"), fx.tag("addr:postcode", "31401")]),
        fx.relation(5, children=[fx.tag("addr:postcode", "30044"), fx.tag("phone", phone)]),
        '<node id="x6" version="1" changeset="1" timestamp="t" user="u" uid="1" lat="1" lon="1"/>',
        '<node id="7" version="1" changeset="1" timestamp="t" uid="1" lat="1" lon="1"/>',
    ))
    return str(source)


def test_wrangle(spark, city, tmp_path):
    run = wrangle(spark, city, str(tmp_path / "run"))
    assert rows_of(run.tables["nodes_tags"].where("id = 1")) == [
        (1, "contact:Phone", "1404", "regular"), (1, "fax", "(404) 555-1234", "regular"),
        (1, "phone", "404-555-1234", "regular"), (1, "telephone", "404-555-1234", "regular"),
    ]
    assert rows_of(run.tables["ways_tags"].where("key = 'phone'")) == [(3, "phone", "(404) 555-1234", "regular")]
    assert rows_of(run.tables["ways_nodes"]) == [(3, 1, 0), (3, 1, 2), (3, 2, 1)]
    assert [r.id for r in run.tables["ways"].orderBy("id").collect()] == [3, 4]
    assert [r.id for r in run.tables["nodes"].orderBy("id").collect()] == [1, 2]
    assert rows_of(run.rejects["nodes"].select("id", "errors")) == [("7", ["required:user"]), ("x6", ["type:id"])]
    for name, df in run.tables.items():
        assert df.columns == list(TABLE_KINDS[name])

    profiles = {k: rows_of(df) for k, df in run.profiles().items()}
    assert profiles["audit_street_types"] == [("St.", "Main St.")]
    assert profiles["audit_zipcodes"] == [("30043",)]
    assert profiles["audit_phone"] == [("(404) 555-1234", "404-555-1234")]
    assert ("relation", 1) in profiles["count_tags"]

    run.write_csv(str(tmp_path / "csv"))
    back = tables.read_all_csv(spark, str(tmp_path / "csv"))
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in run.tables.items()}
    assert back["nodes"].where("id = '1'").first().lat == "1.50"

    answers = {k: [tuple(r) for r in df.collect()] for k, df in run.answers().items()}
    assert answers["top_postcodes"] == [("30043", 2), ("30301", 1), ("31401", 1)]
    assert answers["top_phones"] == [("(404) 555-1234", 1), ("404-555-1234", 1)]
    assert answers["count_nodes"] == [(2,)] and answers["count_ways"] == [(2,)]
    assert answers["top_users"] == [("ann", 4)]
    assert answers["cuisines"] == [("thai", 1)]


def test_profiles_and_answers_in_one_scan(spark, city, tmp_path):
    """Equal to the six profiles and ten answers one by one; each table is scanned once."""
    run = wrangle(spark, city, str(tmp_path / "run"))
    elements = markup.elements(run.staged)
    one_by_one = {
        "count_tags": profile.count_tags(elements), "key_classes": profile.key_classes(elements.where("kind = 'tag'")),
        "distinct_users": profile.distinct_users(elements), "audit_street_types": profile.audit_street_types(run.tags),
        "audit_zipcodes": profile.audit_zipcodes(run.tags), "audit_phone": profile.audit_phone(run.tags),
    }
    found = run.profiles()
    assert {k: rows_of(df) for k, df in found.items()} == {k: rows_of(df) for k, df in one_by_one.items()}
    assert all(found[k].columns == df.columns for k, df in one_by_one.items())
    asked, want = run.answers(), analytics.answers(run.tables)
    assert {k: [tuple(r) for r in df.collect()] for k, df in asked.items()} == {k: [tuple(r) for r in df.collect()] for k, df in want.items()}
    assert all(asked[k].columns == df.columns for k, df in want.items())
    assert final_plan(profile.facts(elements, run.tags)).count("FileScan") == 2
    assert final_plan(analytics.facts(run.tables)).count("FileScan") == 4


def test_elements_are_rejected_as_a_whole(spark, tmp_path):
    source = tmp_path / "map.xml"
    nameless = fx.way(4, children=[fx.nd(1), fx.tag("a", "b")]).replace(' user="ann"', "")
    source.write_text(fx.document(
        fx.node(1, children=[fx.tag("a", "b")]), fx.node("x2", children=[fx.tag("a", "b")]),
        fx.way(3, children=[fx.nd(1), fx.nd("ref"), fx.tag("a", "b")]), nameless,
        fx.way(5, children=[fx.nd(1)]), fx.way(5, children=[fx.nd("ref")]),
    ))
    run = wrangle(spark, str(source), str(tmp_path / "run"))
    assert {t: [tuple(r) for r in df.select("id").collect()] for t, df in run.tables.items()} == {
        "nodes": [(1,)], "nodes_tags": [(1,)], "ways": [(5,)], "ways_nodes": [(5,)], "ways_tags": [],
    }
    found = {t: sorted((r.id, r.errors[0]) for r in df.collect()) for t, df in run.rejects.items()}
    assert found == {
        "nodes": [("x2", "type:id")], "nodes_tags": [("x2", "type:id")],
        "ways": [("3", "element:rejected"), ("4", "required:user"), ("5", "element:rejected")],
        "ways_nodes": [("3", "element:rejected"), ("3", "type:node_id"), ("4", "element:rejected"), ("5", "type:node_id")],
        "ways_tags": [("3", "element:rejected"), ("4", "element:rejected")],
    }
    off = wrangle(spark, str(source), str(tmp_path / "off"), mode="off")
    assert off.tables["ways_nodes"].count() == 5 and off.rejects["ways"].count() == 0


def test_wrangle_failfast(spark, city, tmp_path):
    with pytest.raises(ValueError, match="bad row in nodes: element x6 has nodes.id: type$"):
        wrangle(spark, city, str(tmp_path / "run"), mode="failfast")


def test_failfast_reports_all_of_the_first_bad_element(spark, tmp_path):
    source = tmp_path / "map.xml"
    nameless = fx.way(4, children=[fx.nd("a"), fx.nd(2), fx.nd("b"), '<tag k="name"/>']).replace(' user="ann"', "")
    source.write_text(fx.document(fx.node(1), nameless, fx.node("x2"), fx.way(9, children=[fx.nd("z")])))
    with pytest.raises(ValueError) as found:
        wrangle(spark, str(source), str(tmp_path / "run"), mode="failfast")
    assert str(found.value) == (
        "bad row in ways: element 4 has ways.user: required, ways_nodes[0].node_id: type, ways_nodes[2].node_id: type, "
        "ways_tags[name].value: required")
    run = wrangle(spark, str(source), str(tmp_path / "all"))
    assert sorted((r["id"], r["path"], r["error"]) for r in run.report.collect()) == [
        ("4", "ways.user", "required"), ("4", "ways_nodes[0].node_id", "type"), ("4", "ways_nodes[2].node_id", "type"),
        ("4", "ways_tags[name].value", "required"), ("9", "ways_nodes[0].node_id", "type"), ("x2", "nodes.id", "type"),
    ]


def test_five_tables_in_one_pass(spark, city, tmp_path):
    """Children are scanned once for three tables, elements once for two."""
    staged = markup.stage_events(spark, city, str(tmp_path / "staged"))
    children = order.store_children(staged, str(tmp_path / "children"))
    rows = shape.routed(markup.elements(staged), children)
    plan = final_plan(rows)
    assert plan.count("FileScan") == 2 and "Exchange" not in plan
    apart = shape.shape(markup.elements(staged), children)
    for name, own in apart.items():
        mine = rows.where(F.col("table_name") == name).select(*[F.col(c).cast("string") for c in TABLE_KINDS[name]])
        assert rows_of(mine) == rows_of(own.select(*[F.col(c).cast("string") for c in TABLE_KINDS[name]]))


def test_shaping_honours_its_arguments(spark):
    tags = spark.createDataFrame([("node", "1", "a.b", "x"), ("node", "1", "c!", "x")], "elem STRING, id STRING, k STRING, v STRING")
    found = shape.shape_node_tags(tags, problem_chars="!", default_type="plain")
    assert rows_of(found) == [("1", "a.b", "x", "plain")]
    nodes = spark.createDataFrame([("node", "1", "ann")], "kind STRING, id STRING, user STRING")
    assert shape.shape_nodes(nodes, ("user",)).columns == ["user"]


def test_plans(spark, city, tmp_path):
    staged = markup.stage_events(spark, city, str(tmp_path / "staged"))
    nodes = final_plan(shape.shape_nodes(markup.elements(staged)))
    assert "EqualTo(kind,node)" in nodes
    assert "Exchange" not in nodes and "k:string" not in nodes.split("ReadSchema")[1]
    # Stored rows and one row for each segment before them: nothing is folded or shuffled again.
    children = final_plan(order.children(staged))
    assert "Window" not in children and "Exchange hashpartitioning" not in children


@pytest.mark.parametrize("broadcast", [True, False])
def test_order_folds_once(spark, city, tmp_path, broadcast):
    """The rows are folded into storage; results join what came before each segment, broadcast or not."""
    staged = markup.stage_events(spark, city, str(tmp_path / "staged"), keep_markup=True)
    want = rows_of(order.children(staged, 2))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for n in names if not broadcast else ():
        spark.conf.set(n, "-1")
    try:
        results = [order.children(staged, 2), order.every_kth(staged, 10, 2), extract.sampled_markup(staged, 10, 2)]
        plans = [final_plan(r) for r in results]
        assert rows_of(results[0]) == want
    finally:
        for n in names if not broadcast else ():
            spark.conf.unset(n)
    for text in plans:
        assert "Python" not in text and "Window" not in text and "xxhash64" not in text
        assert ("BroadcastHashJoin" in text) == broadcast
        scans = [line for line in text.splitlines() if "FileScan" in line]
        assert len(scans) == 2 and sum("_elements_before" in line for line in scans) == 1
        # With a sort-merge join the rows and the sums of their segments are shuffled once.
        assert sum("Exchange hashpartitioning(segment" in x for x in text.splitlines()) == (0 if broadcast else 2)


def test_fold_shuffles_the_rows_once(spark, city, tmp_path):
    staged = markup.stage_events(spark, city, str(tmp_path / "staged"))
    rows = staged.select("file", "block", "seq", "event", "name", "id")
    seen = []
    real = order.store
    try:
        order.store = lambda df, target, *layout: (seen.append(df), real(df, target, *layout))[1]
        order.in_document_order(rows)
    finally:
        order.store = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(segment") == 1 and plan.count("FileScan") == 1
