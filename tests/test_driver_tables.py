"""The given tables as an extract: text, and what is made for whom."""

from pathlib import Path

import pytest

from checks import driver_tables as d
from checks.queries import queries
from mapengine import workspace
from mapengine.operators import order
from mapengine.sources import markup
from tests import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no given tables here")


def test_only_what_a_query_asks_for_is_made(spark, monkeypatch):
    made = []
    monkeypatch.setattr(d, "_made", {})
    monkeypatch.setattr(markup, "stage_events", lambda *a, **k: made.append("staged") or "rows")
    monkeypatch.setattr(order, "store_children", lambda *a, **k: made.append("children") or "kids")
    d.markup_path(spark, SF_DIR)
    assert made == []
    assert d.staged(spark, SF_DIR) == "rows" and made == ["staged"]
    assert d.children(spark, SF_DIR) == "kids" and d.staged(spark, SF_DIR) == "rows" and made == ["staged", "children"]


def test_values_and_not_markup_are_sorted(spark):
    assert "line" not in d.markup_rows(spark, SF_DIR).columns


def _bytes(folder) -> int:
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_the_extract_takes_little_disk_in_small_files(spark, tmp_path, monkeypatch):
    """As text it is several times as large; compressed files are read by one task each, so none is large, and their order holds."""
    monkeypatch.setattr(d, "ROWS_PER_FILE", 700)
    d.write_markup(spark, SF_DIR, str(tmp_path / "map"))
    lines = spark.read.text(str(tmp_path / "map"))
    assert 4 * _bytes(tmp_path / "map") < lines.selectExpr("sum(octet_length(value) + 1)").first()[0]
    files = markup.files_in_order(spark, [str(tmp_path / "map")])
    assert len(files) > 10
    ids = [int(r.id) for f in files for r in spark.read.text(f).selectExpr("regexp_extract(value, '<way id=\"([0-9]+)', 1) AS id").where("id <> ''").collect()]
    assert len(ids) == 1500 and ids == sorted(ids)


def test_csv_round_trip_leaves_no_plain_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(d, "_made", {})
    monkeypatch.setattr(workspace, "new_dir", lambda _, name: str(tmp_path / name))
    assert queries()["csv_roundtrip"](spark, SF_DIR).count() > 0
    written = [f.name for part in ("csv", "markup") for f in (tmp_path / part).rglob("part-*")]
    assert {n.rsplit(".", 1)[1] for n in written} == {"gz", "snappy"}


def test_staging_sorts_no_rows(spark, tmp_path, monkeypatch):
    layouts, store = [], markup.store
    monkeypatch.setattr(markup, "store", lambda rows, target, *layout: layouts.append(layout) or store(rows, target, *layout))
    monkeypatch.setattr(order, "store", lambda rows, target, *layout: layouts.append(layout) or store(rows, target, *layout))
    (tmp_path / "map.xml").write_text(fx.small())
    rows = markup.stage_events(spark, str(tmp_path / "map.xml"), str(tmp_path / "staged"))
    order.store_children(rows, str(tmp_path / "children"))
    assert layouts and not any(layouts)
