import random
from collections import defaultdict

from pyspark.sql import functions as F

from mapengine.llm import line_dedup
from tests.llm.conftest import LONG

BLANKS = " \t\n\x0b\f\r"


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[lowered(line.strip(BLANKS))].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = lowered(line.strip(BLANKS))
            known = [d for d in holders[key] if d is not None]
            drop = len(key) >= min_chars and len(holders[key]) >= min_docs and known and i != max(known)
            if not drop:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(docs, **options):
    found = line_dedup.dedup_lines(docs, **options).select("doc_id", "text", "n_lines", "n_dropped")
    return sorted([tuple(r) for r in found.collect()], key=repr)


def test_against_brute_force(documents):
    rng = random.Random(3)
    pool = [f"{LONG} number {i}" for i in range(12)] + ["short", "", "x" * 39, "Y" * 40, "É" + "z" * 45]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    for options in ({}, {"batches": 1}, {"batches": 7, "fanout": 2}):
        assert result(documents(*rows), **options) == brute(rows)


def test_awkward_rows(documents, awkward):
    rows = [r[:2] for r in awkward]
    found = result(documents(*awkward), min_docs=3)
    assert found == brute(rows, min_docs=3)
    assert len(found) == len(rows)


def test_hot_line(documents):
    """A line in a third of all documents stays in the largest id alone."""
    rows = [(i, f"{LONG}\nown line {i}" if i % 3 == 0 else f"own line {i}") for i in range(300)]
    dropped = line_dedup.dedup_lines(documents(*rows)).agg(F.sum("n_dropped"), F.count("*")).first()
    assert tuple(dropped) == (99, 300)


def test_empty_table(documents):
    assert result(documents((1, "x")).where("doc_id < 0")) == []


def test_other_columns_stay(documents):
    docs = documents((1, LONG), (2, LONG))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {r.size for r in out.collect()} == {1}


def test_runs_as_a_stream_of_batches(spark, documents):
    runs = line_dedup.LineRuns(spark, fanout=2)
    seen = []
    for k in range(5):
        batch = documents(*[(10 * k + i, f"{LONG} {k + i}") for i in range(3)])
        lines = line_dedup.hashed_lines(batch, 40)
        seen.append(sorted(r.doc for r in runs.unseen(lines).collect()))
        runs.add(lines)
    assert seen == [[0, 1, 2], [12], [22], [32], [42]]
    # Five runs of fan-out two: one of four and one of one.
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.compact()
    assert sum(len(level) for level in runs.levels) == 1
    assert sorted(r.docs for r in runs.keys().collect()) == [1, 1, 2, 2, 3, 3, 3]


def test_no_python_on_the_way(documents):
    out = line_dedup.dedup_lines(documents((1, LONG)))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
