from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mapengine.llm import mixing


def targets(sizes, weights=(1.0, 2.0, 3.0), most=3.0):
    """By rounds: capped sources are fixed and the excess is shared again."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if shares[s] > most * sizes[s]}
        if not above:
            return out | shares
        out |= {s: most * sizes[s] for s in above}
        open_ -= above
    return out


def test_targets_against_rounds(spark):
    for sizes in (
        {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 5, "c": 1, None: 7}, {"a": 0, "b": 10}, {"x": 3},
        {chr(97 + i): (i * 37) % 101 + 1 for i in range(20)}, {"b": 1, "B": 900, "é": 2, None: 1},
    ):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert found == pytest.approx(targets(sizes))
        assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def corpus(n=400):
    return [(i, " ".join(["w"] * (1 + i * i % 57)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(n)]


@pytest.mark.parametrize("block", [4096, 8])
def test_taken_words_come_near_targets(documents, monkeypatch, block):
    real = mixing.running_total
    monkeypatch.setattr(mixing, "running_total", lambda *a: real(*a, rows_per_block=block))
    rows = corpus()
    found = mixing.mix(documents(*rows)).collect()
    assert len(found) == len(rows)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in found:
        assert r.size == len(rows[r.doc_id][1].split())
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    assert target == pytest.approx(targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
        # Every document expects the same number of copies, and gets one of the two next to it.
        ratio = target[s] / sizes[s]
        assert {r.copies for r in found if r.source == s} <= {int(ratio), int(ratio) + 1}


def test_reruns_agree(documents):
    docs = documents(*corpus(100))
    first, second = (sorted((r.doc_id, r.copies) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert first == second
    assert first != sorted((r.doc_id, r.copies) for r in mixing.mix(docs, seed=8).collect())


def test_awkward_rows(documents, awkward):
    found = mixing.mix(documents(*awkward)).collect()
    assert len(found) == len(awkward)
    for r in found:
        if r.size == 0:
            assert r.copies * r.size == 0
    docs = documents(*awkward)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in found)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0


def test_take_repeats_rows(documents):
    docs = documents(*corpus(90))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    taken = {r.doc_id: r.n for r in mixing.take(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert taken == copies


def test_no_python_on_the_way(documents):
    text = mixing.mix(documents(*corpus(10)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
