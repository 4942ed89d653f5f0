import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapengine.llm import hard_negatives, topk, vectors
from mapengine.llm.queries import oracle_sql, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id long, block string, `group` string, score string, rank string"


@pytest.fixture(scope="module")
def embeddings(spark):
    def of(rows):
        return spark.createDataFrame([(*r, 1, "x", "x", "x", "x") for r in rows], SCHEMA)

    return of


def whole(v):
    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


def usable(rows, label=False):
    out = {}
    for i, v, l in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or (label and l is None):
            continue
        key = (list(map(float, v)), l) if label else (list(map(float, v)),)
        out[i] = min(out.get(i, key), key)
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, every, k):
    own = {i: whole(r[0]) for i, r in usable(rows).items()}
    out = []
    for q in own:
        if q % every == 0:
            best = sorted((-dot(own[q], v), i) for i, v in own.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every, np_, nn, low, high):
    own = {i: (whole(r[0]), r[1]) for i, r in usable(rows, True).items()}
    out = []
    for a, (v, l) in own.items():
        if a % every:
            continue
        scores = [(-dot(v, w), i, m) for i, (w, m) in own.items() if i != a]
        for ps, p, _ in sorted(s for s in scores if s[2] == l)[:np_]:
            fit = sorted(s for s in scores if s[2] != l and low * -ps <= 100 * -s[0] <= high * -ps)[:nn]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


def awkward(n=160, dims=6, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.choice([-1, 1]) * round(r.random(), 1) for _ in range(dims)], r.randrange(3)) for i in range(n)]
    rows += [(n + i, [0.5] * dims, i % 2) for i in range(40)]  # many equal vectors: ties
    return rows + [
        (None, [1.0] * dims, 1), (n + 50, None, 1), (n + 60, [1.0, None] * 3, 1), (n + 70, [float("nan")] * dims, 1),
        (n + 80, [float("inf")] * dims, 0), (n + 90, [], 0), (n + 100, [2.0, 1.0], 1), (n + 110, [0.25] * dims, None),
        (0, rows[0][1], rows[0][2]), (1, [9.0] * dims, 2), (3, [0.1] * (dims + 3), 1), (-20, [0.3] * dims, 1),
    ]


def test_top_k_equals_brute_force(embeddings):
    rows = awkward()
    for block, group in ((8192, 4096), (37, 5)):
        got = topk.top_k(embeddings(rows), F.col("id") % 10 == 0, k=5, block_rows=block, group_rows=group)
        assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_top_k_has_all_rows_where_there_are_fewer(embeddings):
    rows = [(0, [1.0], 0), (10, [2.0], 0), (11, [0.0], 0)]
    got = topk.top_k(embeddings(rows), F.col("id") % 10 == 0, k=5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10, 5)


def test_hard_negatives_equal_brute_force(embeddings):
    rows = awkward()
    for block, group, words in ((8192, 4096, 8), (37, 5, 3)):
        got = hard_negatives.hard_negatives(
            embeddings(rows), F.col("id") % 10 == 0, block_rows=block, group_rows=group, codewords=words)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 5, 5, 80, 100)


def test_other_windows(embeddings):
    rows = awkward(seed=3)
    got = hard_negatives.hard_negatives(embeddings(rows), F.col("id") % 7 == 0, positives_each=2, negatives_each=9, low=33, high=71)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 7, 2, 9, 33, 71)


def test_empty_table_and_one_label(embeddings):
    none = embeddings([])
    assert topk.top_k(none, F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(none, F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(embeddings([(i, [1.0, 2.0], 4) for i in range(9)]), F.lit(True)).count() == 0


def test_scores_beyond_a_double(embeddings, spark):
    rows = [(i, [float(np.float32(1e6 + 3 * i)), float(np.float32(2e6 - i)), 1.0], i % 2) for i in range(30)]
    wide = embeddings(rows)
    assert sorted(map(tuple, topk.top_k(wide, F.col("id") < 9, k=3).collect())) == sorted(
        x for x in brute_top(rows, 1, 3) if x[0] < 9)
    found = hard_negatives.hard_negatives(wide, F.col("id") % 4 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, 4, 5, 5, 80, 100)


def _read_in_full(n=2048):
    rows = np.floor(256 * np.random.default_rng(0).normal(size=(n, 8)) / 3)
    return rows, topk.Lists(rows)


def test_bounds_hold_at_every_depth_and_meet_at_the_end():
    rows, lists = _read_in_full()
    queries = rows[:5]
    scores = queries @ rows.T
    for depth in (1, 7, 500, 2048):
        lists.read(depth)
        lower, upper = lists.bounds(queries)
        assert (lower <= scores).all() and (scores <= upper).all()
    assert (lower == scores).all() and (upper == scores).all()


def test_outsiders_are_left_unread():
    """Clustered vectors: a search that knows a good score resolves few rows of a part."""
    rng = np.random.default_rng(1)
    rows = np.floor(256 * (np.eye(8)[rng.integers(0, 8, 4096)] + rng.normal(size=(4096, 8)) / 20))
    known = np.full(8, 0.9 * 256 * 256)
    q, r, s = topk._in_part(np.arange(8) - 100, np.floor(256 * np.eye(8)), known, np.arange(4096), rows, 5)
    assert len(q) < 0.3 * 8 * 4096
    assert (s == (np.floor(256 * np.eye(8))[q] * rows[r]).sum(1)).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.lists(st.integers(-9, 9), min_size=3, max_size=3)), min_size=1, max_size=60, unique_by=lambda x: x[0]))
def test_search_property(found):
    ids, rows = np.array([x[0] for x in found]), np.array([x[1] for x in found], float)
    got = topk.search(ids, rows, ids, rows, 3)
    want = [
        (int(q), i, -s) for q, v in sorted(zip(ids, rows.tolist(), strict=True))
        for s, i in sorted((-dot(v, w), int(j)) for j, w in zip(ids, rows.tolist(), strict=True) if j != q)[:3]
    ]
    assert sorted(zip(*[x.tolist() for x in got], strict=True)) == sorted(want)


def test_walk_visits_every_cell_by_descending_certified_bound():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(500, 6)) * 50)
    words = tuple(hard_negatives.codebook(h, 5) for h in (rows[:, :3], rows[:, 3:]))
    index = hard_negatives.MultiIndex(np.arange(500), np.zeros(500, int), rows, words)
    anchor, seen, last = rows[7], 0, np.inf
    for bound, least, place in index.walk(anchor):
        scores = index.rows[place] @ anchor
        assert bound <= last + 2 and (scores <= bound).all() and (scores >= least).all()
        seen, last = seen + len(scores), bound
    assert seen == 500


def test_walk_ends_early_on_clustered_rows():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * (np.eye(6)[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, 6)) / 30))
    words = tuple(hard_negatives.codebook(h, 4) for h in (rows[:, :3], rows[:, 3:]))
    index = hard_negatives.MultiIndex(np.arange(3000), np.zeros(3000, int), rows, words)
    assert sum(1 for bound, _, _ in index.walk(rows[0]) if bound >= 0.8 * rows[0] @ rows[0]) < 8


def test_vectors_of_one_id_count_once(embeddings):
    rows = embeddings([(1, [2.0], 0), (1, [1.0], 1), (1, [1.0], 1)])
    assert [tuple(r) for r in vectors.taking_part(rows).collect()] == [(1, [1.0])]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_exact_topk"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, sf)
    assert set(got.columns) == set(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
