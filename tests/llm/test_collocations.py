import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapengine.llm import collocations
from mapengine.llm.queries import oracle_sql, queries

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, longest=5, min_count=100, first=2000, held=100):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    f = {k: v for k, v in f.items() if v >= min_count}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(lang == m and len(q) > len(p) and 100 * v >= held * a and any(q[i : i + len(p)] == p for i in range(len(q)))
               for (m, q), v in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:first]))


@pytest.fixture(scope="module")
def docs(spark):
    def of(rows):
        schema = "text string, lang string, id long, a string, b string, n string, slice string, seq string, word string, f string"
        return spark.createDataFrame([(*r, *[1, *"xxxxxxx"]) for r in rows], schema)

    return of


def run(docs, rows, **more):
    return sorted(map(tuple, collocations.collocations(docs(rows).repartition(3), **more).collect()))


def corpus(seed=1, n=150):
    r = random.Random(seed)
    vocabulary = ["New", "york", "city", "the", "of", "é", "x y", "a", "ÀB", "rare%d"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(60)):
            w = r.choice(vocabulary)
            words += ["new York City hall", "the the the the the the", w % i if "%" in w else w][r.randrange(3) :][:1]
        rows.append((r.choice([" ", "\t", "  \t"]).join(words).replace("city", r.choice(["city.", "city", "city\n", "city\x0b"])), r.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t\n", "en"), ("one", "fr"), ("a b " * 5000, "long"), rows[0], rows[0]]


def test_equals_brute_force(docs):
    rows = corpus()
    for more in ({"min_count": 20}, {"min_count": 5, "slice_words": 40, "part_bytes": 700}, {"min_count": 9, "longest": 3, "first": 4}, {"min_count": 12, "held_percent": 60, "longest": 6}):
        want = {k: v for k, v in more.items() if k not in ("slice_words", "part_bytes")}
        want["held"] = want.pop("held_percent", 100)
        assert run(docs, rows, **more) == brute(rows, **want)


def test_two_words_only(docs):
    rows = corpus(2)
    assert run(docs, rows, min_count=15, longest=2) == brute(rows, min_count=15, longest=2)


def test_nothing_to_find(docs, spark):
    assert run(docs, [("a b c", "en")]) == []
    assert run(docs, [(None, None)]) == []
    assert collocations.collocations(docs([("x", "y")]).where("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame(
        [(0, "en", 3 * 10**12, "a b", "b", [7 * 10**12], [9 * 10**12])], "id long, lang string, f long, phrase string, last string, begins array<long>, ends array<long>")
    sizes = spark.createDataFrame([("en", 8 * 10**15)], "lang string, n long")
    got = collocations._scored(rows, 2, sizes).collect()[0]
    assert got["score"] == 1000 * 3 * 10**12 * 8 * 10**15 // (7 * 10**12 * 9 * 10**12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 40), max_size=300), st.sampled_from([1, 3, 8, 64]))
def test_tiles_count_every_pair(seq, tile):
    a, b, n = collocations.pairs_of(np.array(seq, np.int64), tile)
    want = Counter((x, y) for x, y in zip(seq, seq[1:], strict=False) if x >= 0 and y >= 0)
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert len(a) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-1, 6), max_size=80), st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6))))
def test_recoding(seq, pairs):
    pairs = sorted(pairs)
    ids = {p: 2**40 + i for i, p in enumerate(pairs)}
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    got = collocations.recoded(np.array(seq, np.int64), a, b, np.array([ids[p] for p in pairs], np.int64))
    want = [ids.get(p, -1) for p in zip(seq, seq[1:], strict=False)]
    assert [x for x in got.tolist() if x >= 0] == [x for x in want if x >= 0]
    assert collocations._joined(np.array(want, np.int64)).tolist() == got.tolist()


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
def test_packing_is_exact(numbers):
    assert collocations.unpacked(collocations.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(oracle_sql()["op12_collocations"])
    names = [c[0] for c in want.description]
    got = queries()["op12_collocations"](spark, sf)
    assert set(got.columns) == set(names)
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(want.fetchall()) and rows
