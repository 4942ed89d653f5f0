import random

import pytest
import xxhash
from pyspark.sql.functions import col

from mapengine.llm import simhash
from mapengine.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, distance):
    """Component of each fingerprint: the smallest reachable."""
    out, todo = {}, sorted(set(fps))
    for start in todo:
        if start in out:
            continue
        stack = [start]
        while stack:
            x = stack.pop()
            if x in out:
                continue
            out[x] = start
            stack += [y for y in todo if y not in out and bin(x ^ y).count("1") <= distance]
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark, documents, awkward):
    rows = [(i, t) for i, t, _ in awkward] + [(99, "A b\x0bC\x1cd É È")]
    found = documents(*rows).select(simhash.fingerprint(col("text")).alias("f")).collect()
    assert [r.f % (1 << 64) for r in found] == [brute_fingerprint(t) for _, t in rows]


def clustered(seed, centres, each, flips):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        x = rng.getrandbits(64)
        for _ in range(each):
            out.append(x)
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
    return out


@pytest.mark.parametrize("crowded", [64, 4])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_against_all_pairs(spark, monkeypatch, crowded, distance):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    fps = clustered(distance, 12, 14, 4) + [0, 1, 3, 1 << 63, (1 << 64) - 1]
    table = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(table, distance).collect()]
    assert all(bin(u ^ v).count("1") <= distance for u, v in edges)
    parent = {f: f for f in set(fps)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        parent[b] = a
    assert {f: root(f) for f in parent} == linked(fps, distance)


def test_crowded_keys_give_few_rows(spark, monkeypatch):
    """Many fingerprints that share half their bits: edges in proportion, not pairs."""
    fps = [(7 << 32) | i for i in range(700)]
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(table, 2)
    assert edges.count() < 700 * 100
    assert {r.component for r in components(edges).collect()} == {7 << 32}


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    edges = spark.createDataFrame(chain + hub + [(5000, 5000), (7, 6)], "u long, v long")
    found = dict(tuple(r) for r in components(edges).collect())
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}
    assert components(edges.where("u < 0")).count() == 0


BASE = " ".join(f"word{i}" for i in range(300))


def near(text, k):
    words = text.split()
    words[k] = "changed"
    return " ".join(words)


def test_near_duplicates_against_brute_force(documents, awkward):
    rows = [(i, t) for i, t, _ in awkward]
    rows += [(20 + i, near(BASE, 7 * i)) for i in range(12)] + [(40, BASE), (41, BASE)]
    found = simhash.near_duplicates(documents(*rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    component = linked(fps, 2)
    first = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            first[component[f]] = min(first.get(component[f], i), i)
    want = sorted(((i, signed(f), first.get(component[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)
    assert sorted([tuple(r) for r in found], key=repr) == want


def test_keep_one(documents, awkward):
    rows = [(i, t) for i, t, _ in awkward] + [(40, BASE), (41, BASE), (42, near(BASE, 3))]
    docs = documents(*rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = linked([brute_fingerprint(t) for _, t in rows], 2)
    got = [brute_fingerprint(r.text) for r in kept.collect()]
    assert sorted({classes[f] for f in got}) == sorted(set(classes.values()))
    assert len(got) == len(set(classes.values()))
    assert simhash.keep_one(docs.where("doc_id < 0")).count() == 0


def test_a_third_of_rows_are_copies(documents):
    rows = [(i, BASE if i % 3 == 0 else f"text of its own {i} {i * i} {i * 7}") for i in range(300)]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(*rows)).collect()}
    assert all(found[i] == 0 for i in range(0, 300, 3))
