import random
import re
from collections import Counter

import numpy as np

from mapengine.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def labelled(n=300, seed=1):
    rng = random.Random(seed)
    good = [" ".join(rng.choice("abcdefghij") * rng.randint(2, 7) + str(rng.randint(0, 99)) for _ in range(rng.randint(60, 200))) for _ in range(n)]
    docs, labels = [], []
    for i, text in enumerate(good):
        kind = i % 6
        if kind == 0:
            text = text.replace(" ", "### ")
        elif kind == 1:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text))
        labels.append((i, 0 if kind < 2 else 1, 0))
    return docs, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_counts_against_brute_force(spark, documents, awkward):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    texts += ["a\na\n b\nb \n\n \na", "x # $ <>|&%* y", "a b c a b c", "a b c", "à À\x85b", "a b a b a b"]
    rows = [(i, t) for i, t, _ in awkward] + [(100 + i, t) for i, t in enumerate(texts)]
    found = quality.quality(documents(*rows), table(spark, [(1, 1, 0)])).collect()
    assert len(found) == len(rows)
    want = sorted((brute(t) for _, t in rows), key=repr)
    assert sorted([tuple(r)[1:6] for r in found], key=repr) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_learned_rules_hold_on_new_documents(spark, documents):
    docs, labels = labelled()
    rules = quality.fit(documents(*docs), table(spark, labels))
    assert rules.rules and str(rules).startswith("reject if ")
    fresh, truth = labelled(120, seed=9)
    judged = {r.doc_id: r for r in quality.quality(documents(*fresh), table(spark, truth)).collect()}
    kept = quality.keep_good(documents(*fresh), table(spark, truth))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in judged.items() if r.kept}
    right = [judged[i].kept == (good == 1) for i, good, _ in truth]
    assert np.mean(right) > 0.97
    # Clean documents are left alone.
    assert all(judged[i].kept for i, good, _ in truth if good == 1)


def test_labels_that_teach_nothing(spark, documents, awkward):
    docs = documents(*awkward)
    for labels in ([], [(None, 1, 0), (3, None, None)], [(1, 1, 0)] * 5, [(999, 0, 0)]):
        rules = quality.fit(docs, table(spark, labels))
        assert rules.rules == [] and str(rules) == "reject nothing"
    kept = quality.keep_good(docs, table(spark, []))
    assert kept.columns == docs.columns
    assert quality.quality(docs.where("doc_id < 0"), table(spark, [])).count() == 0


def test_first_rule_that_holds_is_named(spark):
    c = quality.Condition
    rules = quality.DecisionList([(c("n_words", True, 10.0),), (c("n_words", True, 5.0), c("mean_word", False, 3.0))])
    rows = spark.createDataFrame([(n, n * 2) for n in (11, 7, 3)], "n_words long, word_chars long")
    counts = {k: rows[k] if k in rows.columns else quality.F.lit(0) for k in quality.COUNTS}
    assert [r[0] for r in rows.select(rules.rejected_by(counts)).collect()] == [1, 2, None]


def test_counts_are_computed_once(spark, documents):
    """Rules test counts that a row of its own holds; none is moved below and computed anew."""
    docs, labels = labelled(60)
    text = quality.keep_good(documents(*docs), table(spark, labels))._jdf.queryExecution().executedPlan().toString()
    assert text.count("array_sort") <= 2
    assert "Python" not in text and "Arrow" not in text
