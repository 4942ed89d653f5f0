import random
import zlib

import numpy as np
import pytest

from mapengine.llm import lm_score as lm


def sentences(seed, n):
    """A small language: each word is followed by one of two others."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = rng.randrange(40)
        words = []
        for _ in range(rng.randint(20, 60)):
            words.append(f"w{w}")
            w = (3 * w + rng.randrange(2)) % 40
        out.append(" ".join(words))
    return out


def test_vocabulary_counts_all_words(documents, monkeypatch):
    monkeypatch.setattr(lm, "_COUNTED", 3)
    docs = documents((1, "B b a\tÉ"), (2, "a b c d e f a"), (3, None))
    known = lm.vocabulary(docs)
    assert [w.decode() for w in sorted(known, key=known.get)][:3] == ["a", "b", "c"]
    ids = lm.ids_of([b"a", b"zzz"], known)
    assert ids.tolist() == [0, lm.VOCABULARY - lm.HASHED + zlib.crc32(b"zzz") % lm.HASHED]


def test_probabilities_sum_to_one():
    net = lm.Network(lm.fresh())
    around = np.zeros((4, lm.VOCABULARY), np.int32) + np.array([[1], [2], [3], [lm.PAD]])
    found = net.score(around, np.arange(lm.VOCABULARY))
    assert np.exp(found.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_training_follows_the_gradient():
    rng = np.random.default_rng(1)
    around, word = rng.integers(0, 50, (4, 4000)).astype(np.int32), None
    word = ((around[1] + around[2]) % 50).astype(np.int32)
    net = lm.Network(lm.fresh())
    before = net.score(around, word).mean()
    for _ in range(30):
        net.train(around, word)
    assert net.score(around, word).mean() > before + 1.5


def test_held_out_documents_score_above_shuffled_ones(documents):
    docs = documents(*enumerate(sentences(1, 300)))
    known = lm.vocabulary(docs)
    values = lm.trained(docs, known)
    fresh = sentences(2, 60)
    rng = random.Random(3)
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in fresh]
    score = {r.doc_id: r.log_prob for r in lm.scored(documents(*enumerate(fresh + mixed)), known, values).collect()}
    assert np.mean([score[i] > score[60 + i] for i in range(60)]) > 0.95


def test_sums_against_one_text_at_a_time(documents, monkeypatch):
    texts = sentences(4, 25) + ["", "one"]
    docs = documents(*enumerate(texts))
    known = lm.vocabulary(docs)
    values = lm.flat(lm.fresh())
    monkeypatch.setattr(lm, "BATCH", 7)
    found = {r.doc_id: r for r in lm.scored(docs, known, values).collect()}
    net = lm.Network(lm.shaped(values))
    for i, t in enumerate(texts):
        ids = lm.ids_of(t.encode().split(), known)
        around, word = lm._windows([ids])
        assert found[i].n_words == len(ids)
        assert found[i].log_prob == pytest.approx(float(net.score(around, word).sum()) if len(ids) else 0, rel=1e-4)


def test_averaging_in_two_steps(spark):
    rows = [(i, b, 1 + i % 3, np.full(5, i + 100 * b, "<f4").tobytes()) for i in range(40) for b in range(3)]
    models = spark.createDataFrame(rows, "part long, block long, words long, model binary")
    step = lm._averaged(models, lm.F.floor(lm.F.col("part") / 7))
    assert step.count() == 6 * 3  # a group holds one block of seven models
    found = lm._averaged(step, lm.F.lit(0).cast("long")).orderBy("block").collect()
    want = sum(i * (1 + i % 3) for i in range(40)) / sum(1 + i % 3 for i in range(40))
    assert [r.block for r in found] == [0, 1, 2]
    for r in found:
        assert np.frombuffer(r.model, "<f4") == pytest.approx(np.full(5, want + 100 * r.block))


def plain_step(model, around, words, rate):
    """One step word by word in plain Python floats, from the formulas of a two-level softmax and Adagrad."""
    per = model["word_b"].shape[1]
    grad = {k: np.zeros(v.shape) for k, v in model.items()}
    for j, word in enumerate(words):
        h = np.tanh(model["bias"] + sum(model["embed"][p][around[p][j]] for p in range(len(around))))
        c, w = divmod(int(word), per)
        p_class = np.exp(h @ model["class_w"] + model["class_b"])
        p_class /= p_class.sum()
        p_word = np.exp(h @ model["word_w"][c] + model["word_b"][c])
        p_word /= p_word.sum()
        p_class[c] -= 1
        p_word[w] -= 1
        d_h = model["class_w"] @ p_class + model["word_w"][c] @ p_word
        grad["class_w"] += np.outer(h, p_class)
        grad["class_b"] += p_class
        grad["word_w"][c] += np.outer(h, p_word)
        grad["word_b"][c] += p_word
        d_in = d_h * (1 - h * h)
        grad["bias"] += d_in
        for p in range(len(around)):
            grad["embed"][p][around[p][j]] += d_in
    n = len(words)
    return {k: v - rate * (grad[k] / n) / np.sqrt(1e-3 + (grad[k] / n) ** 2) for k, v in model.items()}


def test_a_training_step_against_plain_python():
    draw = np.random.default_rng(5)
    model = {k: v.astype(float) for k, v in lm.fresh(side=4).items()}
    around, words = draw.integers(-1, 16, (4, 30)), draw.integers(0, 16, 30)
    net = lm.Network(lm.fresh(side=4))
    net.train(around.astype(np.int32), words.astype(np.int32))
    for name, want in plain_step(model, around, words, lm.RATE).items():
        assert net.m[name] == pytest.approx(want, abs=2e-4), name


def test_awkward_rows(documents, awkward):
    docs = documents(*awkward)
    found = lm.lm_score(docs).collect()
    assert len(found) == len(awkward)
    for r in found:
        assert (r.n_words == 0) == (r.mean_log_prob is None) and r.log_prob <= 0
    assert lm.lm_score(docs.where("doc_id < 0")).count() == 0


def test_rare_words_are_scored_by_their_own_counts(documents, monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 4)  # 12 words have entries of their own, 4 entries are shared
    common = " ".join(f"w{i}" for i in range(12))
    bucket = [w for w in (f"r{i}" for i in range(200)) if zlib.crc32(w.encode()) % 4 == 1]
    often, once, never = bucket[:3]
    docs = documents((1, f"{common} {common} {common} {common} " + f"{often} " * 3), (2, once), (3, None))
    counts = lm.word_counts(docs)
    known = lm.vocabulary(docs, counts=counts)
    assert len(known) == 12 and known.side == 4
    values = lm.flat(lm.fresh(side=4))
    probe = documents((1, often), (2, once), (3, never), (4, f"{once} w0 {once}"), (4, f"{once} w0 {once}"))
    plain = sorted((r.doc_id, r.log_prob) for r in lm.scored(probe, known, values).collect())
    found = sorted((r.doc_id, r.log_prob) for r in lm.scored(probe, known, values, counts=counts).collect())
    of = 3 + 1 + 0.5 * 3
    shares = [np.log(3.5 / of), np.log(1.5 / of), np.log(0.5 / of)] + [2 * np.log(1.5 / of)] * 2
    assert [b - a for (_, a), (_, b) in zip(plain, found, strict=True)] == pytest.approx(shares)
    whole = {r.doc_id: r.log_prob for r in lm.lm_score(docs, rounds=1).collect()}
    assert whole[3] == 0 and whole[2] < np.log(1.5 / of)


def test_entries_grow_with_the_words_counted(documents, monkeypatch):
    assert lm.side_for(0) == lm.CLASSES < lm.side_for(10**8) < lm.side_for(10**10)
    monkeypatch.setattr(lm, "side_for", lambda n: 40)
    docs = documents((1, " ".join(f"a{i}" for i in range(2000))), (2, "a1 a2 b"))
    known = lm.vocabulary(docs)
    assert len(known) == known.own == 1200 and known.hashed == 400
    assert all(np.isfinite(r.log_prob) and r.log_prob < 0 for r in lm.lm_score(docs).collect())
    net = lm.Network(lm.fresh(side=40))
    around = np.zeros((4, 1600), np.int32) + np.array([[1], [2], [1500], [lm.PAD]])
    assert np.exp(net.score(around, np.arange(1600)).astype(float)).sum() == pytest.approx(1, abs=1e-3)
