import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapengine.llm import packing, tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(VOCABULARY)
COUNTER = tokens.counter(VOCABULARY)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PARTS = ["a", "the", "'", "'r", "re", "'ll", "s", " ", "  ", "\n", "\t", "\xa0", "é", "日", "😀", "1", "23", ".",
         "!!", "<|endoftext|>", "<|endo", "\x1c", "\x85", "A", "ing", "tion", "\u0308"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.integers(0, 9))
def test_every_prefix_is_exact(text, limit):
    want = [len(ids(text[: i + 1])) for i in range(len(text))]
    assert COUNTER.prefixes(text) == want
    within = max([i + 1 for i, n in enumerate(want) if n <= limit], default=0)
    assert COUNTER.count(text, limit) == (want[-1] if want else 0, within)


def test_letters_and_numbers_are_those_of_the_library():
    """Code points that only a newer Unicode version has, among all others."""
    some = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x40000, 7))]
    wrong = [c for c in some if COUNTER.count(f"a{c}1{c}'ll")[0] != len(ids(f"a{c}1{c}'ll"))]
    assert not wrong


def test_long_words_and_full_tables(monkeypatch):
    monkeypatch.setattr(tokens, "_REMEMBERED", 5)
    small = tokens.PrefixCounter(VOCABULARY)
    for text in ("a" * 3000, " " * 900 + "b", "ab" * 700 + "-" * 500):
        assert small.prefixes(text)[-1] == len(ids(text))
        assert small.count(text)[0] == len(ids(text))
    for _ in range(2):
        assert small.count("some words come again and some words do not")[0] == 9
    assert len(small._recent) <= 5


def _merged(rank, letters):
    """Plain byte-pair encoding."""
    parts = list(letters)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
        if (parts[best], parts[best + 1]) not in rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def test_two_tokens_stay_apart_as_plain_merging_says():
    rank, r = COUNTER._rank, random.Random(5)
    known = sorted(COUNTER._vocabulary)
    pairs = [tuple(r.choices(known, k=2)) for _ in range(2000)]
    pairs += [(a[: len(a) // 2], a[len(a) // 2 :] + b) for a, b in pairs]
    pairs += [(w[:at], w[at:]) for w in r.sample(known, 1500) for at in range(1, len(w))]
    pairs = [p for p in pairs if p[0] in COUNTER._vocabulary and p[1] in COUNTER._vocabulary]
    apart = [_merged(rank, a + b) == [a, b] for a, b in pairs]
    assert any(apart) and not all(apart)
    assert [COUNTER._compatible(a, b) for a, b in pairs] == apart
    alone = r.sample(known, 500)
    assert [COUNTER._compatible("", t) for t in alone] == [_merged(rank, t) == [t] for t in alone]


def test_whole_counts_make_no_tables(monkeypatch):
    """Only the unit that a limit cuts needs the counts of all its prefixes."""
    text = " Thheantion, to.01@mail8.example.com\n\n it'll ötesch!!  \xa0é 日本 " * 3
    made, table = [], tokens.PrefixCounter._table
    monkeypatch.setattr(tokens.PrefixCounter, "_table", lambda self, unit: made.append(unit) or table(self, unit))
    new = tokens.PrefixCounter(VOCABULARY)
    assert new.count(text)[0] == len(ids(text)) and not made
    assert new.count(text, 5)[0] == len(ids(text)) and len(made) == 1
    known = len(new._prefixes)
    new.prefixes(text)
    assert known < len(new._prefixes)


def test_counts_over_a_table(spark, documents, awkward):
    docs = documents(*awkward)
    counted = docs.select("text", tokens.token_counts(F.col("text"), VOCABULARY, 3).alias("t"),
                          tokens.prefix_counts(F.col("text"), VOCABULARY).alias("p"))
    rows = counted.select("text", "t.*", "p", tokens.chars_within(F.col("p"), 3).alias("w"),
                          tokens.tokens_of_prefix(F.col("p"), 4).alias("four")).collect()
    for r in rows:
        assert r.n_tokens == len(ids(r.text)) == (r.p[-1] if r.p else 0)
        assert r.within == r.w
        assert r.four == len(ids((r.text or "")[:4]))
    assert counted.where("text = 'nowhere'").count() == 0


def test_both_libraries_give_the_same_ids():
    rng = random.Random(1)
    texts = [a + chr(c) + b for c in range(256) for a in ("a", " ", "1", "!") for b in ("a", " ", "1", "\n", "'s")]
    texts += ["".join(rng.choice(PARTS) for _ in range(20)) for _ in range(100)]
    for fast, slow in zip(packing.encode(texts, VOCABULARY, RANKS), packing.encode(texts, VOCABULARY, None), strict=True):
        assert fast.tolist() == slow.tolist()


def check(pieces, rows, length):
    """Every id in one piece, sequences without gaps, no padding; returns tokens per sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        by_sequence[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i, len(ids(text)) + 1].append([*ids(text), 1])
    assert set(by_doc) == set(want)
    for key, expected in want.items():
        found = sorted(by_doc[key], key=lambda p: p.start)
        # Rows that agree in id and length: every token as often as there are rows.
        count = np.zeros(key[1], int)
        for p in found:
            count[p.start : p.start + p.length] += 1
            assert any(np.array(e[p.start : p.start + p.length], "<u4").tobytes() == bytes(p.ids) for e in expected)
        assert (count == len(expected)).all()
    sizes = {}
    for s, found in by_sequence.items():
        found.sort(key=lambda p: p.offset)
        at = 0
        for p in found:
            assert p.offset == at
            at += p.length
        sizes[s] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == length or n & (n - 1) == 0 for n in sizes.values())
    return sizes


@pytest.mark.parametrize("block", [4096, 4])
def test_packing(documents, monkeypatch, block):
    real = packing.running_total
    monkeypatch.setattr(packing, "running_total", lambda *a: real(*a, rows_per_block=block))
    rows = [(i, "some words " * (1 + i * i % 83), "hot" if i % 3 else f"s{i % 5}") for i in range(200)]
    pieces = packing.pack(documents(*rows), VOCABULARY, RANKS, length=256).collect()
    sizes = check(pieces, rows, 256)
    total = defaultdict(int)
    for p in pieces:
        total[p.source] += p.length
    full = [s for s in sizes if sizes[s] == 256][:-2]
    for s in full:
        for source, n in total.items():
            own = sum(p.length for p in pieces if p.sequence_id == s and p.source == source)
            assert abs(own - 256 * n / sum(total.values())) <= 3


def test_target_weights_and_common_queue(documents, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    rows = [(i, "some words " * 20, f"s{i % 6}" if i % 6 else None) for i in range(60)]
    check(packing.pack(documents(*rows), VOCABULARY, RANKS, length=128).collect(), rows, 128)
    monkeypatch.setattr(packing, "MAX_QUEUES", 256)
    pieces = packing.pack(documents(*rows), VOCABULARY, RANKS, length=128, weights={"s1": 3.0, "s2": 1.0}).collect()
    check(pieces, rows, 128)
    first = [p for p in pieces if p.sequence_id == 1]
    share = {s: sum(p.length for p in first if p.source == s) for s in ("s1", "s2")}
    assert abs(share["s1"] - 96) <= 3 and abs(share["s2"] - 32) <= 3


@pytest.mark.parametrize("weighted", [False, True])
def test_proportions_of_more_sources_than_queues(documents, monkeypatch, weighted):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    monkeypatch.setattr(packing, "FAN", 2)
    # Fourteen sources, one of them NULL, in a tree of several levels below three queues.
    rows = [(i, "some words " * (20 + 5 * (i % 14)), f"s{i % 14}" if i % 14 else None) for i in range(420)]
    names = [None, *(f"s{k}" for k in range(1, 14))]
    given = {name: 1.0 + k % 4 for k, name in enumerate(names)} if weighted else None
    pieces = packing.pack(documents(*rows), VOCABULARY, RANKS, length=512, weights=given).collect()
    sizes = check(pieces, rows, 512)
    total, held = defaultdict(int), defaultdict(int)
    for p in pieces:
        total[p.source] += p.length
        held[p.sequence_id, p.source] += p.length
    share = given or total
    # With weights, until the first source is used up.
    rounds = min(total[s] / (512 * share[s] / sum(share.values())) for s in names)
    full = range(int(rounds) - 2)
    assert len(full) > 10 and all(sizes[s] == 512 for s in full)
    for s in full:
        for name in names:
            assert abs(held[s, name] - 512 * share[name] / sum(share.values())) <= 8, (s, name)


def test_no_weight_at_all_still_packs_everything(documents, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    rows = [(i, "some words " * 9, f"s{i % 5}") for i in range(20)]
    for given in ({}, {"s1": 0.0}):
        check(packing.pack(documents(*rows), VOCABULARY, RANKS, length=64, weights=given).collect(), rows, 64)


def test_packing_awkward_rows(documents, awkward):
    docs = documents(*awkward)
    check(packing.pack(docs, VOCABULARY, RANKS).collect(), awkward, 2048)
    assert packing.pack(docs.where("doc_id < 0"), VOCABULARY, RANKS).count() == 0


def test_checksum_of_a_piece(documents):
    found = packing.pack(documents((1, "some")), VOCABULARY, RANKS).select(F.crc32("ids").alias("c")).collect()
    assert [r.c for r in found] == [zlib.crc32(np.array([*ids("some"), 1], "<u4").tobytes())]


def test_rounds_that_serve_nothing_are_not_listed(monkeypatch):
    # A source of 30 tokens in a corpus of 10**12: its documents span all rounds.
    schedule = packing.Schedule([10**12, 30], [10.0**12, 30.0], 2048)
    queue, size = np.array([1, 1, 1]), np.array([10, 15, 5])
    begin = np.array([0, 10, 25])
    doc, start, length, _, _ = schedule.pieces(queue, begin, size)
    assert len(doc) == 30 and length.tolist() == [1] * 30
    assert (begin[doc] + start).tolist() == list(range(30))
    monkeypatch.setattr(packing, "_PIECES", 12)
    assert list(schedule.slices(queue, begin, size)) == [(0, 1), (1, 1), (2, 1)]
