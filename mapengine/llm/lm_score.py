"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts every word from the two words on either side of it: embeddings per place
are added up, squashed, and give first the class of the word, then the word within its class,
so a prediction costs two small softmaxes. A document's score is the sum of the log
probabilities of its words, each given both sides.

The counts of all words of all documents are a table. The most frequent words have entries of
their own in the network, the more of them the more words were counted; all others share hashed
entries, and the probability of such a word is that of its entry times the word's share of the
entry's count, which is looked up in the table by a join. A word that was never counted has the
share of half an occurrence. Training is data-parallel and passes over every document once: in
each round every task trains the common parameters on its own documents with plain numpy, and
the results are averaged, weighted by words, in two steps so that no task sees more than
``FAN_IN`` small models, or fewer large ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapengine.llm.common import col, stored, text_of

# The least there is: classes, words in each, and entries that are hashed, a quarter of all.
CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
HASHED = VOCABULARY // 4
# Stands for the last row of the embeddings.
PAD = -1
PLACES = (-2, -1, 1, 2)
WIDTH = 16
BATCH = 8192
ROUNDS = 2
RATE = 0.3
FAN_IN = 512
# Parameters averaged together.
BLOCK = 4096
# No sum of exponentials of logits within this overflows in 32 bits.
_SAFE = 75.0
# Different words counted before they are handed on.
_COUNTED = 500_000
# Occurrences added to the count of every word, and of one that was never counted.
UNSEEN = 0.5


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()


# --- vocabulary ---------------------------------------------------------------------

class Words(dict):
    """Ids of the words with entries of their own. The network has ``side`` classes of ``side``."""

    def __init__(self, ids: dict[bytes, int], side: int = CLASSES):
        super().__init__(ids)
        self.side = side

    def __reduce__(self):
        return Words, (dict(self), self.side)

    @property
    def hashed(self) -> int:
        return self.side * self.side // 4

    @property
    def own(self) -> int:
        return self.side * self.side - self.hashed


def side_for(n_words: int) -> int:
    """Grows with the sixth root of the words counted, so entries grow with their cube root."""
    return max(CLASSES, round(2 * n_words ** (1 / 6)))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` of every word of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch[0].to_pylist():
                counts.update(_words(t))
                if len(counts) >= _COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    parts = docs.select(text_of(text).alias("text")).mapInArrow(counted, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text", counts: DataFrame | None = None) -> Words:
    """Ids of the most frequent words; ties by the word itself. ``counts`` are ``word_counts``.

    The rows collected are three quarters of the network's entries.
    """
    counts = word_counts(docs, text) if counts is None else counts
    known = Words({}, side_for(counts.agg(F.sum("n")).first()[0] or 0))
    top = counts.orderBy(F.col("n").desc(), "word").limit(known.own).collect()
    known.update((bytes(r["word"]), i) for i, r in enumerate(top))
    return known


def ids_of(words: list[bytes], known: Words) -> np.ndarray:
    """Ids of words; the last ``hashed`` ids are shared by all words that are not known."""
    return _ids_and_rare(words, known)[0]


def _ids_and_rare(words: list[bytes], known: Words) -> tuple[np.ndarray, list[bytes]]:
    """Ids of words, and those that are not known, in order."""
    ids = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
    at = np.flatnonzero(ids < 0)
    rare = [words[i] for i in at.tolist()]
    if rare:
        ids[at] = known.own + np.fromiter(map(zlib.crc32, rare), np.int64, len(rare)) % known.hashed
    return ids, rare


def coded(docs: DataFrame, known: Words, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, round, ids, rare`` of every row: ids of its words as little-endian integers,
    and its words without entries of their own, each with its number there."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _id_type(known.side)
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32())]))
        for batch in batches:
            # A few at a time: lists of words are large.
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, words, numbers, ends = [], [], [], [0]
                for t in some[2].to_pylist():
                    found, unknown = _ids_and_rare(_words(t), known)
                    ids.append(found.astype(width).tobytes())
                    rare = Counter(unknown)
                    words += rare
                    numbers += rare.values()
                    ends.append(len(words))
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(numbers, pa.int32())], ["word", "k"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(rare_type)
                yield pa.RecordBatch.from_arrays(
                    [some[0], some[1], pa.array(ids, pa.binary()), lists], ["doc_id", "round", "ids", "rare"])

    slim = docs.select(
        col(id).alias("doc_id"), F.pmod(F.xxhash64(col(id), text_of(text)), F.lit(rounds)).alias("round"),
        text_of(text).alias("text"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(code, f"doc_id {kind}, round long, ids binary, rare array<struct<word:binary,k:int>>")


def _id_type(side: int) -> str:
    return "<u2" if side * side <= 1 << 16 else "<u4"


def _ids(values, side: int) -> list[np.ndarray]:
    return [np.frombuffer(v, _id_type(side)).astype(np.int32) for v in values]


# --- network ------------------------------------------------------------------------

def fresh(seed: int = 3, side: int = CLASSES) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return draw.normal(0, 0.1, shape).astype(np.float32)

    return {
        "embed": normal(len(PLACES), side * side + 1, WIDTH), "bias": np.zeros(WIDTH, np.float32),
        "class_w": normal(WIDTH, side), "class_b": np.zeros(side, np.float32),
        "word_w": normal(side, WIDTH, side), "word_b": np.zeros((side, side), np.float32),
    }


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()])


def shaped(values: np.ndarray, side: int = CLASSES) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, like in fresh(side=side).items():
        out[name] = values[at : at + like.size].reshape(like.shape).astype(np.float32)
        at += like.size
    return out


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def _bounded(layers: np.ndarray) -> bool:
    """Whether no logit of inputs within -1 and 1 overflows. Layers have their bias as last row."""
    return np.abs(layers).sum(axis=-2).max() < _SAFE


def _exps(layer: np.ndarray, inputs: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of logits, a row per word, up to a factor for each row; and their sums."""
    x = inputs @ layer
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], np.float32)


def _log_prob(layer: np.ndarray, inputs: np.ndarray, bounded: bool, wanted: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of every row at its wanted column."""
    x, total = _exps(layer, inputs, bounded)
    return np.log(np.maximum(x[np.arange(len(x)), wanted], np.finfo(np.float32).tiny)) - np.log(total)


def _softmax_error(layer: np.ndarray, inputs: np.ndarray, bounded: bool, wanted: np.ndarray) -> np.ndarray:
    """The softmax of every row, less 1 at its wanted column."""
    x, total = _exps(layer, inputs, bounded)
    x /= total[:, None]
    x[np.arange(len(x)), wanted] -= 1
    return x


def _groups(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by value, the values in it and where each value begins. Values are below ``end``."""
    values = values.astype(np.int16) if end < 1 << 15 else values
    order = np.argsort(values, kind="stable")
    values = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return order, values, np.flatnonzero(new)


class Network:
    """Words of a batch are put in order of their classes once, so that each class is a stretch of rows."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.m = {k: v.copy() for k, v in model.items()}
        self.per_class = model["word_b"].shape[1]
        self.seen = {k: np.full_like(v, 1e-3) for k, v in self.m.items()}

    def hidden(self, around: np.ndarray) -> np.ndarray:
        # Padding, -1, wraps to the last row.
        total = self.m["bias"] + self.m["embed"][0].take(around[0], axis=0, mode="wrap")
        for p in range(1, len(PLACES)):
            total += self.m["embed"][p].take(around[p], axis=0, mode="wrap")
        return np.tanh(total, out=total)

    def _layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases of the classes and of the words in each class."""
        m = self.m
        return np.vstack([m["class_w"], m["class_b"]]), np.concatenate([m["word_w"], m["word_b"][:, None]], axis=1)

    def _by_class(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Order of the words, their classes and numbers within, in that order, and each class's stretch."""
        cls = word // self.per_class
        order, found, first = _groups(cls, self.per_class)
        word = word[order]
        ends = [*first[1:].tolist(), len(word)]
        return order, cls[order], word % self.per_class, list(zip(found[first].tolist(), first.tolist(), ends, strict=True))

    def score(self, around: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log probability of each word given the words around it."""
        order, cls, within, stretches = self._by_class(word)
        inputs = _with_ones(self.hidden(around[:, order]))
        classes, words = self._layers()
        found = _log_prob(classes, inputs, _bounded(classes), cls)
        bounded = _bounded(words)
        for c, a, b in stretches:
            found[a:b] += _log_prob(words[c], inputs[a:b], bounded, within[a:b])
        out = np.empty_like(found)
        out[order] = found
        return out

    def _step(self, name: str, gradient: np.ndarray) -> None:
        """Adagrad: often-changed parameters change less and less."""
        seen = self.seen[name]
        seen += gradient * gradient
        self.m[name] -= RATE * gradient / np.sqrt(seen)

    def _step_rows(self, name: str, place: int, gradient: np.ndarray, rows: np.ndarray) -> None:
        """The same for some rows, each named once, of one place."""
        values, seen = self.m[name][place], self.seen[name][place]
        total = gradient * gradient
        total += seen.take(rows, axis=0, mode="wrap")
        seen[rows] = total
        values[rows] = values.take(rows, axis=0, mode="wrap") - RATE * gradient / np.sqrt(total)

    def train(self, around: np.ndarray, word: np.ndarray) -> None:
        n = len(word)
        order, cls, within, stretches = self._by_class(word)
        around = around[:, order]
        inputs = _with_ones(self.hidden(around))
        classes, words = self._layers()
        error = _softmax_error(classes, inputs, _bounded(classes), cls)
        of_classes, of_words = inputs.T @ error, np.zeros_like(words)
        d_h = error @ classes[:-1].T
        bounded = _bounded(words)
        for c, a, b in stretches:
            error = _softmax_error(words[c], inputs[a:b], bounded, within[a:b])
            of_words[c] = inputs[a:b].T @ error
            d_h[a:b] += error @ words[c, :-1].T
        of_classes /= n
        # Classes without words have no gradient and stay as they are.
        of_words /= n
        self._step("class_w", of_classes[:-1])
        self._step("class_b", of_classes[-1])
        self._step("word_w", of_words[:, :-1])
        self._step("word_b", of_words[:, -1])
        h = inputs[:, :-1]
        d_h *= (1 - h * h) / n
        self._step("bias", d_h.sum(axis=0))
        for p in range(len(PLACES)):
            order, ids, first = _groups(around[p], self.m["embed"].shape[1])
            self._step_rows("embed", p, np.add.reduceat(d_h.take(order, axis=0), first, axis=0), ids[first])


def _windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words around each word, by place, and the words, of several documents one after another."""
    edge = np.full(2, PAD, np.int32)
    joined = np.concatenate([x for d in docs for x in (edge, d)] + [edge])
    real = np.flatnonzero(joined != PAD)
    return np.stack([joined[real + p] for p in PLACES]), joined[real]


def _batches(docs: Iterator[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    some, n = [], 0
    for d in docs:
        some.append(d)
        n += len(d)
        if n >= size:
            yield some
            some, n = [], 0
    if n:
        yield some


# --- training and scoring -----------------------------------------------------------

def trained(docs: DataFrame, known: Words, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after one pass over all documents, a part of them in each round."""
    return _trained(coded(docs, known, id, text, rounds), known.side, rounds)


def _trained(rows: DataFrame, side: int, rounds: int) -> np.ndarray:
    values = flat(fresh(side=side))
    for number in range(rounds):
        start = values

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            net, words = Network(shaped(start, side)), 0
            docs = (d for b in batches for d in _ids(b[0].to_pylist(), side))
            for some in _batches(docs, 16 * BATCH):
                around, word = _windows(some)
                words += len(word)
                for at in range(0, len(word), BATCH):
                    net.train(around[:, at : at + BATCH], word[at : at + BATCH])
            if words:
                part, own = TaskContext.get().partitionId(), flat(net.m).astype("<f4")
                blocks = [own[at : at + BLOCK].tobytes() for at in range(0, len(own), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in ([part] * n, range(n), [words] * n, blocks)], ["part", "block", "words", "model"])

        models = rows.where(F.col("round") == number).select("ids").mapInArrow(local, "part long, block long, words long, model binary")
        merged = _averaged(_averaged(models, F.floor(F.col("part") / FAN_IN)), F.lit(0).cast("long"))
        # One row per block: the parameters, which the driver sends to all tasks.
        blocks = merged.orderBy("block").select("model").collect()
        values = np.concatenate([np.frombuffer(r["model"], "<f4") for r in blocks]) if blocks else values
    return values


def _averaged(models: DataFrame, group) -> DataFrame:
    """Blocks of parameters averaged by words over the models of each group; ``part`` becomes the group."""

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = sum(w * np.frombuffer(m, "<f4").astype(float) for w, m in zip(rows["words"], rows["model"], strict=True))
        words = int(rows["words"].sum())
        mean = (total / words).astype("<f4").tobytes()
        return pd.DataFrame({"part": [int(key[0])], "block": [int(key[1])], "words": [words], "model": [mean]})

    return models.groupBy(group.alias("g"), "block").applyInPandas(mean, "part long, block long, words long, model binary")


def scored(
    docs: DataFrame, known: Words, values: np.ndarray, id: str = "doc_id", text: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, n_words, log_prob``: the sum over all words; 0 for texts without words.

    ``counts`` are ``word_counts`` of what was trained on. Without them a word that has no
    entry of its own is scored as its shared entry, whatever the word.
    """
    rows = coded(docs, known, id, text)
    if counts is None:
        return _scored(rows, known.side, values, "doc_id")
    return _with_shares(stored(rows.withColumn("row", F.monotonically_increasing_id()), "coded"), known, values, counts)


def _scored(rows: DataFrame, side: int, values: np.ndarray, *kept: str) -> DataFrame:
    """The kept columns and ``n_words, log_prob``, as the network has it."""

    def total(coded: pd.Series, net: Network) -> pd.DataFrame:
        docs = _ids(coded, side)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        sums = np.zeros(len(docs))
        first = 0
        while first < len(docs):
            last, n = first, 0
            while last < len(docs) and n < 8 * BATCH:
                n += sizes[last]
                last += 1
            if n:
                around, word = _windows(docs[first:last])
                found = np.concatenate([
                    net.score(around[:, at : at + BATCH], word[at : at + BATCH]) for at in range(0, len(word), BATCH)
                ]).astype(float)
                owner = np.repeat(np.arange(last - first), sizes[first:last])
                sums[first:last] = np.bincount(owner, weights=found, minlength=last - first)
            first = last
        return pd.DataFrame({"n_words": sizes, "log_prob": sums})

    @F.pandas_udf("n_words long, log_prob double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = Network(shaped(values, side))
        for some in batches:
            yield total(some, net)

    return rows.select(*kept, scores("ids").alias("s")).select(*kept, "s.n_words", "s.log_prob")


def _with_shares(rows: DataFrame, known: Words, values: np.ndarray, counts: DataFrame) -> DataFrame:
    """Scores of stored ``rows``: each word beyond the known ones also by its share of its entry.

    The most frequent words are known, so no word is hot in the join.
    """
    spark = rows.sparkSession
    entry = F.pmod(F.crc32("word"), F.lit(known.hashed))
    own = spark.createDataFrame([(w,) for w in known], "word binary")
    # At most one row per shared entry.
    entries = counts.join(F.broadcast(own), "word", "left_anti").groupBy(entry.alias("entry")).agg(
        F.sum("n").alias("of"), F.count("*").alias("different"))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    found = rare.join(counts, "word", "left").join(F.broadcast(entries), entry == F.col("entry"), "left")
    n, of, different = (F.coalesce(c, F.lit(0)) for c in ("n", "of", "different"))
    share = F.log((n + UNSEEN) / (of + UNSEEN * (different + 1)))
    shares = found.groupBy("row").agg(F.sum(F.col("k") * share).alias("share"))
    whole = _scored(rows, known.side, values, "doc_id", "row").join(shares, "row", "left")
    return whole.select("doc_id", "n_words", (F.col("log_prob") + F.coalesce("share", F.lit(0.0))).alias("log_prob"))


def lm_score(docs: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Trains on ``docs`` and scores them: ``doc_id, n_words, log_prob, mean_log_prob``.

    Words are lower-cased in A-Z and cut at ASCII blanks; beyond a text's ends there is a
    padding word, which is never predicted. NULL, empty and blank texts have no words, a
    log probability of 0 and a NULL mean. Repeated rows get equal scores. An empty table gives
    an empty table. Other columns are not looked at. A very long text is scored in stretches.

    Texts are cut into words twice, for the counts and for the stored ids. Rare words, once
    for each document that has them, are shuffled by word and their sums by document.
    """
    counts = stored(word_counts(docs, text), "words")
    known = vocabulary(docs, text, counts)
    rows = stored(coded(docs, known, id, text, rounds).withColumn("row", F.monotonically_increasing_id()), "coded")
    values = _trained(rows, known.side, rounds)
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return _with_shares(rows, known, values, counts).withColumn("mean_log_prob", mean)
