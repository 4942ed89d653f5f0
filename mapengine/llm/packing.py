"""Mixture-controlled packing of token streams by deficit round-robin.

Every source is a queue of documents in a fixed random order. Rounds go over the queues: each
adds a quantum, its share of ``length`` tokens, to the queue's deficit; the queue serves as many
whole tokens as its deficit has, and carries the rest into the next round. The served tokens, one
after the other, fill the sequences, so every sequence has the target proportions to within a
token or two of each source. An empty queue drops out and the others share on.

Because documents may be cut anywhere, the state of all queues before round r is known without
playing the rounds before it: queue s has served ``min(size_s, floor(r * quantum_s))`` tokens.
So deficits are carried across sequences and partitions by arithmetic, and every task places
its own documents once it knows where they begin in their queues. Those beginnings are prefix
sums that cut hot sources into ranges.

The largest sources have queues of their own. All others, however many, hang in a tree of small
groups whose root is one more queue: a group is the stream that a round-robin of its members
gives, with their own proportions, and has the sum of their weights in the group above. A
document's place is worked out level by level, from the streams on its path alone, which come
to it by a join.

Only the last sequence can be short; it is cut into sequences of falling powers of two, so that
nothing is padded at all.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mapengine.llm.common import col, running_total, stored, text_of
from mapengine.llm.tokens import PIECE
from mapengine.workspace import new_dir

# Queues of their own; all further, smaller sources form one more queue, a tree, together.
MAX_QUEUES = 256
# Members of a group in the tree: exactly so many groups at most, and about so many sources.
FAN = 16
# Documents, and pieces at most, that are placed together; a document is never divided.
_TOGETHER, _PIECES = 512, 1 << 16
# Quanta are multiples of this part of a token, so that positions are exact in 64 bits.
_FRACTION = 16
_SPECIAL = "<|"


@lru_cache(maxsize=2)
def _library(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=2)
def _ranked(ranks: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=known, special_tokens={})


def encode(texts: list[str], vocabulary: str, ranks: str | None) -> list[np.ndarray]:
    """Ids of each text as the tokenizers library gives them for the file ``vocabulary``.

    ``ranks`` is the same vocabulary for tiktoken, which is three times as fast and gives the
    same ids for ordinary text. Texts with anything that looks like a special token, or with
    characters that the two may class differently, go to the tokenizers library.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    for i, text in enumerate(texts):
        if ranks and _SPECIAL not in text and _same_classes(text):
            out[i] = _ranked(ranks).encode_to_numpy(text, disallowed_special=())
    rest = [i for i, ids in enumerate(out) if ids is None]
    # A few at a time: encodings are large.
    for at in range(0, len(rest), 64):
        some = rest[at : at + 64]
        found = _library(vocabulary).encode_batch_fast([texts[i] for i in some], add_special_tokens=False)
        for i, encoding in zip(some, found, strict=True):
            out[i] = np.array(encoding.ids, dtype=np.uint32)
    return out


def _same_classes(text: str) -> bool:
    """Whether a text is ASCII or otherwise within Latin-1, where Unicode versions agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def token_ids(text: Column, vocabulary: str, ranks: str | None, end_id: int, width: int) -> Column:
    """Ids of the whole text and ``end_id``, as little-endian integers of ``width`` bytes."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([
                np.append(found, end_id).astype(f"<u{width}").tobytes()
                for found in encode(list(texts), vocabulary, ranks)
            ], dtype=object)

    return ids(text_of(text))


class Schedule:
    """Where every token of every queue goes. ``sizes`` and ``weights`` by queue number."""

    def __init__(self, sizes: list[int], weights: list[float], length: int):
        self.length = length
        self.sizes = np.array(sizes, dtype=np.int64)
        share = np.array(weights, dtype=float) / (sum(weights) or 1.0)
        self.quanta = np.maximum(1, np.rint(share * length * (1 << _FRACTION))).astype(np.int64)
        total = int(self.sizes.sum())
        self.full, rest = divmod(total, length)
        # Sequences after the full ones: powers of two that add up to the rest.
        parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.edges = self.full * length + np.cumsum([0, *parts], dtype=np.int64)

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Tokens of ``queue`` served before each of ``rounds``."""
        return np.minimum(self.sizes[queue], (rounds * self.quanta[queue]) >> _FRACTION)

    def pieces(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that begin at ``begin`` in ``queue``: document's index, first
        token within it, length, sequence and offset there."""
        return self._cut(*self.stream(queue, begin, size))

    def stream(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Stretches of the same documents that are served at once: document's index, first token
        within it, length and position among all tokens served."""
        quanta = self.quanta[queue]
        # The round that serves a token: the last one before which no more was served.
        first = _round_of(begin, quanta)
        n = _round_of(begin + size - 1, quanta) - first + 1
        # Where there are fewer tokens than rounds, most rounds serve none: list those of the tokens.
        few = size < n
        n = np.where(few, size, n)
        doc = np.repeat(np.arange(len(queue)), n)
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rounds = np.where(few[doc], _round_of(begin[doc] + turn, quanta[doc]), first[doc] + turn)
        new = (np.diff(doc, prepend=-1) != 0) | (np.diff(rounds, prepend=-1) != 0)
        doc, rounds = doc[new], rounds[new]
        own = queue[doc]
        before, within = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for s in range(len(self.sizes)):
            now = self.served(s, rounds)
            before += now
            within += np.where(s < own, self.served(s, rounds + 1) - now, 0)
        start_of_turn = np.minimum(self.sizes[own], (rounds * self.quanta[own]) >> _FRACTION)
        end_of_turn = np.minimum(self.sizes[own], ((rounds + 1) * self.quanta[own]) >> _FRACTION)
        low = np.maximum(begin[doc], start_of_turn)
        high = np.minimum((begin + size)[doc], end_of_turn)
        position = before + within + low - start_of_turn
        return doc, low - begin[doc], high - low, position

    def slices(self, queue: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
        """First document and number of documents that are placed together."""
        quanta = self.quanta[queue]
        most = np.minimum(size, _round_of(begin + size - 1, quanta) - _round_of(begin, quanta) + 1)
        before = np.append(0, np.cumsum(most))
        at = 0
        while at < len(queue):
            end = int(np.searchsorted(before, before[at] + _PIECES, side="right")) - 1
            end = min(max(end, at + 1), at + _TOGETHER)
            yield at, end - at
            at = end

    def _cut(self, doc, start, length, position) -> tuple[np.ndarray, ...]:
        """Cuts pieces where sequences end."""
        done: list[tuple[np.ndarray, ...]] = []
        while len(doc):
            tail = np.searchsorted(self.edges, position, side="right") - 1
            full = position < self.full * self.length
            sequence = np.where(full, position // self.length, self.full + tail)
            at = np.where(full, sequence * self.length, self.edges[np.clip(tail, 0, None)])
            end = np.where(full, at + self.length, self.edges[np.clip(tail + 1, 0, len(self.edges) - 1)])
            here = np.minimum(length, end - position)
            some = here > 0
            done.append(tuple(x[some] for x in (doc, start, here, sequence, position - at)))
            more = length > here
            doc, start, length, position = (x[more] for x in (doc, start + here, length - here, position + here))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 5


def _round_of(token: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """The round r with floor(r * quantum) <= token < floor((r + 1) * quantum)."""
    return ((token + 1 << _FRACTION) + quanta - 1) // quanta - 1


def _tree(sources: DataFrame, n_sources: int) -> DataFrame:
    """``name, path`` of each of ``sources`` (``name, n, w``): the groups it is in, root first, each
    with the sizes and weights of its members and the number of its own member there."""
    groups = -(-n_sources // FAN)
    nodes = sources.select(F.pmod(F.xxhash64("name"), F.lit(groups)).alias("g"), F.col("name").alias("m"), "n", "w")
    found, below = nodes.select(F.col("m").alias("name"), "g", "m"), []
    while True:
        lists = nodes.groupBy("g").agg(
            F.array_sort(F.collect_list(F.struct("m", "n", "w"))).alias("of"), F.sum("n").alias("n"), F.sum("w").alias("w"))
        step = F.struct(
            F.col("of.n").alias("sizes"), F.col("of.w").cast("array<double>").alias("weights"),
            (F.array_position("of.m", F.col("m")) - 1).cast("int").alias("own"))
        found = found.join(lists.select("g", "of"), "g").withColumn("path", F.concat(F.array(step), *below))
        if groups == 1:
            return found.select("name", "path")
        groups = -(-groups // FAN)
        up = F.floor(F.col("g") / FAN)
        nodes = lists.select(up.alias("g"), F.col("g").alias("m"), "n", "w")
        found, below = found.select("name", up.alias("g"), F.col("g").alias("m"), "path"), [F.col("path")]


def _nested(top: Schedule, path: list[dict]) -> list[tuple[Schedule, int]]:
    """The schedules on a path, ``top`` first, and the number of its own queue in each.

    A round of a group is as long as what its parent serves of it in one round, so that
    sequences have the group's proportions, but for a token per member at least.
    """
    out = [(top, len(top.sizes) - 1)]
    for step in path:
        above, own = out[-1]
        length = max(len(step["sizes"]), int(above.quanta[own]) >> _FRACTION)
        out.append((Schedule(step["sizes"], step["weights"], length), step["own"]))
    return out


def _nested_pieces(levels: list[tuple[Schedule, int]], begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces as ``Schedule.pieces`` gives them, for documents of one source in the tree."""
    doc, start, length, position = np.arange(len(begin)), np.zeros(len(begin), np.int64), size, begin
    for schedule, own in reversed(levels):
        of, first, length, position = schedule.stream(np.full(len(doc), own), position, length)
        doc, start = doc[of], start[of] + first
    return levels[0][0]._cut(doc, start, length, position)


def pack(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    length: int = 2048,
    end_id: int = 1,
    weights: Mapping[str | None, float] | None = None,
    seed: int = 11,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, source, start, length, doc_tokens, sequence_id,
    offset`` and ``ids``, the piece's tokens as little-endian unsigned 32-bit integers.

    ``vocabulary`` is a file of the tokenizers library, ``ranks`` the same for tiktoken, which
    only saves time. Every document ends in ``end_id``. ``weights`` are the target proportions
    of the sources; by default sources have the proportions of their tokens, and all queues
    end together. Every token is in exactly one piece.

    NULL and empty texts are the end token alone. A NULL source is a source of its own. Rows
    that agree in everything are packed each for itself. An empty table gives an empty table.
    Other columns are not looked at. A very long document is one row of tokens, two or four
    bytes each, and is cut into pieces in one task.
    """
    spark = docs.sparkSession
    width = 2 if _library(vocabulary).get_vocab_size() <= 1 << 16 else 4
    content = text_of(text)
    path = new_dir(spark, "tokens")
    tokens = docs.select(
        col(id).alias("doc_id"), col(source).cast("string").alias("source"),
        F.xxhash64(content).alias("th"), token_ids(content, vocabulary, ranks, end_id, width).alias("ids"),
    ).withColumns({
        "draw": F.xxhash64(F.lit(seed), "doc_id", "th"), "n": (F.octet_length("ids") / width).cast("long"),
    })
    tokens.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(tokens.schema).parquet(path)

    totals = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    largest = totals.orderBy(F.col("n").desc(), F.col("source").asc_nulls_last()).limit(MAX_QUEUES)
    ranked = largest.withColumn("queue", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = ranked.collect()  # at most MAX_QUEUES
    sizes = [r["n"] for r in rows] or [1]
    by_source = [float(n) for n in sizes] if weights is None or not rows else [float(weights.get(r["source"], 0.0)) for r in rows]

    queues = spark.createDataFrame([(r["source"], r["queue"]) for r in rows], "queued STRING, queue INT")
    numbered = F.broadcast(queues), F.col("source").eqNullSafe(F.col("queued"))
    queued = tokens.join(*numbered, "left").drop("queued")
    # One name for each source, NULL too.
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    others = totals.join(*numbered, "left_anti").select(name.alias("name"), "n", _weight(spark, name, weights).alias("w"))
    whole = others.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    kept = ["doc_id", "source", "th", "ids", "draw", "n", "queue"]
    if whole["k"]:
        sizes.append(whole["n"])
        by_source.append(float(whole["w"]))
        # Written once: sums of weights may come out differently in another run of a task.
        tree = stored(_tree(others, whole["k"]), "tree")
        kind = tree.schema["path"].dataType.simpleString()
        rest = queued.where("queue IS NULL").withColumn("name", name).join(tree, "name").withColumn("queue", F.lit(len(rows)))
        large = queued.where("queue IS NOT NULL").withColumns({"name": F.lit(""), "path": F.lit(None).cast(kind)})
        queued = large.select(*kept, "name", "path").unionByName(rest.select(*kept, "name", "path"))
        placed = running_total(queued, ["queue", "name"], ["draw", "doc_id", "th"], "n", "begin")
    else:
        placed = running_total(queued.select(*kept), ["queue"], ["draw", "doc_id", "th"], "n", "begin")
    schedule = Schedule(sizes, by_source, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: list[tuple[Schedule, int]] = []
        last = None
        for batch in batches:
            for at, some in _by_source(batch):
                if at is None:
                    for first, n in schedule.slices(*(some[c].to_numpy() for c in ("queue", "begin", "n"))):
                        own = some.slice(first, n)
                        yield _pieces_of(own, schedule.pieces(*(own[c].to_numpy() for c in ("queue", "begin", "n"))), width)
                    continue
                if at != last:
                    levels, last = _nested(schedule, some["path"][0].as_py()), at
                # Every token may be a piece.
                ends = np.cumsum(some["n"].to_numpy())
                first = 0
                while first < len(ends):
                    before = ends[first - 1] if first else 0
                    end = max(first + 1, int(np.searchsorted(ends, before + _PIECES, side="right")))
                    own = some.slice(first, end - first)
                    yield _pieces_of(own, _nested_pieces(levels, own["begin"].to_numpy(), own["n"].to_numpy()), width)
                    first = end

    columns = ["doc_id", "source", "queue", "begin", "n", "ids", *(["name", "path"] if whole["k"] else [])]
    return placed.select(*columns).mapInArrow(
        cut,
        f"doc_id {placed.schema['doc_id'].dataType.simpleString()}, source string, start long, length long, "
        "doc_tokens long, sequence_id long, offset long, ids binary",
    )


def _weight(spark, name: Column, weights: Mapping[str | None, float] | None) -> Column:
    """A source's weight: its tokens where no weights are given."""
    if weights is None:
        return F.col("n")
    given = {"" if k is None else f"={k}": float(v) for k, v in weights.items()}
    if not given:
        return F.lit(0.0)
    # As large as what the caller gave.
    known = F.map_from_arrays(F.array(*map(F.lit, given)), F.array(*map(F.lit, given.values())))
    return F.coalesce(F.element_at(known, name), F.lit(0.0))


def _by_source(batch: pa.RecordBatch) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """Rows of sources with queues of their own under None, all others by the names of their sources.

    Rows come in order of the queue and the name."""
    if "name" not in batch.schema.names:
        yield None, batch
        return
    names = np.array(batch["name"].to_pylist(), dtype=object)
    names[np.array(batch["path"].is_null())] = None
    new = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
    for a, b in zip(new[:-1], new[1:], strict=True):
        if b > a:
            yield names[a], batch.slice(a, b - a)


def _pieces_of(batch: pa.RecordBatch, pieces: tuple[np.ndarray, ...], width: int) -> pa.RecordBatch:
    n = batch["n"].to_numpy()
    doc, start, length, sequence, offset = pieces
    wide = [np.frombuffer(b.as_py(), f"<u{width}").astype("<u4").tobytes() for b in batch["ids"]]
    ids = [wide[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
    taken = batch.select(["doc_id", "source"]).take(pa.array(doc))
    return pa.RecordBatch.from_arrays(
        [taken["doc_id"], taken["source"], *map(pa.array, (start, length, n[doc], sequence, offset)), pa.array(ids, pa.binary())],
        ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )
