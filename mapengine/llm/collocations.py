"""Phrase collocations by direct-address tiling, frequent pairs re-ranked recursively.

Texts are cut into slices of at most ``SLICE_WORDS`` words (or one longer document) and coded once.
From then on a corpus is a sequence of ids per slice, and every level does the same:

1. ids are ranks by frequency, the most frequent first; what is too rare has none. Ranks are taken in each of
   P parts of all words or pairs, dealt by a hash, and interleaved: rank r of part p is id r * P + p;
2. neighbouring ids are pairs. Ranked by frequency, pairs crowd into few tiles of ``TILE`` x ``TILE`` ids: in a
   slice a crowded tile is counted by direct address, with one dense ``bincount``; all others as sorted coordinates;
3. the slices' coordinates of a part are sorted together and summed, pairs found often enough are ranked in their
   turn, and the sequences are recoded with their ids. A pair of neighbouring (k-1)-word phrases is a k-word phrase,
   so level after level gives longer phrases, and none is missed: both its pairs are at least as frequent.

A slice gets back only the ids of its own pairs, so a task's memory follows its slice or its part, and no table
of phrases is broadcast or collected. A part holds at most one entry of a pair for each slice, so a very frequent
pair makes none large. Coordinates travel packed, a row for each slice and part; the sequences travel once a
level and lose what is rare.

Words are `[^\\x20\\x09]+` inside pieces between `[.,;:!?\\x0A-\\x0D]`, with A-Z lower-cased. A NULL text is empty, a
NULL language is ``und``; a text without words, or an empty table, adds nothing. Repeated rows count each time. A
document is never cut, so the longest one bounds a task's memory. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapengine.llm.common import col, stored

SLICE_WORDS = 2_000_000
# Bytes of text per part: some four million words.
PART_BYTES = 24_000_000
TILE = 1024
# Pairs per cell from which a tile is counted by direct address.
CROWDED = 1 / 16

UNKNOWN = "und"

# Fixed characters: ends of pieces become line feeds, tabs become blanks, A-Z become a-z.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_CODED = bytes.maketrans(
    _ENDS + b"\t" + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(_ENDS) + b" " + b"abcdefghijklmnopqrstuvwxyz")

_KEY = [("slice", pa.int64()), ("lang", pa.string())]
_PACKED = [(c, pa.binary()) for c in ("a", "b", "n")]
_SLICES = pa.schema([*_KEY, ("seq", pa.binary()), ("size", pa.int64()), ("part", pa.int32()), ("words", pa.list_(pa.binary())), *_PACKED])
_PAIRS = pa.schema([*_KEY, ("seq", pa.binary()), ("part", pa.int32()), *_PACKED])
_IDS = pa.schema([*_KEY, *_PACKED, ("id", pa.int64()), ("f", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("word", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.binary()): "array<binary>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _batch(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    """A batch of the given columns; the others are NULL."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, their bytes sorted by place and compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def part_of(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """The part a pair belongs to, in every slice."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in order, a line feed after every piece, some items empty."""
    return (text.translate(_CODED) + b"\n").replace(b"\n", b" \n ").split(b" ")


def _joined(seq: np.ndarray) -> np.ndarray:
    """Runs of missing ids (-1) as one."""
    known = seq >= 0
    return seq[known | np.r_[False, known[:-1]]]


class _Slice:
    """Words of one language coded in order of appearance; -1 ends a piece."""

    def __init__(self):
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.blank, self.end = self.ids[b""], self.ids[b"\n"]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> int:
        words = words_of(text)
        coded = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        coded = _joined(coded[coded != self.blank] - 2)
        self.parts.append(coded)
        self.size += len(coded)
        return len(coded)

    def batch(self, slice_: int, lang: str, parts: int) -> pa.RecordBatch:
        """A row with the sequence, and one for the words of every part."""
        seq = np.concatenate(self.parts)
        words = np.empty(len(self.ids) - 2, object)
        words[:] = list(self.ids)[2:]
        n = np.bincount(seq[seq >= 0], minlength=len(words))
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int32, len(words))
        rows = [(packed(seq), int(n.sum()), None, None, None, None)]
        for p, own in _by_part(part):
            rows.append((None, None, p, words[own].tolist(), packed(own), packed(n[own])))
        seqs, sizes, numbers, lists, ids, counts = map(list, zip(*rows, strict=True))
        return _batch(_SLICES, slice=[slice_] * len(rows), lang=[lang] * len(rows), seq=seqs, size=sizes, part=numbers, words=lists, a=ids, n=counts)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every part that occurs and the places of its members, in order."""
    order = np.argsort(part, kind="stable")
    found, start = np.unique(part[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, start[1:]), strict=True) if len(found) else ()


def coded(documents: DataFrame, parts: int, text: str = "text", lang: str = "lang", slice_words: int = SLICE_WORDS) -> DataFrame:
    """Slices: a row with each one's sequence, and one for its distinct words of every part, with their counts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, open_, size = TaskContext.get().partitionId(), count(), defaultdict(_Slice), 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                size += open_[lang].add(text)
                if size >= slice_words:
                    slice_ = (task << 32) + next(number)
                    for name in list(open_):
                        yield open_.pop(name).batch(slice_, name, parts)
                    size = 0
        slice_ = (task << 32) + next(number)
        for name in list(open_):
            yield open_.pop(name).batch(slice_, name, parts)

    own = documents.select(
        F.coalesce(col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(col(text), F.lit("")).cast("binary").alias("text"))
    return stored(own.mapInArrow(cut, _ddl(_SLICES)), "slices")


def tiled_counts(a: np.ndarray, b: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of local ranks and how often each occurs."""
    across = int(max(a.max(initial=0), b.max(initial=0))) // tile + 1
    tiles = (a // tile) * across + b // tile
    sizes = np.bincount(tiles, minlength=1) if across * across <= 4 * len(a) + 4 else None
    if sizes is None:  # far more tiles than pairs: hardly any can be crowded
        found, place, n = np.unique(tiles, return_inverse=True, return_counts=True)
        crowded = found[n >= CROWDED * tile * tile]
        dense = (n >= CROWDED * tile * tile)[place]
    else:
        crowded = np.flatnonzero(sizes >= CROWDED * tile * tile)
        dense = (sizes >= CROWDED * tile * tile)[tiles]
    out = []
    if len(crowded):
        order = np.argsort(tiles[dense], kind="stable")
        own_a, own_b, own_t = a[dense][order], b[dense][order], tiles[dense][order]
        edges = np.r_[np.searchsorted(own_t, crowded), len(own_t)]
        for t, start, stop in zip(crowded, edges[:-1], edges[1:], strict=True):
            cells = np.bincount((own_a[start:stop] % tile) * tile + own_b[start:stop] % tile, minlength=tile * tile)
            hit = np.flatnonzero(cells)
            out.append(((t // across) * tile + hit // tile, (t % across) * tile + hit % tile, cells[hit]))
    width = across * tile
    code, n = np.unique(a[~dense] * width + b[~dense], return_counts=True)
    out.append((code // width, code % width, n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pairs_of(seq: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbouring ids and how often each occurs."""
    known = np.unique(seq[seq >= 0])  # ascending ids are descending frequency, so local ranks keep their order
    local = np.searchsorted(known, seq)
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    a, b, n = tiled_counts(local[:-1][both], local[1:][both], tile)
    return known[a], known[b], n


def recoded(seq: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of every pair of neighbours, -1 where the pair has none."""
    out = np.full(max(0, len(seq) - 1), -1, np.int64)
    if len(ids) and len(out):
        known = np.unique(np.r_[a, b])
        width = len(known)
        code = np.searchsorted(known, a) * width + np.searchsorted(known, b)
        order = np.argsort(code)
        code, ids = code[order], ids[order]
        local = np.searchsorted(known, seq)
        local[(local == width) | (known[np.minimum(local, width - 1)] != seq)] = -1
        both = np.flatnonzero((local[:-1] >= 0) & (local[1:] >= 0))
        wanted = local[both] * width + local[both + 1]
        place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        hit = code[place] == wanted
        out[both[hit]] = ids[place[hit]]
    return _joined(out)


def _ranked(x: np.ndarray, y: np.ndarray, n: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums ``n`` over equal pairs. Place of a first entry and sum of every frequent pair, most frequent
    first, and the rank of every entry's pair, -1 for a rare one."""
    order = np.lexsort((y, x))
    first = np.flatnonzero(np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]) if len(x) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(x) else n
    often = np.flatnonzero(sums >= min_count)
    often = often[np.argsort(-sums[often], kind="stable")]
    rank = np.full(len(first), -1, np.int64)
    rank[often] = np.arange(len(often))
    entries = np.empty(len(x), np.int64)
    entries[order] = np.repeat(rank, np.diff(np.r_[first, len(x)]))
    return order[first[often]], sums[often], entries


def _given_back(rows: pa.Table, sizes: list[int], rank: np.ndarray, parts: int, part: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """To every slice the ids of its own frequent words or pairs."""
    edges = np.r_[0, np.cumsum(sizes)]
    found = []
    for slice_, lang, start, stop in zip(rows["slice"].to_pylist(), rows["lang"].to_pylist(), edges[:-1], edges[1:], strict=True):
        own = start + np.flatnonzero(rank[start:stop] >= 0)
        if len(own):
            found.append((slice_, lang, packed(np.diff(a[own], prepend=0)), packed(b[own]), packed(rank[own] * parts + part)))
    if found:
        yield _batch(_IDS, **dict(zip(("slice", "lang", "a", "b", "n"), map(list, zip(*found, strict=True)), strict=True)))


def _word_ids(slices: DataFrame, parts: int, min_count: int) -> DataFrame:
    """Frequent words with their ids, and the ids of every slice's own words, stored."""

    def count_part(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        lists = rows["words"].combine_chunks()
        words = pa.concat_arrays([c.flatten() for c in lists.chunks]) if isinstance(lists, pa.ChunkedArray) else lists.flatten()
        coded = words.dictionary_encode()
        own, n = (np.concatenate([unpacked(x) for x in rows[c].to_pylist()]) for c in ("a", "n"))
        langs = rows["lang"].combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        sizes = [len(x) for x in lists]
        lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes)
        first, sums, rank = _ranked(lang, coded.indices.to_numpy(zero_copy_only=False), n, min_count)
        out = [_batch(_IDS, lang=langs.dictionary.take(pa.array(lang[first])).to_pylist(), f=sums, id=np.arange(len(first)) * parts + part,
                      word=words.take(pa.array(first)).cast(pa.string()))]
        out += _given_back(rows, sizes, rank, parts, part, own, np.full(len(own), -1))
        return pa.Table.from_batches(out, _IDS)

    return stored(slices.where(F.col("part").isNotNull()).groupBy("part").applyInArrow(count_part, _ddl(_IDS)), "ids")


def _pair_ids(pairs: DataFrame, parts: int, min_count: int) -> DataFrame:
    """Frequent pairs (``x``, ``y``) with their ids, and the ids of every slice's own pairs, stored."""

    def count_part(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        each = [np.cumsum(unpacked(x)) for x in rows["a"].to_pylist()]
        a = np.concatenate(each)
        b, n = (np.concatenate([unpacked(x) for x in rows[c].to_pylist()]) for c in ("b", "n"))
        first, sums, rank = _ranked(a, b, n, min_count)
        out = [_batch(_IDS, f=sums, id=np.arange(len(first)) * parts + part, x=a[first], y=b[first])]
        out += _given_back(rows, [len(x) for x in each], rank, parts, part, a, b)
        return pa.Table.from_batches(out, _IDS)

    return stored(pairs.where(F.col("part").isNotNull()).groupBy("part").applyInArrow(count_part, _ddl(_IDS)), "ids")


def _next_level(seqs: DataFrame, ids: DataFrame, parts: int, of_words: bool, keep: bool) -> DataFrame:
    """Sequences recoded with the slices' ids, and the counts of their pairs by part, stored."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _PAIRS.empty_table()
        slice_, lang, seq = left["slice"][0].as_py(), left["lang"][0].as_py(), unpacked(left["seq"][0].as_py())
        a = np.concatenate([np.cumsum(unpacked(x)) for x in right["a"].to_pylist()])
        b, own = (np.concatenate([unpacked(x) for x in right[c].to_pylist()]) for c in ("b", "n"))
        if of_words:
            known = np.full(max(seq.max(initial=0), a.max()) + 2, -1, np.int64)  # the last stays -1, for the ends
            known[a] = own
            seq = _joined(known[seq])
        else:
            seq = recoded(seq, a, b, own)
        a, b, n = pairs_of(seq)
        rows = [(packed(seq), None, None, None, None)] if keep else []
        for p, at in _by_part(part_of(a, b, parts)):
            rows.append((None, p, packed(np.diff(a[at], prepend=0)), packed(b[at]), packed(n[at])))
        if not rows:
            return _PAIRS.empty_table()
        columns = dict(zip(("seq", "part", "a", "b", "n"), map(list, zip(*rows, strict=True)), strict=True))
        return pa.Table.from_batches([_batch(_PAIRS, slice=[slice_] * len(rows), lang=[lang] * len(rows), **columns)], _PAIRS)

    own = seqs.where(F.col("seq").isNotNull()).select("slice", "lang", "seq")
    asked = ids.where(F.col("slice").isNotNull()).select(F.col("slice").alias("of_slice"), F.col("lang").alias("of_lang"), "a", "b", "n")
    grouped = own.groupBy("slice", "lang").cogroup(asked.groupBy("of_slice", "of_lang"))
    return stored(grouped.applyInArrow(step, _ddl(_PAIRS)), "pairs")


def _longer(ids: DataFrame, shorter: DataFrame) -> DataFrame:
    """Frequent pairs of phrases as phrases one word longer, with the counts of all they begin and end with."""
    pairs = ids.where(F.col("x").isNotNull()).select("id", "f", F.col("x").alias("a"), F.col("y").alias("b"))
    x = shorter.select(
        F.col("id").alias("a"), "lang", F.col("phrase").alias("start"), F.concat("begins", F.array("f")).alias("begins"))
    y = shorter.select(F.col("id").alias("b"), F.col("last"), F.concat("ends", F.array("f")).alias("ends"))
    return stored(
        pairs.join(x, "a").join(y, "b").select(
            "id", "lang", "f", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "begins", "ends", "a", "b"),
        "phrases")


def _scored(phrases: DataFrame, size: int, sizes: DataFrame) -> DataFrame:
    """The least score over all cuts of phrases of ``size`` words, in exact whole numbers."""
    wide = "decimal(19,0)"

    def cut(k: int) -> Column:
        l, r = F.get("begins", F.lit(k - 1)), F.get("ends", F.lit(size - k - 1))
        return F.struct(
            F.expr(f"(cast(1000 * f as {wide}) * cast(n as {wide})) div (cast(begins[{k - 1}] as {wide}) * cast(ends[{size - k - 1}] as {wide}))").alias("score"),
            F.lit(k).alias("k"), l.alias("l"), r.alias("r"))

    least = F.array_min(F.array(*[cut(k) for k in range(1, size)]))
    return phrases.join(sizes, "lang").withColumn("cut", least).select(
        "id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(
    documents: DataFrame,
    longest: int = 5,
    min_count: int = 100,
    first: int | None = 2000,
    held_percent: int = 100,
    text: str = "text",
    lang: str = "lang",
    slice_words: int = SLICE_WORDS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the strongest phrases of 2 to ``longest`` words per language.

    ``a`` is how often a phrase occurs, ``n`` the words of the language, and the score floor(1000 * a * n / (l * r)) of
    the weakest cut into a first part, found l times, and a rest, found r times. A phrase inside a longer one that
    is found at least ``held_percent``% as often is left out. ``first`` per language, None for all.
    """
    size = documents.agg(F.sum(F.octet_length(col(text)).cast("long"))).first()[0]
    parts = max(1, math.ceil((size or 0) / part_bytes))
    slices = coded(documents, parts, text, lang, slice_words)
    sizes = slices.where(F.col("size") > 0).groupBy("lang").agg(F.sum("size").alias("n"))
    ids = _word_ids(slices, parts, min_count)
    none = F.array().cast("array<bigint>")
    phrases = ids.where(F.col("word").isNotNull()).select(
        "id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("begins"), none.alias("ends"))
    seqs, out = slices, None
    for size in range(2, longest + 1):
        seqs = _next_level(seqs, ids, parts, of_words=size == 2, keep=size < longest)
        ids = _pair_ids(seqs, parts, min_count)
        shorter, phrases = phrases, _longer(ids, phrases)
        if size > 2:
            out = _whole(scored, shorter, phrases, out, held_percent)
        scored = _scored(phrases, size, sizes)
        if phrases.isEmpty():
            break
    out = scored if out is None else out.unionByName(scored)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    top = out.withColumn("rank", F.row_number().over(order))
    if first is not None:
        top = top.where(F.col("rank") <= first)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _whole(scored: DataFrame, shorter: DataFrame, longer: DataFrame, out: DataFrame | None, held_percent: int) -> DataFrame:
    """Adds the phrases of one size that no phrase a word longer holds. What a still longer one holds, one of these does."""
    inside = longer.select(F.inline(F.array(F.struct(F.col("a").alias("id"), "f"), F.struct(F.col("b").alias("id"), "f"))))
    most = inside.groupBy("id").agg(F.max("f").alias("most"))
    held = shorter.join(most, "id").where(F.col("most") * 100 >= F.col("f") * held_percent).select("id")
    kept = scored.join(held, "id", "left_anti")
    return kept if out is None else out.unionByName(kept)
