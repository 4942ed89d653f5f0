"""Document fingerprints from improbable features, in chained Bloom filters.

A feature is a window of ``WINDOW`` bytes. Its entropy says how ordinary it is: a histogram of
the entropies of all windows of all documents ranks them, rare entropies first, and windows of
next to no entropy (runs of one byte) are never chosen. A window is selected if it is the best
ranked of its neighbourhood for at least ``OFTEN`` of the ``NEIGHBOURS`` places of a sliding
span, so selection moves with the text and ignores what stands far away. Where no window is, as
in texts of few spans, the best ranked of the whole text is selected. Selected features
are hashed into Bloom filters of 2048 bits, ``PER_FILTER`` features each; the chain of filters is
the digest. Two digests are compared filter by filter: the overlap of set bits beyond what
chance gives, as a part of the most there can be, best match per filter, weighted by its bits.

Neighbouring documents are found by ranges of the id: each range is sorted by itself, and the
first row of a range is also given to the range before, so no order is ever taken over the
whole table and every text is shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapengine.llm.common import col, text_of

WINDOW = 32
NEIGHBOURS, OFTEN = 64, 16
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 128
LEVELS = 1000
# Entropy, of 1000, below which a window is never selected.
LEAST_ENTROPY = 250
_NEVER = 1 << 20
# Bytes looked at together.
_CHUNK = 1 << 19

_SCALE = 1 << 16
_parts = np.array([0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)])
# What one more of a byte, of which there are c, adds to the sum of c * log2(c).
_STEP = np.diff(np.rint(_parts * _SCALE)).astype(np.int64)
_MOST = WINDOW * math.log2(WINDOW) * _SCALE


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy, from 0 to ``LEVELS``, of the window that begins at each byte.

    Sliding a window adds one byte and drops one; what that changes depends only on how many
    equal bytes are among the ``WINDOW - 1`` before, and after. Equal bytes are neighbours in
    the stable order by value.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(data, kind="stable").astype(np.int32)
    value = data[order].astype(np.int32)
    place = order + value * np.int32(n + WINDOW)
    before, after = np.zeros(n, dtype=np.int8), np.zeros(n, dtype=np.int8)
    for m in range(1, WINDOW):
        close = place[m:] - place[:-m] < WINDOW
        if not close.any():
            break
        before[m:] += close
        after[:-m] += close
    added, dropped = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    added[order], dropped[order] = _STEP[before], _STEP[after]
    total = np.cumsum(added)[WINDOW - 1 :]
    total[1:] -= np.cumsum(dropped)[: n - WINDOW]
    return np.rint(LEVELS * (1 - total / _MOST)).astype(np.int64)


def _joined(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of at most ``_CHUNK`` bytes, several in one array: bytes, first bytes, numbers."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if len(t) > _CHUNK:
            continue
        if size + len(t) > _CHUNK and some:
            yield _array(texts, some)
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield _array(texts, some)


def _array(texts: list[bytes], some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(texts[i]) for i in some])
    return np.frombuffer(b"".join([texts[i] for i in some]), np.uint8), np.cumsum(sizes) - sizes, np.array(some)


def histogram(texts: list[bytes]) -> np.ndarray:
    """How often each entropy occurs among all windows of the texts."""
    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for data, first, some in _joined(texts):
        found = entropies(data)
        # Windows that run over the end of a text are none.
        left = np.repeat(np.append(first[1:], len(data)), [len(texts[i]) for i in some])[: len(found)] - np.arange(len(found))
        counts += np.bincount(found[left >= WINDOW], minlength=LEVELS + 1)
    for t in texts:
        if len(t) > _CHUNK:
            for at in range(0, len(t) - WINDOW + 1, _CHUNK):
                part = np.frombuffer(t, np.uint8, min(_CHUNK + WINDOW - 1, len(t) - at), at)
                counts += np.bincount(entropies(part), minlength=LEVELS + 1)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy: the rarest first, ties and unseen ones by entropy."""
    ranks = np.empty(LEVELS + 1, dtype=np.int64)
    ranks[np.lexsort((np.arange(LEVELS + 1), counts))] = np.arange(LEVELS + 1)
    ranks[:LEAST_ENTROPY] = _NEVER
    return ranks


def _sliding_least(values: np.ndarray) -> np.ndarray:
    """Minimum of every ``NEIGHBOURS`` consecutive values, by minima up to and from block edges."""
    n = len(values)
    blocks = -(-n // NEIGHBOURS)
    padded = np.full(blocks * NEIGHBOURS, np.iinfo(np.int64).max)
    padded[:n] = values
    grid = padded.reshape(blocks, NEIGHBOURS)
    upto = np.minimum.accumulate(grid, axis=1).ravel()
    from_ = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_[: n - NEIGHBOURS + 1], upto[NEIGHBOURS - 1 : n])


_PLACE = 1 << 40


def _selected(data: np.ndarray, first: np.ndarray, size: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected windows of several short texts: number of the text, place in ``data``."""
    found = entropies(data)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = ranks[found] * _PLACE + np.arange(len(found))
    owner = np.repeat(np.arange(len(size)), size)
    windows = np.maximum(size - WINDOW + 1, 0)
    last = first + windows
    often = np.zeros(len(found), dtype=np.int64)
    if len(found) >= NEIGHBOURS:
        best = _sliding_least(key)
        start = np.arange(len(best))
        inside = start + NEIGHBOURS <= last[owner[: len(best)]]
        best = best[inside]
        often += np.bincount(best[best < _NEVER * _PLACE] % _PLACE, minlength=len(found))
    chosen = [np.flatnonzero(often >= OFTEN)]
    # A text in which none is best that often, as in one of few windows, has them all for one neighbourhood.
    none = np.bincount(owner[chosen[0]], minlength=len(size)) == 0
    few = np.flatnonzero((windows > 0) & none)
    if len(few):
        edges = np.stack([first[few], last[few]], axis=1).ravel()
        best = np.minimum.reduceat(np.append(key, np.iinfo(np.int64).max), edges)[::2]
        chosen.append(best[best < _NEVER * _PLACE] % _PLACE)
    at = np.sort(np.concatenate(chosen))
    return owner[at], at


def _selected_long(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Selected windows of one long text, a stretch at a time; counts run on across stretches."""
    spans = len(data) - WINDOW + 1 - NEIGHBOURS + 1
    carried, out = np.zeros(0, dtype=np.int64), []
    for a in range(0, spans, _CHUNK):
        b = min(a + _CHUNK, spans)
        found = entropies(data[a : b - 1 + NEIGHBOURS + WINDOW - 1])
        best = _sliding_least(ranks[found] * _PLACE + np.arange(len(found)))
        often = np.bincount(best[best < _NEVER * _PLACE] % _PLACE, minlength=len(found))
        often[: len(carried)] += carried
        done = b - a if b < spans else len(often)
        out.append(a + np.flatnonzero(often[:done] >= OFTEN))
        carried = often[done:]
    at = np.concatenate(out)
    return at if len(at) else _best(data, ranks)


def _best(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The best ranked window of one text, the first of several; none if all are monotonous."""
    least, place = _NEVER, np.zeros(0, dtype=np.int64)
    for a in range(0, len(data) - WINDOW + 1, _CHUNK):
        found = ranks[entropies(data[a : a + _CHUNK + WINDOW - 1])]
        k = int(found.argmin())
        if found[k] < least:
            least, place = found[k], np.array([a + k])
    return place


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """Digest of each text: its filters, one after the other.

    A text in which nothing is selected, being too short or too monotonous, has itself as its
    only feature.
    """
    places: list[np.ndarray | None] = [None] * len(texts)
    for data, first, some in _joined(texts):
        size = np.array([len(texts[i]) for i in some])
        owner, at = _selected(data, first, size, ranks)
        cuts = np.searchsorted(owner, np.arange(len(some) + 1))
        for k, i in enumerate(some):
            places[i] = at[cuts[k] : cuts[k + 1]] - first[k]
    hashed: list[bytes] = []
    count = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = places[i] if places[i] is not None else _selected_long(np.frombuffer(t, np.uint8), ranks)
        view = memoryview(t)
        features = [view[p : p + WINDOW] for p in own.tolist()] or [view]
        count[i] = len(features)
        hashed += [xxhash.xxh3_128_digest(f) for f in features]
    bits = np.frombuffer(b"".join(hashed), "<u2").reshape(-1, 8)[:, :HASHES] % FILTER_BITS
    filters = -(-count // PER_FILTER)
    base = np.cumsum(filters) - filters
    within = np.arange(len(bits)) - np.repeat(np.cumsum(count) - count, count)
    filter_ = np.repeat(base, count) + within // PER_FILTER
    table = np.zeros((int(filters.sum()), FILTER_BITS), dtype=bool)
    table[filter_[:, None], bits] = True
    packed = np.packbits(table, axis=1, bitorder="little")
    return [packed[b : b + f].tobytes() for b, f in zip(base.tolist(), filters.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """From 0 to 1. Each filter of the shorter digest against its best match in the other."""
    if a == b:
        return 1.0
    if len(b) < len(a):
        a, b = b, a
    x, y = (np.frombuffer(d, "<u8").reshape(-1, FILTER_BITS // 64) for d in (a, b))
    nx, ny = (np.bitwise_count(v).sum(axis=1).astype(float) for v in (x, y))
    total = 0.0
    for row, n in zip(x, nx, strict=True):
        common = np.bitwise_count(y & row).sum(axis=1)
        chance = n * ny / FILTER_BITS
        most = np.minimum(n, ny) - chance
        total += n * float(np.clip((common - chance) / most, 0, 1).max())
    return min(1.0, total / float(nx.sum()))


# --- over a corpus ------------------------------------------------------------------

def corpus_ranks(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of entropies from all windows of all documents; at most 1001 rows are collected."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in batches:
            total += histogram([t.encode() for t in batch[0].to_pylist()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["level", "n"])

    parts = docs.select(text_of(text).alias("text")).mapInArrow(counted, "level long, n long")
    counts = np.zeros(LEVELS + 1, dtype=np.int64)
    for row in parts.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return ranks_of(counts)


def digest(text: Column, ranks: np.ndarray) -> Column:
    """Digest of the whole text; NULL counts as empty. Equal texts have equal digests."""

    @F.pandas_udf("binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[bytes] = []
            for at in range(0, len(texts), 512):
                out += digests([t.encode() for t in texts[at : at + 512]], ranks)
            yield pd.Series(out, dtype=object)

    return found(text_of(text))


def compared(text: Column, own: Column, following: Column, ranks: np.ndarray) -> Column:
    """Struct ``digest, near_own, near_following``: digest of a text, and its owner's digest's
    likeness to it and to another digest. One function, so one Python worker per task."""

    @F.pandas_udf("digest binary, near_own double, near_following double")
    def found(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, owns, others in batches:
            new: list[bytes] = []
            for at in range(0, len(texts), 512):
                new += digests([t.encode() for t in texts[at : at + 512]], ranks)
            yield pd.DataFrame({
                "digest": new,
                "near_own": [likeness(a, b) for a, b in zip(owns, new, strict=True)],
                "near_following": [likeness(a, b) for a, b in zip(owns, others, strict=True)],
            })

    return found(text_of(text), own, following)


def _range_of(id: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the id, by binary search; NULL ids come first."""
    if not bounds:
        return F.lit(0)
    table = F.lit(bounds).cast("array<long>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def step(x: Column, _: Column) -> Column:
        middle = F.floor((x["low"] + x["high"]) / 2).cast("int")
        up = F.get(table, middle) <= id
        going = x["low"] < x["high"]
        return F.struct(
            F.when(going & up, middle + 1).otherwise(x["low"]).alias("low"),
            F.when(going & ~up, middle).otherwise(x["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.when(id.isNull(), 0).otherwise(F.aggregate(steps, start, step, lambda x: x["low"]))


def with_next(docs: DataFrame, id: str, carried: list[str], rows_per_range: int = 8192) -> DataFrame:
    """Adds ``next_<name>`` for each carried column: its value in the row with the next id.

    After the last row comes the first. NULL ids come first; ties are ordered by the carried
    columns. ``docs`` is read twice: once for its ids alone.
    """
    ids = docs.select(col(id).cast("long").alias("id"))
    facts = ids.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.count("id").alias("known")).first()
    ranges = max(1, math.ceil(facts["n"] / rows_per_range))
    steps = [k / ranges for k in range(1, ranges)]
    found = ids.agg(F.percentile_approx("id", F.array(*map(F.lit, steps)), max(10_000, 10 * ranges)).alias("b")).first()["b"] if steps else []
    # Bounds are ids that occur, so each is the first of its range.
    bounds = sorted({b for b in found or [] if b > facts["least"]})
    last = len(bounds)
    number = F.col("range")
    nobody = F.array().cast("array<struct<range:int,turn:int>>")
    is_bound = (number > 0) & (F.get(F.lit(bounds).cast("array<long>"), number - 1) == col(id)) if bounds else F.lit(False)
    first_of_all = col(id).isNull() if facts["known"] < facts["n"] else col(id) == F.lit(facts["least"])
    places = F.concat(
        F.array(F.struct(number.alias("range"), F.lit(0).alias("turn"))),
        F.when(is_bound, F.array(F.struct((number - 1).alias("range"), F.lit(1).alias("turn")))).otherwise(nobody),
        F.when(first_of_all, F.array(F.struct(F.lit(last).alias("range"), F.lit(2).alias("turn")))).otherwise(nobody),
    )
    spread = docs.withColumn("range", _range_of(col(id).cast("long"), bounds)).withColumn("place", F.explode(places))
    order = Window.partitionBy("place.range").orderBy(
        "place.turn", col(id).asc_nulls_first(), *[F.xxhash64(col(c)) for c in carried])
    return (
        spread.withColumns({f"next_{c}": F.lead(col(c)).over(order) for c in carried})
        .where("place.turn = 0").drop("range", "place")
    )


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest`` of every row; the general form, without neighbours."""
    return docs.select(col(id).alias("doc_id"), digest(col(text), corpus_ranks(docs, text)).alias("digest"))


def edited_likeness(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """How digests follow an edit: ``doc_id, n_chars, edited_text, digest, edited_digest,
    near_edited, near_next``.

    The edited text has the last half of the document, in code points and rounded down,
    replaced by as many first ones of the next document by id, or by all it has; the first
    follows the last. NULL texts are empty. Rows that share an id, or have none, follow each
    other in a fixed order; a single row is its own next. An empty table gives an empty table.
    Other columns are not looked at.
    """
    ranks = corpus_ranks(docs, text)
    slim = docs.select(col(id).alias("doc_id"), text_of(text).alias("text"))
    follow = with_next(slim.withColumn("digest", digest(F.col("text"), ranks)), "doc_id", ["text", "digest"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    changed = follow.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited_text"), "digest", "next_digest"
    ).withColumn("c", compared(F.col("edited_text"), F.col("digest"), F.col("next_digest"), ranks))
    return changed.select(
        "doc_id", "n_chars", "edited_text", "digest", F.col("c.digest").alias("edited_digest"),
        F.col("c.near_own").alias("near_edited"), F.col("c.near_following").alias("near_next"),
    )
