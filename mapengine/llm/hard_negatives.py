"""Hard negatives by an inverted multi-index: two codebooks, cells, and certified windows.

Vectors are cut into two halves, and each half has a codebook of its own. A row lies in the cell
of its two nearest codewords. For an anchor, a codeword c of one half with radius r bounds the
half-scores of its rows by anchor . c plus and minus |anchor| * r. A heap walks both sorted lists of
half bounds together and gives the cells by descending sum, so when the next cell's sum is below
what is still wanted, no unvisited row can count. Rows of visited cells are scored exactly.

1. Positives: cells are visited until the k-th best score of the anchor's label passes the next sum.
2. Negatives: every positive opens a window of scores, ``low``% to ``high``% of its own. Cells whose
   least sum lies above all windows are passed over; the walk ends when each window is certified: it
   holds k rows at or above the next sum, or the next sum is below its lower end.

Codebooks are fitted on the driver on at most ``SAMPLE`` vectors, the ones with the smallest hashed
ids; they only decide how soon a walk ends. Every row is indexed and every result is exact.
Rows are indexed block by block (``vectors.in_blocks``), with radii of the block's own rows.

Rows with a NULL id, label or vector, or any NULL or non-finite component, take no part; of rows
that share an id the smallest (vector, label) counts. Short vectors count as filled with zeros. Ties go to the
smaller id. A positive with a negative score has an empty window. An empty table, or one with a single
label, gives no rows. Extra columns are not read. Scores must fit 64 bits, else the job stops.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.llm import vectors
from mapengine.llm.common import stored

SAMPLE = 4096
CODEWORDS = 8
_ROUNDS = 12

_POSITIVES = "anchor_id long, positive_id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1)[None, :] - 2 * points @ words.T, axis=1)


def codebook(points: np.ndarray, size: int = CODEWORDS, rounds: int = _ROUNDS) -> np.ndarray:
    """Codewords of one half: rounds of nearest word and mean, from evenly spaced points."""
    distinct = np.unique(points, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(points, words)
        for c in range(len(words)):
            if (own == c).any():
                words[c] = points[own == c].mean(0)
    return words


class MultiIndex:
    """Rows of a block by cell; within a cell by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, words: tuple[np.ndarray, np.ndarray]):
        self.cut = words[0].shape[1]
        halves = [rows[:, : self.cut].astype(float), rows[:, self.cut :].astype(float)]
        own = [_nearest(h, w) for h, w in zip(halves, words, strict=True)]
        self.words, self.radius, self.used = words, [], []
        for h, w, o in zip(halves, words, own, strict=True):
            far = np.sqrt(((h - w[o]) ** 2).sum(1))
            radius = np.zeros(len(w))
            np.maximum.at(radius, o, far)
            self.radius.append(radius)
            self.used.append(np.unique(o))
        self.columns = len(words[1])
        cell = own[0] * self.columns + own[1]
        order = np.lexsort((labels, cell))
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.start = np.searchsorted(cell[order], np.arange(len(words[0]) * self.columns + 1))

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """Cells with rows: greatest and least possible score, and the place of the rows, by descending greatest."""
        parts = (anchor[: self.cut].astype(float), anchor[self.cut :].astype(float))
        lists = []
        for part, words, radius, used in zip(parts, self.words, self.radius, self.used, strict=True):
            middle, reach = words[used] @ part, np.linalg.norm(part) * radius[used]
            order = np.argsort(-(middle + reach), kind="stable")
            lists.append(((middle + reach)[order].tolist(), (middle - reach)[order].tolist(), used[order].tolist()))
        (high, low, a), (high2, low2, b) = lists
        heap, seen = [(-(high[0] + high2[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = a[i] * self.columns + b[j]
            # Sums of rounded products: one unit is far more than they can be off.
            slack = 1 + 1e-9 * abs(bound)
            yield slack - bound, low[i] + low2[j] - slack, slice(self.start[cell], self.start[cell + 1])
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (-(high[i2] + high2[j2]), i2, j2))


class _Best:
    """The k best (score, id) found so far of those not above ``most`` and not below ``least``."""

    def __init__(self, k: int, least: float = -np.inf, most: float = np.inf):
        self.k, self.wanted, self.most, self.found = k, least, most, []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.wanted) & (scores <= self.most)
        if keep.any():
            new = [(-s, i) for s, i in zip(scores[keep].tolist(), ids[keep].tolist(), strict=True)]
            self.found = sorted(self.found + new)[: self.k]
            if len(self.found) == self.k:
                self.wanted = -self.found[-1][0]


def positives(index: MultiIndex, anchor_id: int, label: int, anchor: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(-score, id) of the first k other rows of the anchor's label."""
    best = _Best(k)
    for bound, _, place in index.walk(anchor):
        if bound < best.wanted:
            break
        labels = index.labels[place]
        own = slice(place.start + np.searchsorted(labels, label), place.start + np.searchsorted(labels, label, side="right"))
        ids = index.ids[own]
        scores = index.rows[own] @ anchor
        best.offer(scores[ids != anchor_id], ids[ids != anchor_id])
    return best.found


def negatives(
    index: MultiIndex, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[list[tuple[float, int]]]:
    """(-score, id) of the first k rows of other labels in every window of scores, both ends included."""
    best = [_Best(k, least, most) for least, most in windows]
    above = max((most for least, most in windows if least <= most), default=-np.inf)
    wanted = min((least for least, most in windows if least <= most), default=np.inf)
    for bound, least, place in index.walk(anchor):
        if bound < wanted:
            break
        if least > above or place.start == place.stop:
            continue
        scores = index.rows[place] @ anchor
        near = (scores >= wanted) & (scores <= above) & (index.labels[place] != label)
        if near.any():
            scores, ids = scores[near], index.ids[place][near]
            for b in best:
                b.offer(scores, ids)
            wanted = min(b.wanted for b in best if b.wanted <= b.most)
    return [b.found for b in best]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], names)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column,
    label: str = "label",
    positives_each: int = 5,
    negatives_each: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    block_rows: int = vectors.BLOCK_ROWS,
    group_rows: int = vectors.GROUP_ROWS,
    codewords: int = CODEWORDS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For every anchor, a condition on ``id``, its first rows of the same label, and for each of these the first rows
    of other labels whose score is from ``low``% to ``high``% of the positive's.
    """
    rows = vectors.taking_part(embeddings, label=label)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    points = vectors.matrix(sample["vector"], scale)
    cut = points.shape[1] // 2
    fitted = [codebook(h, codewords) if len(h) else np.zeros((1, h.shape[1])) for h in (points[:, :cut], points[:, cut:])]

    def indexed(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, MultiIndex]:
        anchors, own = vectors.both(left, right, scale)
        more = anchors.shape[1] - fitted[0].shape[1] - fitted[1].shape[1]
        # A vector longer than any of the sample: its further components belong to the second half.
        words = (fitted[0], np.pad(fitted[1], ((0, 0), (0, max(0, more)))))
        if more < 0:
            anchors, own = (np.pad(m, ((0, 0), (0, -more))) for m in (anchors, own))
        return anchors, MultiIndex(right["id"].to_numpy(), right["label"].to_numpy(), own, words)

    def find_positives(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors, index = indexed(left, right)
        found = [
            (a, i, -s)
            for a, own, v in zip(left["id"].to_pylist(), left["label"].to_pylist(), anchors, strict=True)
            for s, i in positives(index, a, own, v, positives_each)
        ]
        yield _batch(found, ["anchor_id", "positive_id", "score"])

    def find_negatives(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        anchors, index = indexed(left, right)
        found = []
        for a, own, v, mates in zip(left["id"].to_pylist(), left["label"].to_pylist(), anchors, left["mates"].to_pylist(), strict=True):
            windows = [_window(m["score"], low, high) for m in mates]
            for m, got in zip(mates, negatives(index, own, v, windows, negatives_each), strict=True):
                found += [(a, m["positive_id"], m["score"], i, -s) for s, i in got]
        yield _batch(found, ["anchor_id", "positive_id", "positive_score", "negative_id", "score"])

    anchors = rows.where(is_anchor)
    mates = vectors.first(
        vectors.in_blocks(anchors, rows, find_positives, _POSITIVES, block_rows, group_rows),
        ["anchor_id"], positives_each, "positive_id")
    # At most ``positives_each`` rows an anchor.
    grouped = mates.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("mates"))
    asked = stored(anchors.join(grouped, "id"), "anchors")
    found = vectors.in_blocks(asked, rows, find_negatives, _NEGATIVES, block_rows, group_rows)
    ranked = vectors.first(found, ["anchor_id", "positive_id"], negatives_each, "negative_id")
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
