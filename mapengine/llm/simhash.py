"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most
``max_distance`` = k bits. Fingerprints are cut into ``k // 2 + 1`` segments, so that of any
two linked ones at least one segment differs by at most one bit. Every fingerprint is indexed
under each segment as it is, and under each segment with one bit made a wildcard. Equal index
keys are candidates, found by an equality join; the whole distance is verified.

Equal fingerprints are one row from the start: a group of copies of any size adds nothing.

A key under which many different fingerprints meet would give pairs in the square of their
number. Such keys are *crowded* (more than ``CROWDED`` rows), and are treated exactly in
another way: what is outside the key is given its own variants, with as many wildcards as
bits may still differ. Fingerprints that agree in such a variant are linked for certain, so
each is tied to the smallest that shares it: rows in proportion to members, no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.llm.common import col, stored, text_of, unused
from mapengine.llm.components import components

BITS = 64
SEED = 42
CROWDED = 64
# Shingles counted at a time, so that a very long text takes no more memory for its bits.
_AT_ONCE = 1 << 15


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; 0 without words.

    As bytes, ``lower`` and ``split`` know A-Z and the ASCII blanks only.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return _majority([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return _majority([xxhash.xxh64_intdigest(s, SEED) for s in joined])


def _majority(hashes: list[int]) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for i in range(0, len(values), _AT_ONCE):
        bits = np.unpackbits(values[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Fingerprint of the whole text as a signed LONG; NULL counts as empty."""

    @F.pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return fingerprints(text_of(text))


def _segments(parts: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _bound(expression: Callable[..., Column], *fixed: Column) -> Callable[[Column], Column]:
    return lambda x: expression(x, *fixed)


def _keys(fps: DataFrame, parts: int) -> DataFrame:
    """``fp, seg, wild, rest, side``: index rows of every fingerprint.

    ``wild`` is the wildcard bit or -1, ``rest`` the segment with that bit cleared, ``side``
    the value of the bit. Rows with a wildcard are compared only across sides; pairs that
    agree in the bit meet under the segment as it is.
    """
    fp, one = F.col("fp"), F.lit(1).cast("long")
    rows = []
    for number, (first, width) in enumerate(_segments(parts)):
        seg, rest = F.lit(number).alias("seg"), fp.bitwiseAND(F.lit(_mask(range(first, first + width))))

        def wildcard(w: Column, seg: Column, rest: Column) -> Column:
            bit = F.call_function("shiftleft", one, w)
            side = F.when(fp.bitwiseAND(bit) != 0, 1).otherwise(0)
            return F.struct(seg, w.alias("wild"), rest.bitwiseAND(F.bitwise_not(bit)).alias("rest"), side.alias("side"))

        rows.append(F.array(F.struct(seg, F.lit(-1).alias("wild"), rest.alias("rest"), F.lit(0).alias("side"))))
        rows.append(F.transform(
            F.sequence(F.lit(first), F.lit(first + width - 1)),
            _bound(wildcard, seg, rest),
        ))
    return fps.select("fp", F.inline(F.concat(*rows)))


def links(fps: DataFrame, max_distance: int = 2) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints ``fp`` that span all links.

    Every edge is a link; fingerprints that are linked are connected by edges.
    """
    fps = stored(fps.select("fp"), "fingerprints")
    parts = max_distance // 2 + 1
    key = ["seg", "wild", "rest"]
    counted = (
        _keys(fps, parts).groupBy(*key)
        .agg(
            F.count("*").alias("n"), F.sum("side").alias("ones"),
            F.min("fp").alias("least"), F.max("fp").alias("most"),
        )
        # Nobody to compare with: alone, or all on one side of the wildcard.
        .where("n > 1 AND (wild < 0 OR (ones > 0 AND ones < n))")
    )
    counted = stored(counted, "buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    two = counted.where("n = 2").select(F.col("least").alias("u"), F.col("most").alias("v")).where(near)

    more = counted.where("n > 2").select(*[F.col(k).alias(f"k_{k}") for k in key], "n")
    same = [F.col(k) == F.col(f"k_{k}") for k in key]
    members = stored(_keys(fps, parts).join(more, same).select("fp", *key, "side", "n"), "members")

    few = members.where(F.col("n") <= CROWDED)
    a = few.select(*key, F.col("fp").alias("u"), F.col("side").alias("us"))
    b = few.select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("fp").alias("v"), F.col("side").alias("vs"))
    across = (F.col("wild") < 0) & (F.col("u") < F.col("v")) | (F.col("us") < F.col("vs"))
    pairs = a.join(b, [*same, across, near]).select("u", "v")

    stars = [
        _stars(members.where(F.col("n") > CROWDED), number, first, width, max_distance)
        for number, (first, width) in enumerate(_segments(parts))
    ]
    out = two.unionByName(pairs)
    for s in stars:
        out = out.unionByName(s)
    return out.distinct()


def _stars(crowded: DataFrame, number: int, first: int, width: int, max_distance: int) -> DataFrame:
    """Links within crowded keys of one segment, through variants of the other bits."""
    outside = [b for b in range(BITS) if not first <= b < first + width]
    out = None
    for under, left in (("wild < 0", max_distance), ("wild >= 0", max_distance - 1)):
        masks = [_mask(set(outside) - set(c)) for c in combinations(outside, min(left, len(outside)))]
        # A mask is its own name: together with key and what it leaves, it is the variant.
        variant = F.explode(F.array(*[F.lit(m) for m in masks])) if masks else F.lit(0)
        spread = (
            crowded.where(f"seg = {number} AND {under}").select("fp", "wild", "rest", variant.alias("mask"))
            .withColumn("left", F.col("fp").bitwiseAND(F.col("mask")))
        )
        group = ["wild", "rest", "mask", "left"]
        least = spread.groupBy(*group).agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
        least = least.select(*[F.col(g).alias(f"g_{g}") for g in group], "least")
        tied = (
            spread.join(least, [F.col(g) == F.col(f"g_{g}") for g in group])
            .select(F.col("least").alias("u"), F.col("fp").alias("v")).where("u <> v").distinct()
        )
        out = tied if out is None else out.unionByName(tied)
    return out


def classes(prints: DataFrame, max_distance: int = 2) -> DataFrame:
    """``fp, component_id, label`` for every fingerprint in ``doc_id, fp``.

    ``component_id`` is the smallest document id reachable, NULL only where no document of
    the component has one; ``label`` is a fingerprint that names the component.
    """
    own = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = components(links(own, max_distance)).select(F.col("node").alias("node"), "component")
    labelled = own.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("label")
    )
    named = labelled.groupBy("label").agg(F.min("first").alias("component_id")).select(
        F.col("label").alias("l"), "component_id"
    )
    return labelled.join(named, F.col("label") == F.col("l")).select("fp", "component_id", "label")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 2
) -> DataFrame:
    """``doc_id, fp, component_id``, one row per row of ``docs``.

    Texts are lower-cased in A-Z and cut at ASCII blanks. NULL, empty and blank texts have
    fingerprint zero and are linked like any other; texts shorter than a shingle are one
    shingle. Rows that share an id are rows of their own. A NULL id never names a component
    that has another; a component of rows without ids has NULL. Other columns are not looked
    at. An empty table gives an empty table.
    """
    prints = stored(docs.select(col(id).alias("doc_id"), fingerprint(col(text), shingle).alias("fp")), "prints")
    named = classes(prints, max_distance).select(F.col("fp").alias("f"), "component_id")
    return prints.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, max_distance: int = 2
) -> DataFrame:
    """One row of each component: the one with the smallest id. Columns as they were.

    Of rows that tie in id and fingerprint one stays. Rows without an id stay only where
    their component has no id at all, and then one does. Texts are shuffled once, by
    fingerprint and id, and only those that stay go on.
    """
    fp, first = unused(docs, "fp", "first")
    prints = stored(docs.withColumn(fp, fingerprint(col(text), shingle)), "prints")
    slim = prints.select(col(id).alias("doc_id"), col(fp).alias("fp"))
    labelled = classes(slim, max_distance)
    own = slim.groupBy("fp").agg(F.min("doc_id").alias("first")).select(F.col("fp").alias("f"), "first")
    # One fingerprint of each component: the smallest among those of its smallest id.
    chosen = (
        own.join(labelled, F.col("f") == F.col("fp")).where(F.col("first").eqNullSafe(F.col("component_id")))
        .groupBy("label").agg(F.min("fp").alias("k"), F.min("component_id").alias(first)).select("k", first)
    )
    kept = prints.join(chosen, (col(fp) == F.col("k")) & col(id).eqNullSafe(col(first)), "left_semi")
    return kept.dropDuplicates([fp]).select(*[col(c) for c in docs.columns])
