"""Quality rules: a learned decision list over text statistics.

Statistics of whole texts are Column expressions. On a bounded sample of labelled documents
sequential covering grows one rule after another: a conjunction of thresholds is grown while it
gains information on two thirds of the sample, pruned from its end on the last third, and kept
if it is precise there; what it covers is taken away and the next rule is grown. The list is
emitted as one ordered CASE expression, so that judging a corpus is a projection without any
shuffle, and rules can be read and edited.

Only a bounded sample of labelled statistics comes to the driver. The main path is DataFrame
operations alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapengine.llm.common import BLANK_RUN, col, text_of, unused, words

# At most so many labelled documents are learned from.
MAX_LABELLED = 6000
# The base check: so many words at least, and at most so many percent in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


# --- statistics ---------------------------------------------------------------------

def _removed(text: Column, pattern: str) -> Column:
    """Number of characters that match ``pattern``, a class."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _repeated_words(found: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted by hash, so equal ones are neighbours; their places, sorted, cover up
    to three new words each. Sorting keeps it n log n for texts of any length.
    """
    size = F.size(found)
    hashed = F.transform(
        F.sequence(F.lit(0), size - 3),
        lambda i: F.struct(F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("i")),
    )

    def places(sorted_: Column) -> Column:
        # Arrays of arrays hand a value on, so that it is computed once.
        same = F.filter(
            F.transform(sorted_, lambda w, k: F.when(
                (w["h"] == F.get(sorted_, k - 1)["h"]) | (w["h"] == F.get(sorted_, k + 1)["h"]), w["i"])),
            lambda i: i.isNotNull(),
        )
        return F.array_sort(same)

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda i, k: F.least(F.lit(3), i - F.coalesce(F.get(at, k - 1), F.lit(-3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    counted = once(F.array_sort(hashed), lambda s: once(places(s), covered))
    return F.when(size < 3, 0).otherwise(counted).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with words and lines as columns of unused names, and the counts over them."""
    w, n = unused(docs, "words", "lines")
    content = text_of(text)
    split = docs.withColumns({
        w: words(content),
        n: F.filter(F.split(content, "\n", -1), lambda x: F.length(F.regexp_replace(x, BLANK_RUN, "")) > 0),
    })
    counts = {
        "n_words": F.size(col(w)),
        "word_chars": F.char_length(F.array_join(col(w), "")),
        "n_symbols": _removed(content, r"[#*$%&|<>]"),
        "n_dup_lines": F.size(col(n)) - F.size(F.array_distinct(col(n))),
        "n_repeat_words": _repeated_words(col(w)),
        "n_lines": F.size(col(n)),
        "n_capitals": _removed(content, r"\p{Lu}"),
        "n_marks": _removed(content, r"[!?]"),
    }
    return split, {k: v.cast("long") for k, v in counts.items()}


def measured(docs: DataFrame, text: str = "text", only: Sequence[str] = COUNTS) -> DataFrame:
    """Adds the counts named in ``only``; columns of these names are replaced.

    Words are runs of anything but the ASCII blanks. NULL and empty texts count zero
    everywhere.
    """
    split, counts = with_counts(docs, text)
    kept = [c for c in docs.columns if c.lower() not in {o.lower() for o in only}]
    once = F.inline(F.array(F.struct(*[counts[c].alias(c) for c in only])))
    return split.select(*[col(c) for c in kept], once)


FEATURES = {
    "n_words": lambda c: c["n_words"],
    "mean_word": lambda c: c["word_chars"] / c["n_words"],
    "symbol_share": lambda c: c["n_symbols"] / c["n_words"],
    "dup_line_share": lambda c: c["n_dup_lines"] / c["n_lines"],
    "repeat_share": lambda c: c["n_repeat_words"] / c["n_words"],
    "capital_share": lambda c: c["n_capitals"] / c["word_chars"],
    "mark_share": lambda c: c["n_marks"] / c["n_words"],
}


def features(counts: dict[str, Column]) -> dict[str, Column]:
    """Statistics that rules test; a share of nothing is 0."""
    as_double = {k: v.cast("double") for k, v in counts.items()}
    positive = {k: F.when(v > 0, v) for k, v in as_double.items()}
    out = {}
    for name, feature in FEATURES.items():
        used = as_double if name == "n_words" else {**positive, **{k: as_double[k] for k in _NUMERATORS}}
        out[name] = F.coalesce(feature(used), F.lit(0.0))
    return out


_NUMERATORS = ("n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks")


# --- learning -----------------------------------------------------------------------

@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        values = x[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, x: dict[str, Column]) -> Column:
        value, bound = x[self.feature], F.lit(self.threshold)
        return value > bound if self.above else value <= bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _candidates(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int) -> list[Condition]:
    """Thresholds at quantiles, and at values next to which rows of the other kind begin."""
    out = []
    for name, values in x.items():
        if not len(values):
            continue
        order = np.argsort(values, kind="stable")
        kind = bad[order]
        edges = values[order][:-1][kind[1:] != kind[:-1]]
        # Evenly among all of them: where classes are mixed there are very many.
        edges = edges[np.linspace(0, len(edges) - 1, min(len(edges), 2 * cuts)).astype(int)] if len(edges) else edges
        levels = np.unique(np.append(np.quantile(values, np.linspace(0, 1, cuts + 1)[1:-1]), edges))
        out += [Condition(name, above, float(v)) for v in levels for above in (True, False)]
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, candidates: list[Condition], most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        best, gain = None, 1e-9
        for condition in candidates:
            now = inside & condition.holds(x)
            p1, n1 = int((now & bad).sum()), int((now & ~bad).sum())
            if p1 and (g := p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n)))) > gain:
                best, gain = condition, g
        if best is None:
            break
        best = _centred(best, x[best.feature][inside])
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _centred(condition: Condition, values: np.ndarray) -> Condition:
    """The same cut, in the middle of the gap between the values on either side of it."""
    below, above = values[values <= condition.threshold], values[values > condition.threshold]
    middle = (below.max() + above.min()) / 2 if len(below) and len(above) else condition.threshold
    return Condition(condition.feature, condition.above, float(middle))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops conditions from the end while that does not make the rule worse on new data."""

    def worth(r: Rule) -> float:
        inside = _covers(r, x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(
    x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3,
    cuts: int = 32, precision: float = 0.95, least: int = 3,
) -> list[Rule]:
    """Rules that find ``bad`` rows, in order. Rows must come in an order unrelated to both.

    A rule stays if, on the third it was not grown on, at least ``precision`` of what it covers
    is bad. No rules are learned without examples of both kinds.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    held_out = np.arange(len(bad)) % 3 == 2
    failed = 0
    while len(rules) < max_rules and failed < 3:
        grow, prune = left & ~held_out, left & held_out
        if (bad & grow).sum() < least or not (~bad & grow).any():
            break
        gx, px = ({k: v[m] for k, v in x.items()} for m in (grow, prune))
        rule = _prune(_grow(gx, bad[grow], _candidates(gx, bad[grow], cuts), max_conditions), px, bad[prune])
        inside = _covers(rule, x, len(bad)) & left
        seen, hits = int((inside & held_out).sum()), int((inside & held_out & bad).sum())
        all_seen, all_hits = int(inside.sum()), int((inside & bad).sum())
        if rule and all_seen and all_hits >= precision * all_seen and (not seen or hits >= precision * seen):
            rules.append(rule)
            failed = 0
        else:
            # Nothing precise is to be had among these; go on with the others.
            failed += 1
        if not inside.any():
            break
        left &= ~inside
    return rules


@dataclass(frozen=True)
class DecisionList:
    rules: list[Rule]

    def rejected_by(self, counts: dict[str, Column]) -> Column:
        """Number of the first rule that holds, from 1, or NULL: one ordered CASE."""
        x = features(counts)
        out = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            holds = F.lit(True)
            for condition in rule:
                holds = holds & condition.column(x)
            out = F.when(holds, F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "reject nothing"


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    max_labelled: int = MAX_LABELLED, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, **options,
) -> DecisionList:
    """Learns from at most ``max_labelled`` labelled documents, chosen by a hash of the id, that
    pass the base check: rules are for what it leaves.

    ``labels`` has ``id`` and a ``label`` of 1 for good and 0 for bad; rows without either are
    ignored. Documents without a label, and labels without a document, play no part.
    """
    chosen = (
        labels.where(col(id).isNotNull() & col(label).isNotNull())
        .select(col(id).alias("labelled"), col(label).cast("int").alias("good"))
        .orderBy(F.xxhash64("labelled"), "labelled", "good").limit(max_labelled)
    )
    # At most ``max_labelled`` rows of two numbers: small whatever the tables' size.
    slim = docs.select(col(id).alias("doc_id"), text_of(text).alias("text"))
    found = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = measured(found, "text").select("doc_id", "good", *COUNTS).limit(2 * max_labelled).collect()
    rows = [r for r in rows if r["n_words"] >= min_words and 100 * r["n_repeat_words"] <= max_repeated * r["n_words"]]
    rows.sort(key=lambda r: tuple(r))
    order = np.random.default_rng(5).permutation(len(rows))
    data = np.array([tuple(rows[i])[1:] for i in order], dtype=float).reshape(-1, 1 + len(COUNTS))
    counts = dict(zip(COUNTS, data[:, 1:].T, strict=True))
    with np.errstate(all="ignore"):
        x = {k: np.nan_to_num(np.asarray(f(counts), dtype=float), nan=0.0, posinf=0.0) for k, f in FEATURES.items()}
    return DecisionList(learn(x, data[:, 0] == 0, **options))


BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(
    docs: DataFrame, rules: DecisionList, text: str = "text", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED
) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with its counts, and columns ``base_failed``, ``rule``, ``kept`` over them.

    A document fails the base check with fewer than ``min_words`` words, or with over
    ``max_repeated`` percent of its words in repeated windows. Otherwise it is kept unless a
    rule holds. The texts' counts are columns of unused names.
    """
    split, counts = with_counts(docs, text)
    names = dict(zip(COUNTS, unused(split, *COUNTS), strict=True))
    # A row of a one-row table per document: no later filter is moved below it, which would
    # compute each count once more for every rule that tests it.
    once = F.inline(F.array(F.struct(*[counts[c].alias(n) for c, n in names.items()])))
    counted = split.select(*[col(c) for c in docs.columns], once)
    c = {k: col(n) for k, n in names.items()}
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeated * c["n_words"])
    rule = rules.rejected_by(c)
    return counted, {**c, "base_failed": failed, "rule": rule, "kept": ~failed & rule.isNull()}


def quality(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Verdicts: ``doc_id, n_words``, the base counts, ``base_failed, kept, rule``.

    One row per row of ``docs``, repeated rows included. NULL, empty and blank texts have no
    words and fail. An empty table gives an empty table; labels that teach nothing reject
    nothing. Columns other than id and text are not looked at.
    """
    rules = fit(docs, labels, id, text, **options)
    slim = docs.select(col(id).alias("doc_id"), col(text).alias("text"))
    counted, c = judged(slim, rules)
    return counted.select(
        "doc_id", c["n_words"].alias("n_words"), *[c[b].alias(b) for b in BASE],
        c["base_failed"].alias("base_failed"), c["kept"].alias("kept"), c["rule"].alias("rule"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without what is rejected; columns as they were."""
    rules = fit(docs, labels, id, text, **options)
    counted, c = judged(docs, rules, text)
    return counted.where(c["kept"]).select(*[col(x) for x in docs.columns])
