"""Comments, CDATA and instructions that reach over several rows of the scan.

A row is the text from one ``<`` to the next, so what it means depends on the state the text before it
was left in: normal (N), inside a comment (C), CDATA (D) or an instruction (P). What a row does is
written as the four states it leads to, in the order ``NCDP``; most rows change nothing and have no
such mark. Marks are functions, and functions compose: over the marks of a segment, the segments of a
split and the splits of the extract. From the state each split begins in the same walk goes
down again, to the state after every mark. Lists that are walked hold the marks of one segment, the segments of
one split, or one short text for each split. What begins inside a comment is then known as spans between marks; they
are stored as bits, by which the rows are filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapengine.workspace import packed as store

# Position of a row in the extract; sorts in document order.
POSITION = ("file", "block", "seq")
SPLIT = ("file", "block")

# Kind of the staged rows that are no element.
MARK = "!"

STATES = "NCDP"
_IDENTITY = STATES

# Rows per segment, as a power of two.
SEGMENT_BITS = 12

# Bits of a word, as a power of two; a segment has one for each of its rows.
WORD_BITS = 6
# Up to this many segments with rows inside spans, their bits are sent to all tasks (some 150 megabytes at most).
MAX_SENT = 1 << 18
_WORDS = 1 << SEGMENT_BITS - WORD_BITS

# Fixed spellings: begin, end and state of what can hold markup that is none.
_SPANS = (("!--", "-->", "C"), ("![CDATA[", "]]>", "D"), ("?", "?>", "P"))


def special(text: Column) -> Column:
    """Whether a row changes any state."""
    found = text.startswith("!") | text.startswith("?")
    for _, end, _ in _SPANS:
        found = found | text.contains(end)
    return found


def mark(text: Column) -> Column:
    """The states a special row leads to from each state."""
    has = {state: text.contains(end) for _, end, state in _SPANS}
    from_normal = F.lit("N")
    for begin, end, state in reversed(_SPANS):
        # The end of `<!-->` is not in its own beginning.
        closed = F.instr(F.substring(text, len(begin) + 1, F.length(text)), F.lit(end)) > 0
        from_normal = F.when(text.startswith(begin), F.when(closed, "N").otherwise(state)).otherwise(from_normal)
    return F.concat(from_normal, *[F.when(has[s], "N").otherwise(s) for s in STATES[1:]])


def opens(marks: Column) -> Column:
    """Whether a row would begin something that ends in a later row, were it in normal text."""
    return F.left(marks, F.lit(1)) != "N"


def _word(seq: str) -> Column:
    return F.shiftright(seq, WORD_BITS)


def _composed(items: str, field: str) -> str:
    return f"aggregate({items}, '{_IDENTITY}', (f, x) -> translate(f, '{STATES}', x.{field}))"


def _walked(items: str, field: str, state: str) -> str:
    """States before the first item and after each one, a letter each."""
    return f"aggregate({items}, {state}, (s, x) -> concat(s, translate(right(s, 1), '{STATES}', x.{field})))"


def states(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """State before every split; state after every mark (with its position); state at the end."""
    segment = F.shiftright("seq", SEGMENT_BITS)
    marks = rows.where(F.col("mark").isNotNull()).select(*POSITION, segment.alias("segment"), "mark")
    segments = marks.groupBy(*SPLIT, "segment").agg(
        F.sort_array(F.collect_list(F.struct("seq", "mark"))).alias("items")
    ).withColumn("f", F.expr(_composed("items", "mark")))
    splits = segments.groupBy(*SPLIT).agg(F.sort_array(F.collect_list(F.struct("segment", "f", "items"))).alias("segments"))
    splits = rows.select(*SPLIT).distinct().join(splits, list(SPLIT), "left")
    whole = splits.select(*SPLIT, F.coalesce(F.expr(_composed("segments", "f")), F.lit(_IDENTITY)).alias("f")).agg(
        F.sort_array(F.collect_list(F.struct(*SPLIT, "f"))).alias("splits")
    ).withColumn("walk", F.expr(_walked("splits", "f", "'N'")))
    before = whole.select(
        F.inline(F.expr("transform(splits, (x, i) -> struct(x.file AS file, x.block AS block, substring(walk, i + 1, 1) AS before))")))
    walked = splits.join(before, list(SPLIT)).withColumn("walk", F.expr(_walked("segments", "f", "before")))
    by_segment = walked.select(*SPLIT, F.inline(F.expr(
        "transform(segments, (x, i) -> struct(x.items AS items, substring(walk, i + 1, 1) AS before))")))
    after = by_segment.withColumn("walk", F.expr(_walked("items", "mark", "before"))).select(*SPLIT, F.inline(F.expr(
        "transform(items, (x, i) -> struct(x.seq AS seq, substring(walk, i + 2, 1) AS after))")))
    end = whole.select(F.right("walk", F.lit(1))).first()
    return before, after, end[0] if end is not None else "N"


def bounds(rows: DataFrame) -> DataFrame:
    """First and last sequence number of every split."""
    return rows.groupBy(*SPLIT).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))


def span_bits(changes: DataFrame, ends: DataFrame, target: str) -> DataFrame:
    """Rows inside spans, stored at ``target`` as bits: one row for each segment of a split that holds any, with a bit
    for each of its sequence numbers.

    ``changes`` are positions with ``held``: whether the rows after this one, up to and with that of the next change in
    the split, are inside. Of two changes at one row the one that holds comes last. ``ends`` are the ``bounds``. Only
    changes and bits are shuffled, never a row.
    """
    changes = changes.select(*POSITION, "held").unionByName(ends.select(*SPLIT, F.col("last").alias("seq"), F.lit(False).alias("held")))
    in_split = Window.partitionBy(*SPLIT).orderBy("seq", "held")
    spans = changes.select(
        *SPLIT, "held", (F.col("seq") + 1).alias("start"), F.lead("seq").over(in_split).alias("stop"),
    ).where(F.col("held") & (F.col("start") <= F.col("stop")))
    words = spans.select(*SPLIT, "start", "stop", F.explode(F.sequence(_word("start"), _word("stop"))).alias("word"))
    size, ones = 1 << WORD_BITS, "cast(-1 AS bigint)"
    begin = F.greatest(F.col("start") - F.col("word") * size, F.lit(0)).cast("int")
    past = F.greatest((F.col("word") + 1) * size - 1 - F.col("stop"), F.lit(0)).cast("int")
    words = words.select(*SPLIT, "word", begin.alias("begin"), past.alias("past")).groupBy(*SPLIT, "word").agg(
        F.bit_or(F.expr(f"shiftleft({ones}, begin) & shiftrightunsigned({ones}, past)")).alias("bits"))
    in_segment = F.pmod("word", F.lit(_WORDS)).cast("int")
    known = words.groupBy(*SPLIT, F.shiftright("word", SEGMENT_BITS - WORD_BITS).alias("segment")).agg(
        F.map_from_entries(F.collect_list(F.struct(in_segment, "bits"))).alias("known"))
    every = F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), lambda i: F.coalesce(F.col("known")[i], F.lit(0).cast("long")))
    return store(known.select(*SPLIT, "segment", every.alias("bits")), target)


def in_spans(rows: DataFrame, bits: DataFrame, held: bool = True) -> DataFrame:
    """The rows inside the spans of ``span_bits``, or, if not ``held``, the rows outside of all.

    The bits go to all tasks, up to ``MAX_SENT`` segments of them; otherwise the rows are shuffled once and looked up in a
    hash table of their partition's bits. No row is sorted.
    """
    sent = F.broadcast(bits) if bits.count() <= MAX_SENT else bits.hint("shuffle_hash")
    met = rows.withColumn("segment", F.shiftright("seq", SEGMENT_BITS)).join(sent, [*SPLIT, "segment"], "inner" if held else "left")
    word = F.col("bits")[F.pmod(_word("seq"), F.lit(_WORDS)).cast("int")]
    bit = F.getbit(word, F.pmod("seq", F.lit(1 << WORD_BITS)).cast("int"))
    return met.where((bit == 1) if held else F.col("bits").isNull() | (bit == 0)).select(*rows.columns)


def hidden(rows: DataFrame, target: str) -> DataFrame:
    """The rows that do not begin in normal text, as ``span_bits`` stored at ``target``."""
    before, after, end = states(rows)
    if end != "N":
        begin = next(b for b, _, s in _SPANS if s == end)
        raise ValueError(f"not plain markup: <{begin} is open at the end")
    ends = bounds(rows)
    return span_bits(
        before.join(ends, list(SPLIT)).select(*SPLIT, (F.col("first") - 1).alias("seq"), (F.col("before") != "N").alias("held"))
        .unionByName(after.select(*POSITION, (F.col("after") != "N").alias("held"))), ends, target)


def outside(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows that begin in normal text, from the ``hidden`` ones."""
    return in_spans(rows, bits, held=False)
