"""Splittable scan of map markup.

A raw ``<`` is never legal inside an XML attribute, so a text read with ``<`` as its line
separator gives one row per tag, and Spark can split even a single file of many terabytes
at any byte. Each row keeps where it stood: number of the file, start of the split, and a
sequence number that grows within the split. Files are taken as one extract: paths in the order
given, files below one path by name, numbers in names compared as numbers.

What a row cannot know by itself is settled on the staged rows, from summaries of splits:

* the encoding: every file is read as UTF-8 first. Files that declare another one, or begin like
  UTF-16, are read again with that decoder (``CHARSETS``); bytes that contradict it stop the scan;
* comments, CDATA and instructions: each row is a function of the state the text before it was left
  in. Functions are composed over segments, splits and files; rows inside are skipped
  (``sources.lexical``). An extract without markup in comments pays for one look at the marks;
* nesting: opening and closing tags must match at every depth (``sources.nesting``).

Limits: compressed files that Hadoop cannot split are read by one task each; the XML parser refuses
elements with more than 1000 attributes; a file without a declaration is UTF-8, unless it begins
like UTF-16. Text that is no markup at all stops the scan: a row is never dropped in silence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapengine.model import ATTRIBUTES, CHILDREN, TOP_LEVEL
from mapengine.sources import lexical, nesting
from mapengine.sources.lexical import POSITION
from mapengine.workspace import new_dir, remove
from mapengine.workspace import packed as store

_ATTRIBUTE = r"""\s++[^\s=/>"']++\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""
# An opening or closing tag up to its `>`; quantifiers are possessive, so one pass is enough.
_TAG = rf"""^(?:[^\s/>!?="']++(?:{_ATTRIBUTE})*+\s*+/?>|/[^\s/>]++\s*+>)"""
# What else may follow a `<`: nothing (start of file), comment, CDATA, instruction, declaration.
_OTHER = r"(?s)^(?:[\s﻿]*$|\?|!--|!\[CDATA\[|![A-Z])"

# Characters that XML forbids in a value, or that its parser would replace.
_CONTROL = r"[\x00-\x1F\uFFFE\uFFFF]"
_PLAIN_ENDS = ("/>", ">")

# Up to this many files, their numbers are sent to all tasks (some hundred megabytes at most);
# numbers of more files are joined as a table like any other.
MAX_FILES = 1_000_000

_XML = {"mode": "PERMISSIVE", "attributePrefix": "", "ignoreSurroundingSpaces": "false"}

# Decoder by declared name. Fixed names.
UTF_8 = "UTF-8"
CHARSETS = {
    "UTF-8": UTF_8, "UTF8": UTF_8,
    "US-ASCII": "US-ASCII", "ASCII": "US-ASCII",
    "ISO-8859-1": "ISO-8859-1", "ISO_8859-1": "ISO-8859-1", "ISO8859-1": "ISO-8859-1", "LATIN1": "ISO-8859-1",
    "UTF-16": "UTF-16", "UTF-16LE": "UTF-16LE", "UTF-16BE": "UTF-16BE",
}
_WIDE = ("UTF-16LE", "UTF-16BE")
_DECLARED = r"""^\?xml\s[^>]*?\bencoding\s*=\s*["']([A-Za-z0-9._-]+)["']"""
# Sequence numbers of files that are read again start here, once for each decoder.
_AGAIN = 1 << 58


def _natural(file: str) -> tuple:
    """Sort key of a file: its decoded name, numbers in it compared as numbers."""
    name = unquote(file)
    return tuple(int(p) if i % 2 else p for i, p in enumerate(re.split(r"([0-9]+)", name))), name


def files_in_order(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files of the extract as Spark names them, in document order."""
    files = [f for path in paths for f in sorted(spark.read.text(path).inputFiles(), key=_natural)]
    if len(set(files)) < len(files):
        raise ValueError("a file is named twice by the paths of the extract")
    return files


def _numbered(spark: SparkSession, rows: DataFrame, files: list[str]) -> DataFrame:
    """``path`` of each row replaced by ``file``, the number of the file."""
    if len(files) < 2:
        return rows.withColumn("file", F.lit(0)).drop("path")
    # File metadata leaves out the empty host that the list of files spells.
    spelled = [(i, f.replace(":///", ":/", 1)) for i, f in enumerate(files)]
    numbers = spark.createDataFrame(spelled, "number INT, listed STRING")
    numbers = F.broadcast(numbers) if len(files) <= MAX_FILES else numbers
    unknown = F.concat(F.lit("not in the list of files when the scan was planned: "), "path")
    return (
        rows.join(numbers, F.col("path") == F.col("listed"), "left")
        .withColumn("file", F.when(F.col("number").isNull(), F.raise_error(unknown)).otherwise(F.col("number")))
        .drop("path", "number", "listed")
    )


def _rarely(needed: Column, value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` where ``needed``, else NULL, without a line of its code in the loop over all rows.

    A lambda is interpreted. The loop that Spark generates stays small enough for the JVM to compile it.
    """
    return F.when(needed, F.transform(F.array(value), fn)[0])


def _pieces(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """One row per ``<``: file and split, the text after it, and whether its bytes are legal."""
    reader = spark.read.option("lineSep", "<")
    if charset in _WIDE:
        reader = reader.option("encoding", charset)
    raw = F.col("value").cast("binary")
    # A wide text is cut at the bytes of its `<`; where another character's halves look alike, a piece is odd.
    legal = F.is_valid_utf8("value") if charset == UTF_8 else F.octet_length(raw) % 2 == 0 if charset in _WIDE else F.lit(True)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        legal.alias("legal"),
        (F.col("value") if charset == UTF_8 else F.when(legal, F.decode(raw, charset))).alias("text"),
        _rarely(~legal | F.col("value").contains("\0"), raw, lambda x: F.hex(F.substring(x, 1, 8))).alias("head"),
    )


def _plain(text: Column) -> Column:
    """Pieces of a tag or ref between its quotes, if it is spelled in the most usual way, else NULL."""
    return F.when(text.startswith('tag k="') | text.startswith('nd ref="'), F.split(text, '"'))


def _parsed(tag: Column, names: Sequence[str]) -> Column:
    """Attributes of an opening tag, decoded by Spark's XML parser; ``_corrupt_record`` of a malformed one."""
    closed = F.when(tag.endswith("/>"), tag).otherwise(F.concat(F.left(tag, F.length(tag) - 1), F.lit("/>")))
    fields = ", ".join(f"`{n}` STRING" for n in (*names, "_corrupt_record"))
    return F.from_xml(F.concat(F.lit("<"), closed), fields, _XML)


def _scanned(
    spark: SparkSession, paths: list[str], files: list[str], attributes: Sequence[str], keep_markup: bool,
    charset: str = UTF_8, offset: int = 0,
) -> DataFrame:
    """Rows of tags, of marks (``sources.lexical``) and of what is neither (``problem``).

    Most rows of an extract are refs and tags in one plain form. Those are cut at their quotes, which is
    several times faster than a pattern or the parser; whatever is not quite plain, or holds a
    character to decode, replace or refuse, goes the long way, so the result is the same.
    """
    text, parts, tag, name = F.col("text"), F.col("parts"), F.col("tag"), F.col("name")
    ends = F.expr("btrim(parts[size(parts) - 1], ' \\n\\r\\t')").isin(*_PLAIN_ENDS)
    is_tag = (F.size(parts) == 5) & (parts[0] == "tag k=") & (parts[2] == " v=") & ends & ~text.contains("&") & ~(
        F.concat(parts[1], parts[3]).rlike(_CONTROL))
    is_ref = (F.size(parts) == 3) & (parts[0] == "nd ref=") & ends & parts[1].rlike("^[0-9]+$")
    plain = F.coalesce(F.when(is_tag, "tag").when(is_ref, "nd"), F.lit(""))
    # What the pieces hold; all other attributes come from the parser.
    held = {
        "k": F.when(F.col("plain") == "tag", parts[1]), "v": F.when(F.col("plain") == "tag", parts[3]),
        "ref": F.when(F.col("plain") == "nd", parts[1]),
    }
    held = {name: piece for name, piece in held.items() if name in attributes}
    begun = F.when((tag != "") & ~tag.startswith("/"), _parsed(tag, attributes))
    event = (
        F.when(F.col("plain") != "", F.when(F.expr("btrim(parts[size(parts) - 1], ' \\n\\r\\t')") == ">", "open").otherwise("empty"))
        .when(tag == "", None).when(tag.startswith("/"), "close").when(tag.endswith("/>"), "empty").otherwise("open")
    )
    is_bad = ~F.col("legal") | ((tag == "") & ~text.rlike(_OTHER)) | F.col("attribute._corrupt_record").isNotNull()
    problem = _rarely(is_bad, F.struct("legal", "tag", "head", F.left(text, F.lit(80)).alias("shown")), lambda x: (
        F.when(~x["legal"], F.concat(F.lit(f"bytes that are not {charset}, found at "), x["head"]))
        .when(x["tag"] == "", F.concat(F.lit("not plain markup: <"), x["shown"]))
        .otherwise(F.concat(F.lit("MALFORMED tag: <"), x["shown"]))
    ))
    is_legal = F.col("legal")
    scanned = (
        _pieces(spark, paths, charset)
        .withColumn("parts", F.when(is_legal, _plain(text)))
        .withColumn("plain", plain)
        .withColumn("tag", F.when(F.col("plain") == "", F.when(is_legal, F.regexp_extract("text", _TAG, 0)).otherwise("")))
        .select(
            "path", "block", "text", "legal", "head", "tag", event.alias("event"),
            F.when(F.col("plain") != "", F.col("plain")).otherwise(F.regexp_extract(tag, r"^/?([^\s/>]+)", 1)).alias("name"),
            begun.alias("attribute"), *[piece.alias(f"plain_{a}") for a, piece in held.items()],
            _rarely(is_legal & lexical.special(text), text, lexical.mark).alias("mark"),
            _rarely(text.startswith("?xml"), text, lambda x: F.nullif(F.regexp_extract(x, _DECLARED, 1), F.lit(""))).alias("declared"),
        )
    )
    kind = F.when(F.col("event").isNull() | F.col("problem").isNotNull(), lexical.MARK).when(name.isin(*TOP_LEVEL, *CHILDREN), name).otherwise("other")
    whole = F.concat(F.lit("<"), F.coalesce(F.nullif(tag, F.lit("")), F.regexp_extract("text", r"(?s)^.*>", 0)))
    # The sequence number makes the projection non-deterministic for Catalyst, which therefore keeps the
    # filter above it; numbers do not depend on what is kept, and nothing is computed twice.
    rows = scanned.withColumn("problem", problem).select(
        "path", "block", (F.monotonically_increasing_id() + offset).alias("seq"),
        F.when(F.col("problem").isNull(), F.col("event")).alias("event"), "name", kind.alias("kind"),
        *([whole.alias("markup")] if keep_markup else []),
        *[F.coalesce(f"plain_{a}", f"attribute.{a}").alias(a) if a in held else f"attribute.{a}" for a in attributes],
        "mark", "declared", "problem", F.when(F.col("problem").isNotNull(), F.col("head")).alias("head"),
    ).where(F.col("event").isNotNull() | F.col("mark").isNotNull() | F.col("problem").isNotNull())
    columns = [c for c in rows.columns if c not in ("path", "block", "seq")]
    return _numbered(spark, rows, files).select(*POSITION, *columns)


def _first_bytes_say(head: str | None) -> str | None:
    """The wide encoding of a file whose first illegal row begins with these bytes, in hexadecimal."""
    if head is None:
        return None
    if head.startswith("FFFE") or head.startswith(("003F00", "003C00", "002100")):
        return "UTF-16LE"
    return "UTF-16BE" if head.startswith("FEFF") or head == "00" else None


def _decoders(rows: DataFrame, files: list[str]) -> dict[str, list[int]]:
    """Files, by decoder, that are to be read again; stops on what is declared and cannot be true.

    Only files with a problem or a declaration of their own come to the driver, which has their list.
    """
    odd = rows.where(F.col("declared").isNotNull() | F.col("head").isNotNull()).groupBy("file").agg(
        F.min_by("declared", F.when(F.col("declared").isNotNull(), F.struct("block", "seq"))).alias("declared"),
        F.min_by("head", F.when(F.col("head").isNotNull(), F.struct("block", "seq"))).alias("head"),
    ).where(F.col("head").isNotNull() | (F.upper("declared") != UTF_8))
    again: dict[str, list[int]] = {}
    for file, declared, head in odd.orderBy("file").collect():
        wide = _first_bytes_say(head)
        name = CHARSETS.get((declared or wide or UTF_8).upper())
        if name is None:
            raise ValueError(f"{files[file]} declares {declared}, which is none of {sorted(set(CHARSETS.values()))}")
        if name.startswith("UTF-16") and wide is None:
            raise ValueError(f"{files[file]} declares {declared}, but its bytes are not")
        charset = wide or name
        if charset != UTF_8:
            again.setdefault(charset, []).append(file)
    return again


def _decoded(
    spark: SparkSession, staged: DataFrame, files: list[str], target: str, attributes: Sequence[str], keep_markup: bool
) -> DataFrame:
    """``staged`` with the files that are not UTF-8 read again."""
    again = _decoders(staged, files)
    if not again:
        return staged
    numbers = spark.createDataFrame([(f,) for own in again.values() for f in own], "file INT")
    rows = staged.join(numbers, "file", "left_anti").select(*staged.columns)
    for i, (charset, own) in enumerate(sorted(again.items())):
        paths = [unquote(files[f]) for f in own]
        rows = rows.unionByName(_scanned(spark, paths, files, attributes, keep_markup, charset, (i + 1) * _AGAIN))
    decoded = store(rows, f"{target}-decoded", "kind", "seq")
    declared = decoded.join(numbers, "file", "left_semi").where(F.col("declared").isNotNull())
    for file, name in declared.select("file", "declared").distinct().orderBy("file").collect():
        own = next(c for c, fs in again.items() if file in fs)
        fits = CHARSETS.get(name.upper()) == own or (own in _WIDE and CHARSETS.get(name.upper()) == "UTF-16")
        if not fits:
            raise ValueError(f"{files[file]} declares {name}, but its bytes are {own}")
    return decoded


def stage_events(
    spark: SparkSession,
    path: str | Sequence[str],
    target: str,
    attributes: Sequence[str] = ATTRIBUTES,
    keep_markup: bool = False,
) -> DataFrame:
    """Parses the extract once into a Parquet table at ``target`` and returns its rows.

    One row per tag at any depth. ``event`` is ``open``, ``empty`` (opened and closed at once) or
    ``close``; ``kind`` is the name, or ``other`` for names outside the data model. ``attributes`` become STRING
    columns, NULL where an element lacks one. Everything downstream then reads only the columns and kinds of
    row it needs, and row positions are pinned: they can no longer move when a scan is planned anew. The tag text
    (``markup``) is only needed to write samples (``sources.extract``), so it is left out by default.

    Stops with a ValueError on text that is no markup, on malformed tags, on bytes that are not of
    the file's encoding, and on tags that do not match. Files to be decoded anew, and extracts with markup
    inside comments, are stored once more beside ``target``; of the latter nothing is left at ``target`` itself.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = files_in_order(spark, paths)
    staged = store(_scanned(spark, paths, files, attributes, keep_markup), target)
    marked = F.col("mark").isNotNull()
    wrong = F.min(F.when(F.col("problem").isNotNull(), F.struct(*POSITION, "problem")))
    special = F.col("kind") == lexical.MARK
    found = staged.agg(
        F.count_if(marked & lexical.opens(F.col("mark"))).alias("opens"), wrong.alias("wrong"),
        F.count_if(F.col("head").isNotNull() | (special & (F.upper("declared") != UTF_8))).alias("odd"),
    ).first()
    if found["odd"]:
        staged = _decoded(spark, staged, files, target, attributes, keep_markup)
        found = staged.agg(F.count_if(marked & lexical.opens(F.col("mark"))).alias("opens"), wrong.alias("wrong")).first()
    commented = found["opens"] > 0
    if commented:
        bits = lexical.hidden(staged, f"{target}-hidden")
        problems = staged.where(F.col("problem").isNotNull()).select(*POSITION, "problem")
        found = lexical.outside(problems, bits).agg(wrong.alias("wrong")).first()
    if found["wrong"] is not None:
        raise ValueError(f"{found['wrong']['problem']} (in {files[found['wrong']['file']]})")
    rows = staged.where(F.col("kind") != lexical.MARK).drop("mark", "declared", "problem", "head")
    if commented:
        rows = store(lexical.outside(rows, bits), f"{target}-outside")
        # Nothing reads the rows with what is hidden any more.
        remove(spark, target, f"{target}-decoded", f"{target}-hidden")
    nesting.check(rows)
    return rows


def events(spark: SparkSession, path: str | Sequence[str], attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """``stage_events`` into a new folder of the shared one, tag texts included."""
    return stage_events(spark, path, new_dir(spark, "events"), attributes, keep_markup=True)


def elements(rows: DataFrame) -> DataFrame:
    """The elements among ``events`` or staged rows: one row per element, at any depth."""
    return rows.where(F.col("event") != "close").drop("event", "markup")


def top_level(rows: DataFrame, names: Sequence[str] = TOP_LEVEL) -> DataFrame:
    """Top-level elements by name; children are in ``operators.order.children``."""
    return elements(rows).where(F.col("kind").isin(*names))
