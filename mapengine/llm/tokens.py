"""Token counts by prefix dynamic programming.

For every prefix of a text the table holds the exact number of tokens of that prefix. Byte-pair
encoding allows it: in the encoding of a prefix, the last token is the one token that ends
there and is compatible with the last token of what precedes it, two tokens being compatible
if encoding their joined text gives these two again. So the count at a prefix is the count
before its last token plus one, and nothing is ever encoded anew to answer how many tokens a
prefix has or how long a prefix a budget allows.

A text is cut before every run of blanks: pre-tokenization never looks across such a cut, so
counts of the pieces add up. Pieces repeat, so what is known of them and of their prefixes is kept in
the worker. Where only the count of a whole piece is asked for, the table is filled from its end: of the
prefixes, only those that a token of the vocabulary follows are looked at.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from mapengine.llm.common import text_of

# Unicode white space, and the words that byte-level BPE splits a piece into.
_SPACE = "\t-\r \x85\xa0  -     　"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTED = ("'re", "'ve", "'ll")

# Entries of each of a worker's tables of units, prefixes and pairs; a full one starts afresh.
_REMEMBERED = 400_000
# Bytes of a piece whose prefixes are remembered.
_SHORT = 32
# The rank of a merge that does not exist.
_NEVER = 1 << 60


def _byte_letters() -> str:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(letters[b] for b in range(256))


@lru_cache(maxsize=1)
def _too_new() -> frozenset[str]:
    """Letters and numbers of the Unicode tables of ``regex`` that those of the tokenizers library do not have.
    Code points that Python knows as well are the same in all three."""
    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
    return frozenset(
        c for kind, one in ((r"\p{L}", "a"), (r"\p{N}", "1")) for c in regex.findall(kind, every)
        if unicodedata.category(c) == "Cn" and len(split(one + c)) > 1
    )


class PrefixCounter:
    """Counts tokens of all prefixes as a byte-level BPE file of the tokenizers library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without a normalizer is needed")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self._rank = {m: i for i, m in enumerate(merges)}
        self._vocabulary = set(spec["model"]["vocab"])
        self._longest = max(map(len, self._vocabulary))
        self._letters = _byte_letters()
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._split = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or r"(?!)")
        self._unit = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
        self._lead = re.compile(f"[{_SPACE}]*")
        self._piece = regex.compile(PIECE)
        self._too_new = _too_new()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._recent: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._prefixes: dict[str, tuple[int, int]] = {}
        self._histories: dict[str, list[tuple[int, str, str]] | None] = {}

    def _merges(self, token: str) -> list[tuple[int, str, str]] | None:
        """Plain BPE of a token's letters: the rank of each merge, with the first and the last part before it,
        and an entry for the end. None if they give other tokens."""
        if token in self._histories:
            return self._histories[token]
        steps, parts = [], list(token)
        while len(parts) > 1:
            ranks = [self._rank.get(p, _NEVER) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == _NEVER:
                break
            steps.append((best, parts[0], parts[-1]))
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        found = None if len(parts) > 1 else [*steps, (_NEVER, token, token)]
        self._histories[token] = found
        return found

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether the letters of two tokens give these two: each side goes its own way until a merge over the border
        is the next one, of equal ranks the one further left."""
        lefts, rights = self._merges(left), self._merges(right)
        if lefts is None or rights is None:
            return False
        rank, i, j = self._rank.get, 0, 0
        own_left, _, last = lefts[0]
        own_right, first, _ = rights[0]
        while True:
            over = rank((last, first), _NEVER)
            if over < own_left and over <= own_right:
                return False
            if own_left <= own_right:
                if own_left == _NEVER:
                    return True
                i += 1
                own_left, _, last = lefts[i]
            else:
                j += 1
                own_right, first, _ = rights[j]

    def _compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= _REMEMBERED:
                self._pairs.clear()
            known = self._pairs[key] = self._stay_apart(left, right) if left else self._merges(right) is not None
        return known

    def _by_byte(self, piece: str) -> Sequence[int]:
        """Tokens of every prefix of a piece, byte by byte; the piece is encoded as one word."""
        s = self._lettered(piece)
        if len(s) <= _SHORT:
            return [self._of_prefix(s[:end])[1] for end in range(1, len(s) + 1)]
        count, start = [0] * (len(s) + 1), [0] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            for begin in range(max(0, end - self._longest), end):
                token = s[begin:end]
                if token in self._vocabulary and self._compatible(s[start[begin] : begin], token):
                    count[end], start[end] = count[begin] + 1, begin
                    break
        return count[1:]

    def _lettered(self, piece: str) -> str:
        """A letter for every byte of a piece."""
        return codecs.charmap_decode(piece.encode(), "strict", self._letters)[0]

    def _of_prefix(self, s: str) -> tuple[int, int]:
        """Where the last token of a short prefix in byte letters begins, and the prefix's tokens.

        Only those shorter prefixes are looked at that a token may follow. What is known of a
        prefix holds for every piece that begins with it.
        """
        known = self._prefixes.get(s)
        if known is not None:
            return known
        vocabulary = self._vocabulary
        begin, n = 0, 0
        if s not in vocabulary or not self._compatible("", s):
            for begin in range(1, len(s)):
                token = s[begin:]
                if token in vocabulary:
                    before, n = self._of_prefix(s[:begin])
                    if self._compatible(s[before:begin], token):
                        break
        found = begin, n + 1
        if len(self._prefixes) >= _REMEMBERED:
            self._prefixes.clear()
        self._prefixes[s] = found
        return found

    def _total(self, piece: str) -> int:
        """Tokens of a whole piece."""
        s = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalpha() else self._lettered(piece)
        return self._of_prefix(s)[1] if len(s) <= _SHORT else self._by_byte(piece)[-1]

    def _by_char(self, piece: str) -> Sequence[int]:
        count = self._by_byte(piece)
        if len(count) == len(piece):
            return count
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(count[at - 1])
        return ends

    def _pieces(self, word: str) -> list[str]:
        """The pieces of a word, letters and numbers being those that the library knows."""
        if word.isascii() or self._too_new.isdisjoint(word):
            return self._piece.findall(word)
        known = "".join(["." if c in self._too_new else c for c in word])
        return [word[m.start() : m.end()] for m in self._piece.finditer(known)]

    def _table(self, unit: str) -> bytes | tuple[int, ...]:
        """Tokens of every prefix of a run of blanks with the word that follows it."""
        one_space = unit[0] == " " and unit[1:2].isalpha()
        lead = 1 if one_space else self._lead.match(unit).end()
        counts = [1] if one_space else list(self._by_char(unit[:lead])) if lead else []
        if lead < len(unit):
            # The last blank joins the word if it is a space, else it is a piece of its own.
            base = counts[lead - 2] if lead > 1 else 0
            joined = lead and unit[lead - 1] == " "
            if lead and not joined:
                base += self._by_char(unit[lead - 1])[-1]
            word = unit[lead - 1 if joined else lead :]
            for piece in [word] if unit[lead:].isalpha() else self._pieces(word):
                own = [1, 2, 1] if piece in _CONTRACTED else self._by_char(piece)
                counts += [base + c for c in (own[1:] if joined else own)]
                joined, base = False, base + own[-1]
        return bytes(counts) if max(counts) < 256 else tuple(counts)

    def _whole(self, unit: str) -> int:
        """Tokens of a whole unit: the last entry of its table, without the others."""
        if unit[0] == " " and unit[1:].isalpha():
            return self._total(unit)
        lead = self._lead.match(unit).end()
        if lead == len(unit):
            return self._total(unit)
        joined = lead and unit[lead - 1] == " "
        before = (unit[: max(lead - 1, 0)], "" if joined else unit[lead - 1 : lead])
        word = unit[lead - 1 if joined else lead :]
        pieces = [word] if unit[lead:].isalpha() else self._pieces(word)
        return sum([self._total(piece) for piece in (*before, *pieces) if piece])

    def tables(self, text: str) -> list[bytes | tuple[int, ...]]:
        """Tables of the units of a text without special tokens; their counts add up."""
        return [self._table(unit) for unit in self._unit.findall(text)]

    def _last_counts(self, units: list[str]) -> list[int]:
        """Tokens of each whole unit. Units repeat, so these are remembered, in two generations
        of which the older one is forgotten."""
        found = list(map(self._recent.get, units))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    unit = units[i]
                    n = self._older.get(unit) or self._whole(unit)
                    found[i] = n
                    if len(unit) <= 64:
                        if len(self._recent) >= _REMEMBERED:
                            self._recent, self._older = {}, self._recent
                        self._recent[unit] = n
        return found

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Ordinary text with the special token that ends it, if any."""
        at = 0
        for m in self._split.finditer(text):
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], ""

    def prefixes(self, text: str) -> list[int]:
        """Tokens of ``text[:1]``, ``text[:2]`` and so on to the whole text."""
        out: list[int] = []
        base = 0
        for plain, special in self._parts(text):
            # Until it is complete, a special token is ordinary text that goes on from before.
            counts, done = [], 0
            for table in self.tables(plain + special[:-1]):
                counts += [done + c for c in table]
                done += table[-1]
            out += [base + c for c in counts]
            base += counts[len(plain) - 1] if plain else 0
            if special:
                base += 1
                out.append(base)
        return out

    def count(self, text: str, limit: int | None = None) -> tuple[int, int]:
        """Tokens of the whole text, and the length of its longest prefix within ``limit``."""
        if limit is not None and any(s in text for s in self._special):
            counts = self.prefixes(text)
            fits = [i + 1 for i, c in enumerate(counts) if c <= limit]
            return (counts[-1] if counts else 0), (fits[-1] if fits else 0)
        total = within = chars = 0
        for plain, special in self._parts(text):
            units = self._unit.findall(plain)
            counts = self._last_counts(units)
            whole = sum(counts)
            if limit is not None and total <= limit:
                within = chars + len(plain)
                if total + whole > limit:
                    # Units only add tokens: the last one that begins within the limit decides.
                    ends = list(accumulate(counts))
                    k = bisect_right(ends, limit - total)
                    before = total + (ends[k - 1] if k else 0)
                    fits = [i + 1 for i, c in enumerate(self._table(units[k])) if before + c <= limit]
                    within = chars + sum(map(len, units[:k])) + (fits[-1] if fits else 0)
            total += whole + bool(special)
            chars += len(plain)
        return total, within


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(text: Column, path: str, limit: int) -> Column:
    """Struct ``n_tokens, within``: tokens of the whole text, and the number of code points of
    its longest prefix that has at most ``limit`` tokens.

    Special tokens' strings inside texts are special tokens, as is the library's default.
    NULL counts as empty: 0 tokens. Texts are taken one at a time; a text of any length takes
    memory in proportion to it.
    """

    @F.pandas_udf("n_tokens long, within long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for texts in batches:
            yield pd.DataFrame([c.count(t, limit) for t in texts], columns=["n_tokens", "within"], dtype="int64")

    return counts(text_of(text))


def prefix_counts(text: Column, path: str) -> Column:
    """The whole table of a text: tokens of its prefix of 1, 2, ... code points.

    NULL and empty texts have an empty table.
    """

    @F.pandas_udf("array<int>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield pd.Series([c.prefixes(t) for t in texts], dtype=object)

    return counts(text_of(text))


def tokens_of_prefix(table: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points; all of them if the text is shorter."""
    chars = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(table))
    return F.coalesce(F.get(table, chars - 1), F.lit(0))


def chars_within(table: Column, budget: Column | int) -> Column:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(table, lambda c, i: F.when(c <= budget, i + 1))
    return F.coalesce(F.array_max(fits), F.lit(0))
