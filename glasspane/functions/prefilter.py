"""What a text must hold for a pattern to match in it, as a cheap SQL condition in front of the pattern.

The condition comes from the pattern itself: literal strings that every match holds, joined by AND along the pattern and by OR
over its alternatives. It never rules out a text in which the pattern matches. Where many patterns are asked of one text, all
conditions are decided in one pass over many texts instead (`possible`): Spark has no function that looks for many strings at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, reduce
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text_slices

#: Strings shorter than this say nothing; so many conditions in a row are asked at most, those of the longest strings first.
LEAST, MOST = 2, 3
#: Strings are looked for by so many of their first bytes, in so many bytes of text at a time.
START, SLICE = 4, 1 << 19
WIDTHLESS = (C.AT, C.ASSERT, C.ASSERT_NOT)
REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)

Needs = str | tuple | None


def weakest(needs: Needs) -> int:
    """Length of the shortest string that can meet the condition."""
    if isinstance(needs, str):
        return len(needs)
    return (max if needs[0] == "AND" else min)(map(weakest, needs[1]))


def joined(kind: str, parts: list[Needs]) -> Needs:
    parts = list(dict.fromkeys(p for part in parts for p in (part[1] if isinstance(part, tuple) and part[0] == kind else (part,))))
    if kind == "OR":  # what holds a longer string holds the shorter one within it
        parts = [p for p in parts if not (isinstance(p, str) and any(isinstance(q, str) and q != p and q in p for q in parts))]
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def along(tokens) -> Needs:
    """Condition of a run of tokens; None where nothing is needed."""
    parts, run = [], ""

    def ended():
        nonlocal run
        if len(run) >= LEAST:
            parts.append(run)
        run = ""

    for kind, what in tokens:
        if kind is C.LITERAL:
            run += chr(what)
        elif kind not in WIDTHLESS:
            ended()
            if kind is C.BRANCH:
                inner = [along(x) for x in what[1]]
                inner = None if None in inner else joined("OR", inner)
            elif kind is C.SUBPATTERN:
                inner = along(what[3])
            elif kind in REPEATS and what[0] > 0:
                inner = along(what[2])
            else:
                inner = None
            if inner is not None:
                parts.append(inner)
    ended()
    parts = sorted(dict.fromkeys(parts), key=weakest, reverse=True)[:MOST]
    return joined("AND", parts) if parts else None


def strings(needs: Needs) -> set[str]:
    if needs is None:
        return set()
    return {needs} if isinstance(needs, str) else set().union(*map(strings, needs[1]))


@cache
def needed(pattern: str) -> Needs:
    return along(parser.parse(pattern))


def needed_sql(text: str, pattern: str) -> str:
    """SQL condition on a text in which letters are written as in the pattern."""

    def say(needs: Needs) -> str:
        if isinstance(needs, str):
            quoted = needs.replace("\\", "\\\\").replace("'", "\\'")
            return f"contains({text}, '{quoted}')"
        return f"({f' {needs[0]} '.join(map(say, needs[1]))})"

    needs = needed(pattern)
    return "true" if needs is None else say(needs)


def starts_of(raw: np.ndarray, length: int) -> np.ndarray:
    """The next `length` bytes at each place, as one number."""
    out = np.zeros(max(len(raw) - length + 1, 0), np.uint32)
    for i in range(length):
        out |= raw[i : len(raw) - length + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def mixed(starts: np.ndarray) -> np.ndarray:
    return (starts * np.uint32(0x9E3779B1)) >> np.uint32(16)


class Possible:
    """Which of these patterns can match in a text: the strings that they need are looked for all at once, by the bytes they begin
    with, in many texts that lie behind one another."""

    def __init__(self, patterns: Iterable[str]):
        self.needs = [needed(p) for p in patterns]
        self.strings = sorted(set().union(*map(strings, self.needs)))
        self.at = {s: i for i, s in enumerate(self.strings)}
        encoded = [(i, s.encode()) for i, s in enumerate(self.strings)]
        #: For each length of beginnings: which mixed beginnings there are, the beginnings in order, and the strings of each.
        self.kinds = []
        for length in range(1, START + 1):
            own = [(int.from_bytes(b[:length], "little"), i, b) for i, b in encoded if min(len(b), START) == length]
            if own:
                known = np.array(sorted({x for x, _, _ in own}), np.uint32)
                table = np.zeros(1 << 16, bool)
                table[mixed(known)] = True
                self.kinds.append((length, table, known, [[(i, b) for x, i, b in own if x == start] for start in known.tolist()]))

    def held(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row by row: which of the strings the texts raw[offsets[i]:offsets[i + 1]] hold."""
        out = np.zeros((len(offsets) - 1, len(self.strings)), bool)
        for length, table, known, of_start in self.kinds:
            starts = starts_of(raw, length)
            place = np.flatnonzero(table[mixed(starts)])
            which = np.searchsorted(known, starts[place])
            exact = known[np.minimum(which, len(known) - 1)] == starts[place]
            place, which = place[exact], which[exact]
            order = np.argsort(which, kind="stable")
            place = place[order]
            bounds = np.searchsorted(which[order], np.arange(len(known) + 1))
            row = np.searchsorted(offsets, place, "right") - 1
            left = offsets[row + 1] - place
            for k, found in enumerate(of_start):
                part = slice(bounds[k], bounds[k + 1])
                for i, b in found:
                    fits = left[part] >= len(b)
                    at, rows = place[part][fits], row[part][fits]
                    for j in range(length, len(b)):
                        same = raw[at + j] == b[j]
                        at, rows = at[same], rows[same]
                    out[rows, i] = True
        return out

    def met(self, needs: Needs, held: np.ndarray) -> np.ndarray:
        if isinstance(needs, str):
            return held[:, self.at[needs]]
        return reduce(np.logical_and if needs[0] == "AND" else np.logical_or, [self.met(n, held) for n in needs[1]])

    def of(self, texts: pa.Array) -> pa.Array:
        """For each text the numbers of the patterns that can match; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a, b in text_slices(texts, SLICE):
            _, offsets, data = texts.slice(a, b - a).buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset + a : texts.offset + b + 1]
            raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
            held = self.held(raw, offsets - offsets[0])
            everywhere = np.ones(b - a, bool)
            met = np.stack([everywhere if n is None else self.met(n, held) for n in self.needs], axis=1)
            sizes.append(met.sum(axis=1))
            numbers.append(np.nonzero(met)[1].astype(np.int32))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate(numbers))


def possible(texts: Column, patterns: Iterable[str]) -> Column:
    """Of an array of texts: an array with the numbers of the patterns that can match in each."""
    asked = Possible(patterns)

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def run(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), asked.of(rows.flatten()))

    return run(texts)
