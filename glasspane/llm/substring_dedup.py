"""Removal of word windows that an earlier document has, by recompression.

A text's words are compressed in rounds: runs of equal symbols become one symbol, then symbols are split into left and right
ones by a bit of their name, and each left one followed by a right one becomes one symbol. A name is a hash of what it
stands for, so it is the same in all texts and tasks, and inside equal stretches of text the symbols are equal, apart from
a few at the edges. What Spark settles in its rounds is which names are shared, and who has them first:

1. Symbols of the rounds `LONG`, and the whole text, which is where the rounds would end, go to Spark with a second hash of
   their words. Of each, the document of smallest id is its first. In a later document all windows inside such a symbol
   are known to repeat, without any of them being looked at: so whole copies and long repeats go.
2. Any window of `window` words keeps some symbols of the first round whole whatever surrounds it: all but a run and perhaps
   a right (left) symbol at its left (right) edge. Of the stretches of `CORE` such symbols the one of least hash is the
   window's key, or the window itself if its core is shorter. Equal windows have equal keys; keys that only one document has
   end here, and with them nearly all windows of texts that repeat nothing.
3. Windows with a shared key, outside the symbols of step 1, are verified: they are counted by a 128-bit digest of their
   words, the smallest document again being the first. (The first document with a window never loses it to step 1: whatever
   has a symbol around it earlier has the window earlier.)

Texts are read three times and cross the network twice, with what is known of each; all else is numbers.

Defined cases: null text has no words, its hash is that of nothing; fewer words than a window lose nothing; rows with a null
id neither lose words nor take any; rows with one id are one document, none of them earlier than the others; equal rows get
equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, record_batch, settle, text_column, text_parts

WINDOW, CORE, LONG = 13, 3, (12, 18)
#: Kinds of rows beside the rounds: keys of windows, whole texts.
KEY, WHOLE = 0, 99
U = np.uint64
#: Odd factors for mixing, and for the two digests of a range of words with their inverses.
FIRST, SECOND, THIRD = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)
BASES = [0x5851F42D4C957F2D, 0xD1342543DE82EF95]
#: A word's name is the sum of a random number for each of its bytes and their places, so that two words share one with
#: probability 2**-64; longer words are hashed one by one. A power of two.
SHORT = 64
TABLE = np.random.default_rng(42).integers(0, 1 << 64, SHORT * 256, dtype=U)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOLS = pa.schema([("kind", pa.int32()), ("name", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("part", pa.int32()), ("start", pa.int32()), ("size", pa.int32())])
WINDOWS = pa.schema([("name", pa.int64()), ("check", pa.int64()), ("doc", pa.int64()), ("part", pa.int32()), ("start", pa.int32())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())])))])


def mixed(a: np.ndarray, b, c: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * FIRST + np.asarray(b).astype(U) * SECOND + U(c)
        x = (x ^ (x >> U(32))) * THIRD
        return x ^ (x >> U(29))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Digests:
    """Two 64-bit digests of any range of words: differences of running sums, brought to the range's own start."""

    def __init__(self, names: np.ndarray):
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base in BASES:
                self.sums.append(np.concatenate([[U(0)], np.cumsum(mixed(names, 0, base % 1000) * powers(base, len(names)), dtype=U)]))
                self.back.append(powers(pow(base, -1, 1 << 64), len(names) + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            a, b = ((s[end] - s[start]) * r[start] for s, r in zip(self.sums, self.back, strict=True))
        return mixed(a, end - start, 1), mixed(b, end - start, 2)


class Words:
    """The words of several texts in one row: names, the row of each word, and where each row begins."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        solid = ~SPACE[raw]
        border = np.zeros(len(raw) + 1, bool)
        border[offsets] = True
        starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | border[:-1]))
        ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | border[1:])) + 1
        self.starts = np.searchsorted(starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.starts))
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        at = np.flatnonzero(solid)
        place = np.arange(len(at)) - np.repeat(first, sizes)
        with np.errstate(over="ignore"):
            self.names = np.add.reduceat(TABLE[(place & (SHORT - 1)) << 8 | raw[at]], first) if len(first) else np.zeros(0, U)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            self.names[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), 42)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows."""
        n = len(self.names)
        at = np.arange(max(n - size + 1, 0))
        return at[self.row[at] == self.row[at + size - 1]] if len(at) else at


def runs(names: np.ndarray, row: np.ndarray, start: np.ndarray, level: int):
    """Symbols after runs became one each, and how many each of them stands for."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    k = np.diff(np.append(at, len(names)))
    out = names[at]
    many = k > 1
    out[many] = mixed(out[many], k[many], 2 * level)
    return out, row[at], start[at]


def is_left(names: np.ndarray, level: int) -> np.ndarray:
    return (mixed(names, level, 3) >> U(63)).astype(bool)


def paired(names: np.ndarray, row: np.ndarray, start: np.ndarray, level: int):
    """Symbols after each left one and a right one behind it became one."""
    left = is_left(names, level)
    join = left[:-1] & ~left[1:] & (row[1:] == row[:-1])
    out, keep = names.copy(), np.ones(len(names), bool)
    at = np.flatnonzero(join)
    out[at] = mixed(names[at], names[at + 1], 2 * level + 1)
    keep[at + 1] = False
    return out[keep], row[keep], start[keep]


def below(starts: np.ndarray, n: int) -> np.ndarray:
    """For each place from 0 to n how many of these different places lie before it."""
    out = np.zeros(n + 1, np.int64)
    out[starts + 1] = 1
    return np.cumsum(out, out=out)


def window_keys(w: Words, at: np.ndarray, size: int, digests: Digests) -> np.ndarray:
    """The key of each window, from what its core keeps of the first round."""
    n = len(w.names)
    run, run_row, run_start = runs(w.names, w.row, np.arange(n), 1)
    left = np.append(is_left(run, 1), True)
    names, _, start = paired(run, run_row, run_start, 1)
    run_of = below(run_start, n)[1:] - 1
    run_start = np.append(run_start, n)
    first = run_of[at] + 1
    first = np.minimum(first + ~left[first], len(run))
    last = run_of[at + size - 1]
    last -= (last > 0) & left[last - 1]
    before = below(start, n)
    low, high = before[run_start[first]], before[run_start[last]]
    stretch = names.copy()
    for i in range(1, CORE):
        stretch[: len(names) - i] = mixed(stretch[: len(names) - i], names[i:], 4 + i)
    stretch = np.append(stretch, U(0))
    high = high - CORE + 1
    keys = digests.of(at, at + size)[0]
    some = np.flatnonzero(low < high)
    if len(some):
        keys[some] = np.minimum.reduceat(stretch, np.stack([low[some], high[some]], axis=1).ravel())[::2]
    return keys


def symbol_rows(docs: DataFrame, window: int) -> DataFrame:
    """Keys of windows, symbols of the rounds LONG with at least `window` words, and whole texts with as many."""

    def run(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            ids, parts = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for a, b, raw, offsets in text_parts(texts):
                w = Words(raw, offsets)
                at = w.windows(window)
                if not len(at):
                    continue
                digests = Digests(w.names)
                keys = window_keys(w, at, window, digests)
                new = np.ones(len(at), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (w.row[at[1:]] != w.row[at[:-1]])
                found = [(KEY, keys[new], None, w.row[at[new]], at[new], at[new])]
                symbols = w.names, w.row, np.arange(len(w.names))
                for level in range(1, max(LONG) + 1):
                    symbols = paired(*runs(*symbols, level), level)
                    if level in LONG:
                        names, row, start = symbols
                        end = np.append(start[1:], len(w.names))
                        keep = end - start >= window
                        found.append((level, names[keep], digests.of(start[keep], end[keep])[1], row[keep], start[keep], end[keep]))
                whole = np.flatnonzero(np.diff(w.starts) >= window)
                start, end = w.starts[whole], w.starts[whole + 1]
                found.append((WHOLE, *digests.of(start, end), whole, start, end))
                for kind, names, check, row, start, end in found:
                    checks = pa.nulls(len(names), pa.int64()) if check is None else check.view(np.int64)
                    yield record_batch(SYMBOLS, np.full(len(names), kind, np.int32), names.view(np.int64), checks, ids[a + row], parts[a + row], (start - w.starts[row]).astype(np.int32), (end - start).astype(np.int32))

    return docs.mapInArrow(run, "kind int, name long, check long, doc long, part int, start int, size int")


def earlier(rows: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """fields of the rows whose names a document with a smaller id has as well. The firsts are settled, so that the join can split a name with many rows."""
    first = rows.groupBy(*names).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    first = settle(first, "firsts", sweep=True)
    return rows.join(first, names).where("doc > first").select("doc", "part", *fields)


def shared_windows(docs: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """Windows with a shared key that lie in no symbol known to repeat, by digest."""

    def run(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            ids, parts = batch.column("doc").to_numpy(), batch.column("part").to_numpy()
            for a, b, raw, offsets in text_parts(texts):
                w = Words(raw, offsets)
                at = w.windows(window)
                digests = Digests(w.names)
                keys = window_keys(w, at, window, digests).view(np.int64) if len(at) else at
                keep = np.zeros(len(at), bool)
                inside = np.zeros(len(w.names) + 1, np.int64)  # the farthest end of a known symbol that begins here or before
                for i in range(b - a):
                    x, y = np.searchsorted(at, w.starts[i : i + 2])
                    keep[x:y] = np.isin(keys[x:y], batch.column("keys")[a + i].values.to_numpy())
                    spans = batch.column("spans")[a + i].values
                    if len(spans):
                        start = spans.field("start").to_numpy() + w.starts[i]
                        np.maximum.at(inside, start, start + spans.field("size").to_numpy())
                keep &= np.maximum.accumulate(inside)[at] < at + window
                at = at[keep]
                x, y = digests.of(at, at + window)
                yield record_batch(WINDOWS, x.view(np.int64), y.view(np.int64), ids[a + w.row[at]], parts[a + w.row[at]], (at - w.starts[w.row[at]]).astype(np.int32))

    return docs.join(known, ["doc", "part"]).select("doc", "part", "text", "spans", "keys").mapInArrow(run, "name long, check long, doc long, part int, start int")


def spans_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "size")).alias(name))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by spaces) and removed: runs of removed words."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text_col).alias("part"), F.col(text_col).alias("text"))
    named = given.where("doc IS NOT NULL AND text IS NOT NULL")
    symbols = settle(symbol_rows(named, window), "recompressed")
    long = settle(earlier(symbols.where(F.col("kind") != KEY), ["kind", "name", "check"], ["start", "size"]), "repeated-symbols", sweep=True)
    keys = symbols.where(F.col("kind") == KEY).select("name", "doc", "part")
    shared = keys.groupBy("name").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("name")
    shared = settle(shared, "shared-keys", sweep=True)
    held = settle(keys.join(shared, "name").groupBy("doc", "part").agg(F.collect_set("name").alias("keys")), "shared-keys-held", sweep=True)
    discard(symbols, shared)
    known = held.join(spans_of(long, "spans"), ["doc", "part"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: int, size: int>>")))
    windows = settle(shared_windows(named, known, window), "shared-windows", sweep=True)
    gone = earlier(windows, ["name", "check"], ["start"]).withColumn("size", F.lit(window)).unionByName(long)
    gone = settle(spans_of(gone, "gone"), "repeated-words", sweep=True)
    discard(windows, held, long)

    def run(batches):
        for batch in batches:
            texts, spans = text_column(batch, "text"), batch.column("gone")
            n_words, n_removed, digests, removed = [], [], [], []
            for i, text in enumerate(texts):
                words = text.as_buffer().to_pybytes().split()
                change = np.zeros(len(words) + 1, np.int64)
                if spans[i].is_valid:
                    start = spans[i].values.field("start").to_numpy()
                    np.add.at(change, start, 1)
                    np.add.at(change, start + spans[i].values.field("size").to_numpy(), -1)
                out = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(out, prepend=False, append=False))
                digest = hashlib.sha256(b" ".join([w for w, gone in zip(words, out.tolist(), strict=True) if not gone] if len(edges) else words))
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                digests.append(digest.hexdigest())
                removed.append([{"start": x, "size": y - x} for x, y in edges.reshape(-1, 2).tolist()])
            yield record_batch(OUT, batch.column("doc"), n_words, n_removed, digests, removed)

    rows = given.join(gone, ["doc", "part"], "left").select("doc", "text", "gone")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start: int, size: int>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("removed")
