"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of `window` bytes that covers it also starts elsewhere in the corpus (keep="none"), or started
earlier, in order of (document, position), so that the first copy stays (keep="first").

One suffix array over a corpus fits no machine, so the suffixes are dealt out first. Of the k-grams in a window the one of
least hash is its anchor; equal windows have equal anchors at the same place. Only anchors whose hash occurs twice matter.
The bytes of the windows that have an anchor, its context, are sent to the anchor's group. There two suffix orders are
made, of what follows the anchors and of what precedes them (read backwards), with the LCP of neighbours. The suffixes
that start x bytes before an anchor and share those x bytes are an interval of the second order, so their own suffix order
is that interval in the first order. In it the nearest suffixes with a smaller text position on either side, and the least
LCP on the way to them, give the longest previous factor of each suffix; the nearest with a greater position give the
longest next one. The intervals change only at the distinct LCPs of the second order, so each group is worked through once
for each of these. A suffix whose factor has `window` bytes or more is repeated. All windows that have an anchor overlap in
it, so the bytes to remove around one anchor are one interval, from the farthest start to the farthest end.

A second, shorter length (`passage`) is reported but not removed: how many bytes of a text strings of that length cover
that also start elsewhere (with keep="first": earlier). The anchors of the longer windows are among those of the shorter.

Exact copies are one content throughout (by SHA-256), whatever their number. The contexts of a batch are collapsed before
the shuffle. An anchor that occurs more than `GROUP` times is counted as such before anything is dealt out. If its contexts
are no more than `GROUP` kinds, they are a group like others; else they are spread by their content (`spread_spans`): equal ones become one row; one global suffix order of what follows
the anchors and one of what precedes them, split by ranges, give by their LCPs how far a context can agree with any other;
the windows of the removed length within that are counted by digest in a partial and final aggregation instead of group by
group, which gives the same intervals. The reported shorter length takes there what neighbours in the two orders share.

Defined cases: null text is empty; texts shorter than the window keep all bytes; rows with equal text get equal results
(with keep="first" the row with the smallest id keeps its text); an empty table gives an empty result; only the id and text
columns are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PART_BYTES, discard, group_bounds, read_table, record_batch, settle, streamed_groups, text_column, utf8

#: Bytes of a removed string, of one that is only reported (about 45 words), and of an anchor; most contexts of a group.
WINDOW, PASSAGE, GRAM, GROUP = 400, 256, 128, 1500
#: Most rows of a group that a task holds, where its contexts are few but come in several rows each.
HELD = 20_000
MULTIPLIER = 0x9E3779B97F4A7C55
BASE, BACK = np.uint64(MULTIPLIER), np.uint64(pow(MULTIPLIER, -1, 1 << 64))
LOW = np.uint64(PART_BYTES - 1)
#: Bits of a distance in a packed row of distances.
BITS = 15
CONTENT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("reaches", pa.list_(pa.int64()))])
OWNER = pa.struct([("sha", pa.binary()), ("doc", pa.int64()), ("at", pa.int32())])
CONTEXT = pa.schema([("h", pa.int64()), ("hot", pa.bool_()), ("reach", pa.int64()), ("before", pa.int32()), ("context", pa.binary()), ("owners", pa.list_(OWNER))])
OWNERS = "array<struct<sha: binary, doc: long, at: int>>"
SPAN = pa.schema([("sha", pa.binary()), ("length", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("reach", pa.int64()), ("before", pa.int32()), ("context", pa.binary()), ("owners", pa.list_(OWNER))])
APPLIED = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("n_repeated", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, base)]))


def packed(ranges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One number of the least and greatest distances of each of at most two lengths."""
    out = np.zeros(len(ranges[0][0]), np.int64)
    for low, high in ranges:
        out = (out << BITS | low) << BITS | high
    return out


def unpacked(reach: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    mask = (1 << BITS) - 1
    return [(reach >> BITS * (2 * (n - k) - 1) & mask, reach >> BITS * (2 * (n - k) - 2) & mask) for k in range(n)]


class Anchors:
    """The least k-gram of each window of a text, for one or two lengths of windows, the longest first."""

    def __init__(self, lengths: list[int], gram: int = GRAM):
        self.lengths, self.gram, self.up, self.down = lengths, gram, powers(PART_BYTES, BASE), powers(PART_BYTES, BACK)

    def __getstate__(self):
        return {"lengths": self.lengths, "gram": self.gram}

    def __setstate__(self, state):
        self.__init__(**state)

    def piece(self, data: np.ndarray, ends: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """data: at most PART_BYTES bytes; ends: for each byte the end of its text; starts: windows that start before this count.

        Positions and hashes of anchors, and for each length the least and greatest distance to the start of a window that
        has this anchor (1 and 0 where none has).
        """
        n, k = len(data), self.gram
        total = np.concatenate([[np.uint64(0)], np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * self.up[:n])])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # Of equal hashes the rightmost is least.
        key = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64))
        found = []
        for window in self.lengths:
            span = window - k + 1
            rows = -(-len(key) // span)
            grid = np.full(rows * span, np.uint64(0xFFFFFFFFFFFFFFFF))
            grid[: len(key)] = key
            grid = grid.reshape(rows, span)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            last = max(0, min(starts, n - window + 1))
            start = np.flatnonzero(ends[:last] - np.arange(last) >= window)
            at = (LOW - (np.minimum(behind[start], ahead[start + span - 1]) & LOW)).astype(np.int64)
            new = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
            found.append((at[new], at[new] - start[np.append(new[1:], len(at))[: len(new)] - 1], at[new] - start[new]))
        at, ranges = found[-1][0], []
        for own, low, high in found:
            a, b = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
            place = np.searchsorted(at, own)
            # Windows of a longer kind that end beyond this piece's starts can have an anchor that none of the shorter has here.
            known = np.append(at, -1)[place] == own
            a[place[known]], b[place[known]] = low[known], high[known]
            if not known.all():
                extra = own[~known]
                at = np.insert(at, place[~known], extra)
                a, b = np.insert(a, place[~known], low[~known]), np.insert(b, place[~known], high[~known])
                ranges = [tuple(np.insert(v, place[~known], fill) for v, fill in zip(r, (1, 0), strict=True)) for r in ranges]
            ranges.append((a, b))
        return at, h[at].view(np.int64), ranges

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over texts one after the other: positions in data, hashes and packed distances; in order, no position twice."""
        ends = np.repeat(offsets[1:], np.diff(offsets))
        found, most, least = [], max(self.lengths), min(self.lengths)
        step = PART_BYTES - most + 1
        for a in range(0, max(1, len(data) - least + 1), step):
            if len(data) - a >= least:
                at, h, ranges = self.piece(data[a : a + PART_BYTES], ends[a : a + PART_BYTES] - a, step)
                found.append((at + a, h, *(v for r in ranges for v in r)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, h, *edges = (np.concatenate(x) for x in zip(*found, strict=True))
        at, first, inverse = np.unique(at, return_index=True, return_inverse=True)
        ranges = []
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            none = low > high
            a, b = np.full(len(at), 1 << 30), np.full(len(at), -1)
            np.minimum.at(a, inverse[~none], low[~none])
            np.maximum.at(b, inverse[~none], high[~none])
            ranges.append((np.where(b < 0, 1, a), np.where(b < 0, 0, b)))
        return at, h[first], packed(ranges)


def contents_of(docs: DataFrame, lengths: list[int], gram: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, sha, hashes, places and reaches of its anchors."""

    def run(batches):
        anchors = Anchors(lengths, gram)
        for batch in batches:
            raw, off = utf8(text_column(batch, "text"))
            row = 0
            while row < batch.num_rows:
                end = min(batch.num_rows, max(row + 1, int(np.searchsorted(off, off[row] + PART_BYTES, "right")) - 1))
                data, offsets = raw[off[row] : off[end]], off[row : end + 1] - off[row]
                at, h, reach = anchors(data, offsets)
                cuts = np.searchsorted(at, offsets).astype(np.int32)
                places = at - np.repeat(offsets[:-1], np.diff(cuts))
                sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (h, places.astype(np.int32), reach)]
                yield record_batch(CONTENT, batch.column("doc_id").slice(row, end - row), np.diff(offsets), sha, *lists)
                row = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, sha binary, hashes array<long>, places array<int>, reaches array<long>")


def contexts_of(candidates: DataFrame, lengths: list[int], group: int) -> DataFrame:
    """From (sha, doc, text, anchors): the bytes of the windows of each anchor; equal contexts of a batch are one row."""

    def rows(seen: dict) -> pa.RecordBatch:
        return record_batch(CONTEXT, *(list(c) for c in zip(*seen, strict=True)), list(seen.values()))

    def run(batches):
        for batch in batches:
            shas, docs, anchors = batch.column("sha").to_pylist(), batch.column("doc").to_pylist(), batch.column("anchors")
            seen: dict[tuple, list] = {}
            texts, size = text_column(batch, "text"), 0
            for i in range(batch.num_rows):
                text, found = texts[i].as_buffer().to_pybytes(), anchors[i].values
                reach = found.field("reach").to_numpy()
                ranges = unpacked(reach, len(lengths))
                before = np.max([high for _, high in ranges], axis=0).tolist()
                after = np.max([np.where(low <= high, w - low, 0) for w, (low, high) in zip(lengths, ranges, strict=True)], axis=0).tolist()
                for at, h, n, r, b, e in zip(*(found.field(k).to_pylist() for k in ("at", "h", "n")), reach.tolist(), before, after, strict=True):
                    context = text[at - b : at + e]
                    owners = seen.setdefault((h, n > group, r, b, context), [])
                    size += not owners and len(context)
                    owners.append({"sha": shas[i], "doc": docs[i], "at": at})
                if size > 8 << 20:
                    yield rows(seen)
                    seen, size = {}, 0
            if seen:
                yield rows(seen)

    return candidates.mapInArrow(run, f"h long, hot boolean, reach long, before int, context binary, owners {OWNERS}")


class SuffixOrder:
    """Byte strings in suffix order within their groups: the order, each string's rank in it, and its LCP with the string
    before it (-1: first of a group). Strings are runs of `data` from `start`, read forwards (step 1) or backwards (-1)."""

    def __init__(self, group: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int):
        m = len(group)
        at = np.arange(width)
        grid = np.zeros((m, 4 + width), np.uint8)
        grid[:, :4] = group.astype(">u4").view(np.uint8).reshape(m, 4)
        if len(data) and width:
            np.multiply(data[np.clip(start[:, None] + step * at, 0, len(data) - 1)], at < size[:, None], out=grid[:, 4:])
        # Zero bytes at an end sort like no bytes; the LCP is cut to the sizes, so ties do no harm.
        self.order = np.argsort(grid.view(f"S{4 + width}").ravel(), kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[self.order] = np.arange(m)
        grid, size, group = grid[self.order, 4:], size[self.order], group[self.order]
        differ = grid[1:] != grid[:-1]
        self.lcp = np.full(m, -1)
        if m > 1:
            equal = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(m - 1, np.int64)
            self.lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(equal, np.minimum(size[1:], size[:-1])), -1)

    def least(self) -> list[np.ndarray]:
        """Minima of the LCPs over runs of 1, 2, 4, ... entries."""
        table = [self.lcp]
        while 2 << len(table) - 1 <= len(self.lcp):
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table


def common(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """LCP of the suffixes of ranks first < last."""
    level = np.log2(last - first).astype(np.int64)
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(table[k][first[of] + 1], table[k][last[of] - (1 << int(k)) + 1])
    return out


def factors(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix of a suffix order: the greater LCP with the nearest suffixes of a smaller
    position before and after it. lcp: with the suffix before, -1 where an interval begins. -1: no smaller position.
    """

    def nearest(position, lcp):
        """LCP with the nearest smaller position before. Pointers jump over what is greater, each by its target's own jump."""
        to, low = np.arange(len(position)) - 1, lcp.copy()
        to[lcp < 0] = -1
        left = np.flatnonzero(to >= 0)
        left = left[position[to[left]] > position[left]]
        while len(left):
            by = to[left]
            low[left] = np.minimum(low[left], low[by])
            to[left] = to[by]
            left = left[to[left] >= 0]
            left = left[position[to[left]] > position[left]]
        low[to < 0] = -1
        return low

    back = np.append(lcp[1:], -1)[::-1]
    return np.maximum(nearest(position, lcp), nearest(position[::-1], back)[::-1])


def repeated_starts(group: np.ndarray, before: np.ndarray, reach: np.ndarray, data: np.ndarray, offsets: np.ndarray, weight: np.ndarray, position: np.ndarray, lengths: list[int], keep: str) -> np.ndarray:
    """[context, length, 4]: least and greatest distance before its anchor at which a factor of that length starts, for the
    first owner of the context and for its other owners; -1 where there is none. reach: where the anchor's windows start;
    position: rank of the first owner in text order; weight: number of owners; data and offsets: the contexts' bytes.
    """
    m, window, ranges = len(group), max(lengths), unpacked(reach, len(lengths))
    size = np.diff(offsets)
    after = size - before
    out = np.full((m, len(lengths), 4), -1)

    def note(of, column, x_from, x_to, factor):
        """Starts from x_from to x_to bytes before the anchors, of suffixes that share `factor` bytes from the anchor on."""
        for k, w in enumerate(lengths):
            low, high = np.maximum(np.maximum(x_from, w - factor), ranges[k][0][of]), np.minimum(x_to, ranges[k][1][of])
            ok = low <= high
            rows, low, high = of[ok], low[ok], high[ok]
            out[rows, k, column] = np.where(out[rows, k, column] < 0, low, np.minimum(out[rows, k, column], low))
            out[rows, k, column + 1] = np.maximum(out[rows, k, column + 1], high)

    several = np.flatnonzero(weight > 1)
    note(several, 2, 0 * several, before[several], after[several])
    if keep == "none":
        note(several, 0, 0 * several, before[several], after[several])
    right = SuffixOrder(group, data, offsets[:-1] + before, after, window, 1)
    left = SuffixOrder(group, data, offsets[:-1] + before - 1, before, int(before.max(initial=0)), -1)
    minima, least = right.least(), min(lengths)
    # The distinct LCPs of each group in the left order, in turn: depths at which its intervals are split.
    of_group = group[left.order]
    depths = np.divmod(np.unique((of_group * window + left.lcp)[left.lcp >= 0]), window)
    first = np.searchsorted(depths[0], np.arange(group.max(initial=0) + 2))
    for turn in range(int(np.diff(first).max(initial=0))):
        there = np.flatnonzero(first[of_group] + turn < first[of_group + 1])
        at = first[of_group[there]] + turn
        depth, floor = depths[1][at], (np.where(at > first[of_group[there]], depths[1][at - 1], -1) + 1)
        interval = np.cumsum(left.lcp[there] < depth)
        alone = np.append(interval[1:] != interval[:-1], True) & np.append(True, interval[1:] != interval[:-1])
        there, depth, floor, interval = (v[~alone] for v in (there, depth, floor, interval))
        if not len(there):
            continue
        of = left.order[there]
        by = np.lexsort((right.rank[of], interval))
        of, interval, depth, floor = of[by], interval[by], depth[by], floor[by]
        same = interval[1:] == interval[:-1]
        lcp = np.full(len(of), -1)
        pairs = np.flatnonzero(same)
        lcp[pairs + 1] = common(minima, right.rank[of[pairs]], right.rank[of[pairs + 1]])
        longest = factors(position[of], lcp)
        if keep == "none":
            longest = np.maximum(longest, factors(-position[of], lcp))
        hit = np.flatnonzero(longest + depth >= least)
        note(of[hit], 0, floor[hit], depth[hit], longest[hit])
    return out


def group_spans(contexts: DataFrame, lengths: list[int], keep: str, group: int) -> DataFrame:
    """Intervals (sha, length, start, end) of repeated bytes; the contexts of hot anchors come back as they are."""
    rest = ["h", "reach", "before", "context", "owners"]
    types = {f.name: f.type for f in SPAN}

    def returned(t: pa.Table) -> pa.RecordBatch:
        return record_batch(SPAN, *(pa.nulls(len(t), types[k]) for k in ("sha", "length", "start", "end")), *(t.column(c).combine_chunks() for c in rest))

    def run(batches):
        for whole, t in streamed_groups(batches, ["hot", "h"], group):
            hot = np.asarray(t.column("hot").to_numpy(zero_copy_only=False), bool)
            if not whole or hot.any():
                yield returned(t if not whole else t.filter(pa.array(hot)))
            t = t.filter(pa.array(~hot)).combine_chunks()
            if not whole or not len(t):
                continue
            bounds, owners, context = group_bounds(t, ["h"]), t.column("owners").combine_chunks(), t.column("context").combine_chunks()
            weight = owners.value_lengths().to_numpy().astype(np.int64)
            flat = owners.flatten()
            doc, at = flat.field("doc").fill_null(np.iinfo(np.int64).max).to_numpy(), flat.field("at").to_numpy()
            of = np.repeat(np.arange(len(t)), weight)
            order = np.lexsort((at, doc))
            rank = np.empty(len(flat), np.int64)
            rank[order] = np.arange(len(flat))
            first = np.full(len(t), len(flat))
            np.minimum.at(first, of, rank)
            data, offsets = utf8(context)
            x = repeated_starts(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), t.column("before").to_numpy().astype(np.int64), t.column("reach").to_numpy(), data, offsets, weight, first, lengths, keep)
            lead = rank == first[of]
            for k, w in enumerate(lengths):
                low, high = (np.where(lead, x[of, k, c], x[of, k, c + 2]) for c in (0, 1))
                hit = np.flatnonzero(low >= 0)
                if len(hit):
                    yield record_batch(SPAN, flat.field("sha").take(pa.array(hit)), np.full(len(hit), w, np.int32), (at - high)[hit], (at + w - low)[hit], *(pa.nulls(len(hit), types[c]) for c in rest))

    # Hot contexts only pass through, so they are dealt by their content.
    salt = F.when(F.col("hot"), F.xxhash64("context")).otherwise(0)
    dealt = contexts.repartition("h", salt).sortWithinPartitions("hot", "h")
    return dealt.mapInArrow(run, f"sha binary, length int, start int, end int, h long, reach long, before int, context binary, owners {OWNERS}")


def shared_with_next(sides: pa.Array, h: np.ndarray) -> np.ndarray:
    """LCP of each byte string with the next one of the same h."""
    data, offsets = utf8(sides)
    size, out = np.diff(offsets), np.zeros(max(0, len(sides) - 1), np.int64)
    for i in range(0, len(out), 4096):
        a = np.arange(i, min(i + 4096, len(out)))
        at = np.arange(int(size[i : i + 4097].max()))
        if len(at):
            x, y = (data[np.minimum(offsets[r][:, None] + at, len(data) - 1)] for r in (a, a + 1))
            differ = x != y
            equal = np.where(differ.any(axis=1), differ.argmax(axis=1), len(at))
            out[a] = np.where(h[a] == h[a + 1], np.minimum(equal, np.minimum(size[a], size[a + 1])), 0)
    return out


def agreements(rows: DataFrame, lengths: list[int], keep: str, backwards: bool) -> DataFrame:
    """(row, extent, low, high) from one global order of what follows the anchors (or precedes them, read backwards).

    extent: most bytes on that side that are shared with another row of the anchor; neighbours tell, and where there is
    none to ask, at the ends of a partition, all bytes count. low, high: where factors of the shorter length start that are
    shared with a neighbour (keep="first": an earlier one); low is null where there is none.
    """
    schema = pa.schema([("row", pa.int64()), ("extent", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
    far, w = 1 << BITS, min(lengths)

    def sides(batches):
        for batch in batches:
            cut = [(c[:b][::-1], c[b:]) for c, b in zip(batch.column("context").to_pylist(), batch.column("before").to_pylist(), strict=True)]
            head, tail = (pa.array([c[i] for c in cut], pa.binary()) for i in (0, 1))
            first = batch.column("first")
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("h"), batch.column("reach"), first.field("doc"), first.field("at"), *((head, tail) if backwards else (tail, head))], ["row", "h", "reach", "doc", "at", "side", "other"])

    def compare(batches):
        held, carried = None, (0, far, -1)
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            h, doc, at = (t.column(c).to_numpy() for c in ("h", "doc", "at"))
            along, other = (shared_with_next(t.column(c).combine_chunks(), h) for c in ("side", "other"))
            left, right = (along, other) if backwards else (other, along)
            later = (doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (at[1:] > at[:-1])
            least, most = unpacked(t.column("reach").to_numpy(), len(lengths))[-1]
            extent, low, high = np.zeros(len(t), np.int64), np.full(len(t), far), np.full(len(t), -1)
            extent[0], low[0], high[0] = (len(t.column("side")[0].as_py()), far, -1) if held is None else carried
            for row, told in ((slice(1, None), later), (slice(None, -1), ~later)):
                extent[row] = np.maximum(extent[row], along)
                a, b = np.maximum(least[row], w - right), np.minimum(most[row], left)
                ok = (a <= b) & (told | (keep == "none"))
                low[row], high[row] = np.where(ok, np.minimum(low[row], a), low[row]), np.where(ok, np.maximum(high[row], b), high[row])
            held, carried = t.slice(len(t) - 1).to_batches()[0], (extent[-1], low[-1], high[-1])
            if len(t) > 1:
                yield record_batch(schema, t.column("row").combine_chunks().slice(0, len(t) - 1), extent[:-1], pa.array(low[:-1], pa.int32(), mask=low[:-1] == far), high[:-1])
        if held is not None:
            yield record_batch(schema, held.column("row"), [len(held.column("side")[0].as_py())], [None if carried[1] == far else int(carried[1])], [int(carried[2])])

    dealt = rows.select("row", "h", "reach", "first", "before", "context").mapInArrow(sides, "row long, h long, reach long, doc long, at int, side binary, other binary")
    return dealt.repartitionByRange("h", "side", "other", "row").sortWithinPartitions("h", "side", "other").mapInArrow(compare, "row long, extent int, low int, high int")


def spread_spans(contexts: DataFrame, lengths: list[int], keep: str) -> DataFrame:
    """The intervals of anchors of any number of contexts; no task holds a group. Those of the shorter length are what
    neighbours in the two orders share, which can be less than what all share; those of the longest are complete."""
    key, latest, window = ["h", "reach", "same"], F.lit((1 << 63) - 1), lengths[0]
    rows = contexts.withColumn("same", F.md5("context")).withColumn("owners", F.transform("owners", lambda o: F.struct(F.coalesce(o["doc"], latest).alias("doc"), o["at"].alias("at"), o["sha"].alias("sha"))))
    distinct = rows.groupBy(*key).agg(F.sum(F.size("owners")).alias("n"), F.min(F.array_min("owners")).alias("first"), F.first("before").alias("before"), F.first("context").alias("context"))
    distinct = settle(distinct.withColumn("row", F.monotonically_increasing_id()), "hot-contexts", sweep=True)
    right, left = (agreements(distinct, lengths, keep, way).select("row", *[F.col(c).alias(f"{c}_{way:d}") for c in ("extent", "low", "high")]) for way in (False, True))
    several = F.col("n") > 1
    low, high = ([F.expr(f"int(shiftright(reach, {BITS * (2 * (len(lengths) - k) - side)}) & {(1 << BITS) - 1})") for k in range(len(lengths))] for side in (1, 2))
    # A context of one place is asked only for windows that it can share; one of several shares all its windows.
    agreed = settle(distinct.join(right, "row").join(left, "row").withColumns({
        "right": F.when(several, F.length("context") - F.col("before")).otherwise(F.col("extent_0")),
        "left": F.when(several, F.col("before")).otherwise(F.col("extent_1")),
    }), "hot-agreed", sweep=True)
    trimmed = agreed.withColumn("x", F.greatest(low[0], window - F.col("right"))).withColumn("to", F.least(high[0], "left")).where("x <= to")
    windows = trimmed.select("row", "h", "n", "first", "before", "context", F.explode(F.sequence("x", "to")).alias("x"))
    windows = windows.select("row", "n", "first", "x", F.unhex(F.md5(F.expr(f"concat(substring(context, before - x + 1, {window}), CAST(concat_ws(',', h, x) AS BINARY))"))).alias("d"))
    runs = windows.groupBy("d").agg(F.sum("n").alias("total"), F.min("first").alias("least")).where("total > 1")
    edge = lambda cond: (F.min(F.when(cond, F.col("x"))), F.max(F.when(cond, F.col("x"))))
    names = ("a", "b", "c", "d")
    (a, b), (c, d) = (edge(F.lit(True) if keep == "none" else cond) for cond in (F.col("first") > F.col("least"), F.col("n") > 1))
    found = windows.join(runs, "d").groupBy("row").agg(F.lit(window).alias("w"), *[x.alias(k) for x, k in zip((a, b, c, d), names, strict=True)])
    if lengths[-1] < window:
        own = [F.least("low_0", "low_1"), F.greatest("high_0", "high_1")]
        all_ = [F.when(several & (low[-1] <= high[-1]), x) for x in (low[-1], high[-1])]
        lead = [F.coalesce(x, y) for x, y in zip(all_, own, strict=True)] if keep == "none" else own
        found = found.unionByName(agreed.select("row", F.lit(lengths[-1]).alias("w"), *[x.cast("int").alias(k) for x, k in zip((*lead, *all_), names, strict=True)]).where("a IS NOT NULL OR c IS NOT NULL"))
    named = found.join(distinct.select("row", "first", *key), "row")
    got = rows.select(*key, "owners").join(named, key).select("w", "a", "b", "c", "d", "first", F.explode("owners").alias("o"))
    start, end = (F.when(F.col("o") == F.col("first"), F.col(p)).otherwise(F.col(q)) for p, q in (("b", "d"), ("a", "c")))
    return got.select("o.sha", F.col("w").alias("length"), (F.col("o.at") - start).cast("int").alias("start"), (F.col("o.at") + F.col("w") - end).cast("int").alias("end")).where("start is not null AND end is not null")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated for each row, and with_kept the bytes that are left.

    n_repeated: bytes that strings of `passage` bytes (at most `window`) cover that also start elsewhere (keep="first":
    earlier); around anchors of more than `group` places only as far as neighbours in suffix order tell.
    """
    passage = min(passage, window)
    lengths = sorted({window, passage}, reverse=True)
    if not 0 < gram <= passage or window >> BITS:
        raise ValueError(f"gram <= passage <= window < {1 << BITS} must hold")
    rows = settle(contents_of(docs, lengths, gram, id_col, text_col), "contents", sweep=True)
    contents = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("hashes", "places", "reaches")])
    anchors = contents.where(F.size("hashes") > 0).select("sha", "doc", F.explode(F.arrays_zip("hashes", "places", "reaches")).alias("a"))
    anchors = settle(anchors.select("sha", "doc", F.col("a.hashes").alias("h"), F.col("a.places").alias("at"), F.col("a.reaches").alias("reach")), "anchors", sweep=True)
    # A table of its own: a join of two exchanges, whose hot keys can be split at run time.
    twice = settle(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors-twice", sweep=True)
    shared = anchors.join(twice, "h").groupBy("sha").agg(F.first("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("at", "h", "n", "reach"))).alias("anchors"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    candidates = settle(texts.join(shared, "sha").where(F.col("_id").eqNullSafe(F.col("doc"))).select("sha", "doc", "text", "anchors"), "candidates", sweep=True)
    discard(anchors, twice)
    found = settle(group_spans(contexts_of(candidates, lengths, group), lengths, keep, group), "spans", sweep=True)
    spans = found.where("sha is not null").select("sha", "length", "start", "end")
    hot = found.where("sha is null").select("h", "reach", "before", "context", "owners")
    if not hot.isEmpty():
        # Many places may be few contexts, as in near copies: those are a group like others.
        few = hot.groupBy("h").agg(F.count_distinct(F.md5("context"), "reach").alias("kinds")).where(F.col("kinds") <= group).select("h")
        again = settle(group_spans(hot.join(few, "h").withColumn("hot", F.lit(False)), lengths, keep, max(group, HELD)), "spans-again", sweep=True)
        rest = hot.join(few, "h", "left_anti").unionByName(again.where("sha is null").select(*hot.columns))
        spans = spans.unionByName(again.where("sha is not null").select(*spans.columns)).unionByName(spread_spans(rest, lengths, keep))
    by_content = spans.groupBy("sha").agg(F.collect_list(F.struct("length", "start", "end")).alias("spans"))

    def apply(batches):
        for batch in batches:
            texts, removed, n, repeated, kept = text_column(batch, "text"), [], [], [], []
            for i in range(batch.num_rows):
                text, found = texts[i].as_buffer().to_pybytes(), batch.column("spans")[i].values
                rows = list(zip(*(found.field(k).to_pylist() for k in ("length", "start", "end")), strict=True))
                # What a repeated longer string covers, a repeated shorter one covers, too.
                runs, short = merged([(a, b) for w, a, b in rows if w == window]), merged([(a, b) for _, a, b in rows])
                edges = [0, *(e for r in runs for e in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                n.append(len(runs))
                repeated.append(sum(b - a for a, b in short))
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield record_batch(APPLIED, batch.column("sha"), removed, n, repeated, digests, kept if with_kept else [None] * len(kept))

    once = candidates.join(by_content, "sha").select("sha", "text", "spans")
    applied = once.mapInArrow(apply, "sha binary, n_removed long, n_spans long, n_repeated long, kept_sha256 string, kept binary").dropDuplicates(["sha"])
    copied = contents.select("sha", "copies", "doc")
    out = rows.select("doc_id", "n_bytes", "sha").join(copied, "sha").join(applied, "sha", "left")
    copy = F.col("copies") > 1
    if keep == "first":
        copy &= ~F.col("doc_id").eqNullSafe(F.col("doc"))
    gone = copy & (F.col("n_bytes") >= window)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(copy & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that repeated 400-byte strings cover are removed; has_passage says whether a shorter one repeats as well."""
    return remove_repeats(read_table(spark, sf_dir, "documents")).withColumn("has_passage", F.col("n_repeated") > 0)
