"""SimHash near-duplicates: fingerprints over word shingles, pigeonhole blocks, exact Hamming verification, components.

Equal fingerprints are one class from the start. The 64 bits are cut into 6 runs; two fingerprints that differ in at most
3 bits agree on 3 whole runs, so each class is put under its 20 choices of 3 runs and only classes under one key are
compared. A key with more than `GROUP` classes is not compared in place: its rows pass through in small batches and are
dealt once more, by 5 of 8 pieces of their remaining bits, which leaves at most 13 free bits and thus at most 8,192
classes under a key. No pair is lost and no task holds an unbounded group. A task gives a forest of the links that it
verified, never all pairs.

Defined cases: null text is empty, its fingerprint zero, linked like any other; equal rows are one class; rows with a
null id get the component of their class and never name one; an empty table gives an empty result.

These values are those of op2. The pipeline's stage has its own: it links documents whose sets of 5-word shingles have a
Jaccard similarity of 0.8 or more (`similar`). At 0.8, 64-bit fingerprints differ in 10 bits on average and often in more
than 15; pigeonhole blocks for such a radius would have runs of 3 bits or tens of thousands of choices a document. So the
stage's fingerprints have 2,560 bits, each set as in op2, and their 160 runs of 16 bits are the blocks: two sets at 0.8
agree in a bit with probability 0.85, and share no run with probability 6e-6. Classes under one run are compared by the
Hamming distance of 128 bits (at 0.8: 19 of them differ, 4 more or less; over 44 in one pair of a thousand million), and what
is near is checked by its exact similarity. Sets of 4 and 5 shingles, where a shingle more turns more bits, also meet under
the sets of 4 that they hold; smaller ones are similar to none but equal sets. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, group_bounds, read_table, record_batch, settle, small_batches, streamed_groups, text_column, text_parts
from .components import components, forest

SHINGLE, SEED, DISTANCE, GROUP = 3, 42, 3, 1024
#: Of the pipeline's stage: words a shingle, least similarity as a fraction; words of 64 bits in a fingerprint, bits of 128 in
#: which near ones differ at most, parts of the blocks that are dealt out one after the other. Near classes under a block are
#: paired where they are up to PAIRED; more are searched together, PIECE shingles at a time. Blocks of more than MOST classes
#: are dealt once more, in pieces that meet two by two.
STAGE_SHINGLE, ABOVE, BELOW, WIDE, APART, ROUNDS, PAIRED, PIECE, MOST = 5, 4, 5, 40, 44, 4, 32, 1 << 20, 1 << 13
#: Odd factors of the hashes behind each word of a fingerprint; the lowest bit of each byte.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX, LOW = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x0101010101010101)
PRINTS = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int32())), ("x", pa.int64()), ("y", pa.int64())])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("many", pa.bool_()), ("key", pa.int32()), ("n", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])
SETS = pa.schema([("cls", pa.int64()), ("shingles", pa.list_(pa.int64()))])
OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("fp", pa.int64())])


def masks(bits: list[int], pieces: int, errors: int) -> list[int]:
    """Bit masks of all choices of pieces - errors out of `pieces` runs of these bits, as signed 64-bit numbers."""
    runs = [sum(1 << bits[i] for i in part) for part in np.array_split(np.arange(len(bits)), pieces)]
    found = [sum(choice) for choice in combinations(runs, pieces - errors)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


BLOCKS = masks(list(range(64)), 6, DISTANCE)
#: For each of BLOCKS: the masks that fix most of the bits it leaves free.
INNER = [[m | s for s in masks([i for i in range(64) if not m >> i & 1], 8, DISTANCE)] for m in BLOCKS]


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    n = len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    h = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in text_column(batch, "text")], np.uint64)
            yield record_batch(OUT, batch.column("doc_id"), fp.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs within each group that differ in at most DISTANCE bits, as a forest."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    a, b, kept = [], [], 0
    left, d = np.arange(len(fp)), 1
    while True:
        left = left[end[left] > left + d]
        if not len(left):
            break
        hit = left[np.bitwise_count(fp[left] ^ fp[left + d]) <= DISTANCE]
        a.append(hit)
        b.append(hit + d)
        kept += len(hit)
        if kept > 1 << 18:
            x, y = forest(np.concatenate(a), np.concatenate(b))
            a, b, kept = [x], [y], 0
        d += 1
    return forest(np.concatenate(a), np.concatenate(b)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def verified(dealt: DataFrame, most: int) -> DataFrame:
    """From (t, key, fp, node) sorted by (t, key): links (a, b), and the rows of keys with more than `most` rows as (a, null, t, fp)."""

    def run(batches):
        for whole, t in streamed_groups(batches, ["t", "key"], most):
            node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
            if whole:
                x, y = close_pairs(fp, group_bounds(t, ["t", "key"]))
                yield record_batch(FOUND, node[x], node[y], pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.int64()))
            else:
                yield record_batch(FOUND, node, pa.nulls(len(t), pa.int64()), t.column("t").combine_chunks(), fp.view(np.int64))

    return dealt.mapInArrow(run, "a long, b long, t int, fp long")


def dealt(rows: DataFrame, pairs: F.Column) -> DataFrame:
    """Rows under each (t, key) of an array, sorted by it."""
    out = rows.select("fp", "node", F.explode(pairs).alias("_k")).select(F.col("_k.t").alias("t"), F.col("_k.key").alias("key"), "fp", "node")
    return out.repartition("t", "key").sortWithinPartitions("t", "key")


def links(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) over the nodes of classes (fp, node), one per fingerprint: a forest with the components of all pairs within DISTANCE."""
    numbers = lambda ms: F.array(*[F.lit(m).cast("long") for m in ms])
    keys = lambda ms, t: F.transform(ms, lambda m, i: F.struct((t + i).cast("int").alias("t"), F.col("fp").bitwiseAND(m).alias("key")))
    first = settle(verified(dealt(classes, keys(numbers(BLOCKS), F.lit(0))), group), "simhash-links")
    large = first.where("b is null").select("t", "fp", F.col("a").alias("node"))
    inner = F.element_at(F.array(*[numbers(part) for part in INNER]), F.col("t") + 1)
    # Settled as well: what reads it has a Python worker of its own, and a task would else hold two.
    second = settle(verified(dealt(large, keys(inner, F.col("t") * len(INNER[0]))), 1 << 13), "simhash-links")
    return first.where("b is not null").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) for each row."""
    prints = settle(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    reached = components(links(classes))
    named = classes.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def sliced(batches):
    """Batches of about PART_BYTES of text: what a task makes of them is not held for thousands of texts at a time."""
    for batch in batches:
        for a, end, *_ in text_parts(text_column(batch, "text")):
            yield batch.slice(a, end - a)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, STAGE_SHINGLE), np.uint64))


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number that stands for the set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE words: each bit is set if over half of the set's hashes for its word have it set, in one fixed order of the bits."""
    counts = np.zeros((8, WIDE, 8), np.int64)
    for i in range(0, len(shingles), 255):
        h = shingles[i : i + 255, None] * FACTORS
        h = (h ^ (h >> np.uint64(32))) * MIX
        h ^= h >> np.uint64(29)
        for bit in range(8):  # every eighth bit at a time: sums of up to 255 stay within their byte
            counts[bit] += ((h >> np.uint64(bit)) & LOW).sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(WIDE, 8)
    return np.packbits(counts * 2 > len(shingles)).view(np.uint64)


def band_keys(shingles: np.ndarray, prints: np.ndarray | None = None) -> np.ndarray:
    """The runs of 16 bits of the fingerprint, each with its number; for 4 or 5 shingles also a number for each 4 of them."""
    if len(shingles) < 4:
        return np.zeros(0, np.int32)
    runs = (wide_fingerprint(shingles) if prints is None else prints).view(np.uint16).astype(np.int32)
    fours = [shingles] if len(shingles) == 4 else [np.delete(shingles, i) for i in range(5)] if len(shingles) == 5 else []
    return np.concatenate([np.arange(len(runs), dtype=np.int32) << 16 | runs, np.array([class_of(x) & (1 << 30) - 1 | 1 << 30 for x in fours], np.int32)])


def prints_of(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n, keys, x, y): each text's class, number of shingles, blocks, and the first 128 bits of its fingerprint."""

    def run(batches):
        for batch in sliced(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes()) for t in text_column(batch, "text")]
            prints = [wide_fingerprint(x) for x in sets]
            keys = pa.array([band_keys(x, p) for x, p in zip(sets, prints, strict=True)], pa.list_(pa.int32()))
            first = np.array([p[:2] for p in prints], np.uint64).reshape(-1, 2).view(np.int64)
            yield record_batch(PRINTS, batch.column("doc_id"), [class_of(x) for x in sets], [len(x) for x in sets], keys, first[:, 0], first[:, 1])

    return docs.mapInArrow(run, "doc_id long, cls long, n int, keys array<int>, x long, y long")


def sets_of(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in sliced(batches):
            sets = [shingle_set(t.as_buffer().to_pybytes()) for t in text_column(batch, "text")]
            yield record_batch(SETS, [class_of(x) for x in sets], pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())))

    return docs.mapInArrow(run, "cls long, shingles array<long>")


def similar_sets(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers of a forest with the components of all pairs of these sets that are similar enough.

    A search from set to set: each that is reached is compared with all that are not, so copies of one text leave early.
    """
    known, at = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(known), np.int64)
    own = np.split(at, np.cumsum(sizes)[:-1])
    left = np.arange(len(sizes))
    queue, a, b = [], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            at = np.concatenate([own[i] for i in left]) if len(left) else at[:0]
            continue
        x = queue.pop()
        mark[own[x]] = 1
        common = np.add.reduceat(mark[at], np.concatenate([[0], np.cumsum(sizes[left])[:-1]]))
        mark[own[x]] = 0
        hit = (ABOVE + BELOW) * common >= ABOVE * (sizes[left] + sizes[x])
        if hit.any():
            a += [x] * int(hit.sum())
            b += left[hit].tolist()
            queue += left[hit].tolist()
            at = at[np.repeat(~hit, sizes[left])]
            left = left[~hit]
    return np.array(a, np.int64), np.array(b, np.int64)


def hits(near: Callable[[np.ndarray, np.ndarray], np.ndarray], bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all near pairs within each group, those at one distance in the table at a time."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    left, d = np.arange(len(end)), 1
    while len(left := left[end[left] > left + d]):
        hit = left[near(left, left + d)]
        yield hit, hit + d
        d += 1


def forest_of(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    held, kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for part in parts:
        held.append(part)
        kept += len(part[0])
        if kept > 1 << 18:
            held, kept = [forest(*map(np.concatenate, zip(*held, strict=True)))], 0
    return forest(*map(np.concatenate, zip(*held, strict=True)))


def near_classes(dealt_out: DataFrame, by: list[str], most: int) -> DataFrame:
    """From (key, cls, n, x, y), by which it is dealt out and sorted: (a, b, many): all near pairs of small near groups under a key,
    or with many the links of a forest of a large one; and classes of keys with more than `most` as (a, null, null, key, n, x, y).
    """
    paired = PAIRED

    def run(batches):
        for whole, t in streamed_groups(batches, by, most):
            cls, n, key = (t.column(c).to_numpy() for c in ("cls", "n", "key"))
            x, y = (t.column(c).to_numpy().view(np.uint64) for c in ("x", "y"))
            if not whole:
                yield record_batch(MET, cls, pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.bool_()), key, n, x.view(np.int64), y.view(np.int64))
                continue

            def near(i, j):
                apart = np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j])
                return (apart <= APART) & (BELOW * np.minimum(n[i], n[j]) >= ABOVE * np.maximum(n[i], n[j]))

            node, root = forest_of(hits(near, group_bounds(t, by)))
            group = np.arange(len(t))
            group[node] = root
            size = np.bincount(group, minlength=len(t))[group]
            rows = np.flatnonzero((size > 1) & (size <= paired))
            rows = rows[np.argsort(group[rows], kind="stable")]
            bounds = np.flatnonzero(np.diff(group[rows], prepend=-1, append=-1))
            large = size[node] > paired
            found = [(node[large], root[large])]
            found += [(rows[i], rows[j]) for i, j in hits(lambda i, j: near(rows[i], rows[j]), bounds)] if len(rows) else []
            a, b = (cls[np.concatenate(side)] for side in zip(*found, strict=True))
            gone = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())
            yield record_batch(MET, np.minimum(a, b), np.maximum(a, b), np.arange(len(a)) < large.sum(), *gone)

    sorted_ = dealt_out.repartition(*by).sortWithinPartitions(*by)
    return sorted_.mapInArrow(run, "a long, b long, many boolean, key int, n int, x long, y long")


def in_pieces(rows: DataFrame, pieces: F.Column) -> DataFrame:
    """Rows with i and j: pieces of a large key, by a hash of cls, meet two by two, so every pair of its rows is under one (key, i, j)."""
    own = F.pmod(F.xxhash64("cls"), pieces).cast("int")
    with_each = F.transform(F.sequence(F.lit(0), pieces - 1), lambda q: F.struct(F.least(own, q).alias("i"), F.greatest(own, q).alias("j")))
    return rows.withColumn("_d", F.explode(with_each)).select(*rows.columns, "_d.i", "_d.j")


def candidates(classes: DataFrame, most: int) -> DataFrame:
    """(a, b, many) of near_classes under all blocks of classes (cls, n, keys, x, y)."""
    steps = []
    for r in range(ROUNDS):  # the shuffle files of one part are gone before the next
        part = F.filter("keys", lambda k: k.bitwiseAND(F.lit(ROUNDS - 1)) == r)
        steps.append(settle(near_classes(classes.select("cls", "n", "x", "y", F.explode(part).alias("key")), ["key"], most), "similar-met", sweep=True))
    met = reduce(DataFrame.unionByName, steps)
    large = met.where("b IS NULL").select("key", F.col("a").alias("cls"), "n", "x", "y")
    large = large.join(large.groupBy("key").agg(F.count("*").alias("members")), "key")
    again = in_pieces(large, F.ceil(F.col("members") / (most // 2)).cast("int")).drop("members")
    # Pieces are held whole, however uneven they are.
    second = settle(near_classes(again, ["key", "i", "j"], 1 << 30), "similar-met", sweep=True)
    return met.where("b IS NOT NULL").unionByName(second).select("a", "b", "many")


def similar(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b): links between classes of sets, with the components of all candidates that are similar enough.

    docs: doc_id, text; prints: their classes, blocks and fingerprints.
    """
    first = [F.first(c).alias(c) for c in ("n", "keys", "x", "y")]
    classes = settle(prints.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), *first), "similar-classes", sweep=True)
    met = candidates(classes, MOST)
    pairs = settle(met.where("NOT many").select("a", "b").distinct(), "similar-pairs")
    # A large near group is searched once, whatever number of blocks it shares.
    groups = components(met.where("many").select("a", "b")).select(F.col("node").alias("cls"), F.col("component").alias("key"))
    many = settle(groups.join(classes.select("cls", "n"), "cls"), "similar-many")
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).unionByName(many.select("cls")).distinct()
    ids = classes.select("cls", "doc_id").join(needed, "cls", "left_semi").select("doc_id").distinct()
    sets = settle(sets_of(docs.join(ids, "doc_id", "left_semi")).dropDuplicates(["cls"]), "similar-sets")
    side = lambda c, x: sets.select(F.col("cls").alias(c), F.col("shingles").alias(x))
    common, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    close = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where((ABOVE + BELOW) * common >= ABOVE * total).select("a", "b")
    shared = many.groupBy("key").agg(F.sum("n").alias("total"))
    dealt_out = in_pieces(many.join(shared, "key"), F.ceil(F.col("total") / PIECE).cast("int")).select("key", "cls", "i", "j").join(sets, "cls")

    def search(table):
        shingles, cls = table.column("shingles").combine_chunks(), table.column("cls").to_numpy()
        x, y = similar_sets(shingles.value_lengths().to_numpy().astype(np.int64), shingles.flatten().to_numpy())
        return pa.table({"a": cls[x], "b": cls[y]})

    return close.unionByName(dealt_out.groupBy("key", "i", "j").applyInArrow(search, "a long, b long"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of similarity ABOVE / BELOW or more) of rows with an id."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = settle(prints_of(texts), "similar-prints")
    reached = components(similar(texts, prints))
    named = prints.select("doc_id", "cls").join(reached.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("component"))
    named = settle(named, "similar-named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "component_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id, and one row of that, that of the least
    content hash where rows with one id differ; rows without an id stay."""
    small_batches(spark)
    found = settle(similar_documents(docs), "simhash-groups")
    gone_id, row = fresh(docs, "gone_id"), fresh(docs, "row")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    rest = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rest
    # Of rows that share an id, whatever their texts, the one of least content hash stays, wherever and however often a task runs.
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns]), "text"))
    return rest.where("doc_id is null").unionByName(rest.where("doc_id is not null").withColumn(row, first).where(F.col(row) == 1).drop(row))
