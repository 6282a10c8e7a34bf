"""Embedding near-duplicates: product quantisation over inverted lists, exact cosine rerank, components.

Vectors with the same label are compared. A coarse quantiser (k-means over a bounded sample) gives each unit vector its
inverted list; the residual is coded by 8 subspace codebooks of 256 words; the norm of what the codes miss is kept. A
vector also probes every other list whose border (the plane half-way between the two centroids) is within `MARGIN`. In a
list, asymmetric distances are sums of table look-ups over the codes; as the coding error of each row is known, a pair is
ruled out only if its distance minus that error exceeds the radius of the threshold, so the tables rule out no true pair.
What remains is reranked by the exact cosine in double precision.

Equal vectors under equal labels are one class with a count, never pairs. Lists are cut into blocks by a hash of the id,
so that a task holds one block of at most about `BLOCK` rows and streams what is compared with it; a task gives sums and
a forest of links, never the pairs. A pair that two lists find is counted in the lower of the two.

Defined cases: a null label, a null or zero vector, one with null or non-finite parts or of another length than its
partner links with nothing and is its own component; rows with a null id are left out of classes and have null results;
repeated rows of one id count as separate vectors, and different vectors under one id as one, whose links are added up; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, record_batch, settle
from .components import components, forest

COSINE, SUBSPACES, WORDS, SAMPLE, BLOCK = 0.93, 8, 256, 16384, 4096
#: A border counts as near within this share of the radius; random directions in d dimensions reach it with sqrt(d)/2 sigmas.
MARGIN = 0.5
ENTRIES = "list int, home_list int, node long, weight long, label int, vector binary, codes binary, error double, probes binary"
ENTRY_SCHEMA = pa.schema([("list", pa.int32()), ("home_list", pa.int32()), ("node", pa.int64()), ("weight", pa.int64()), ("label", pa.int32()), ("vector", pa.binary()), ("codes", pa.binary()), ("error", pa.float64()), ("probes", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


@dataclass
class Index:
    """Coarse centroids, and codebooks [subspace, word, part] of their residuals. Vectors are padded to whole parts."""

    dim: int
    centres: np.ndarray
    books: np.ndarray
    radius: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, cosine: float = COSINE, seed: int = 5) -> Index:
        """From unit vectors (rows)."""
        rng = np.random.default_rng(seed)
        x = cls.padded(sample)
        centres = kmeans(x, lists, rng)
        rest = x - centres[squared(x, centres).argmin(axis=1)]
        part = x.shape[1] // SUBSPACES
        words = [kmeans(rest[:, i * part : (i + 1) * part], WORDS, rng, 5) for i in range(SUBSPACES)]
        return cls(sample.shape[1], centres, np.stack([np.pad(w, ((0, WORDS - len(w)), (0, 0)), mode="edge") for w in words]), float(np.sqrt(2 - 2 * cosine)))

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % SUBSPACES)))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list, and for each list whether it is probed (its border is near)."""
        d = squared(self.padded(x), self.centres)
        home = d.argmin(axis=1)
        apart = np.sqrt(squared(self.centres, self.centres))[home]
        own = d[np.arange(len(x)), home][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            border = np.where(apart > 0, (d - own) / (2 * apart), np.where(np.arange(len(self.centres))[None, :] == home[:, None], 0, np.inf))
        return home, border <= MARGIN * self.radius

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the norm of what they miss."""
        rest = self.padded(x) - self.centres[home]
        part = self.books.shape[2]
        codes = np.stack([squared(rest[:, i * part : (i + 1) * part], self.books[i]).argmin(axis=1) for i in range(SUBSPACES)], axis=1)
        coded = np.concatenate([self.books[i][codes[:, i]] for i in range(SUBSPACES)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(axis=1))

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """[row, subspace, word]: squared distances of the residuals of x in list `at` to the words."""
        rest = self.padded(x) - self.centres[at]
        part = self.books.shape[2]
        return np.stack([squared(rest[:, i * part : (i + 1) * part], self.books[i]) for i in range(SUBSPACES)], axis=1)


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Unit vectors in double precision from lists of one length."""
    return units(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def packed_rows(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes: to Spark an array of numbers is one object each, bytes are one piece."""
    data, width = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def unpacked_rows(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def usable(col: str) -> F.Column:
    """Neither null nor zero, and all parts finite."""
    v = F.col(col)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def compare(index: Index | None, here: int, x: np.ndarray, codes: np.ndarray, error: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of x) with cosine of at least the threshold; the tables narrow the pairs, exact cosines decide."""
    out_q, out_x = [], []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        if index is None or here < 0:
            a, b = np.divmod(np.arange(len(part) * len(x)), len(x))
        else:
            table = index.tables(part, here)
            d = np.zeros((len(part), len(x)))
            for s in range(SUBSPACES):
                d += table[:, s, :][:, codes[:, s]]
            a, b = np.nonzero(np.sqrt(d) - error[None, :] <= index.radius + 1e-9)
        for j in range(0, len(a), 1 << 16):
            aa, bb = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            ok = np.einsum("ij,ij->i", part[aa], x[bb]) >= COSINE
            out_q.append(aa[ok] + i)
            out_x.append(bb[ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_q or none), np.concatenate(out_x or none)


class Links:
    """Sums of partners by node, and a forest of the links."""

    def __init__(self):
        self.size, self.counts, self.trees = 0, [], []

    def add(self, a, a_weight, b, b_weight) -> None:
        if len(a):
            keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            self.counts.append((keys, np.bincount(at, weights=np.concatenate([b_weight, a_weight])).astype(np.int64)))
            self.trees.append(forest(a, b))
            self.size += 2 * len(keys)

    def flush(self) -> pa.RecordBatch:
        x, y = forest(*(np.concatenate(v) for v in zip(*self.trees, strict=True)))
        node, n = (np.concatenate(v) for v in zip(*self.counts, strict=True))
        self.size, self.counts, self.trees = 0, [], []
        return record_batch(FOUND, np.concatenate([node, x]), np.concatenate([n, np.zeros(len(x), np.int64)]), pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(y, pa.int64())]))


class Block:
    """The rows of one (label, list, block) are held; rows that follow are compared with them."""

    def __init__(self, index: Index, dtype):
        self.index, self.dtype, self.key, self.held, self.base = index, dtype, None, [], None

    def take(self, key: tuple, streamed: bool, rows: pa.Table, links: Links) -> None:
        if key != self.key:
            self.seal(links)
            self.key, self.held, self.base = key, [], None
        if not streamed:
            self.held.append(rows)
            return
        self.seal(links)
        if self.base is None:
            return
        node, weight, x, codes, error, probed = self.base
        here, home = self.key[1], rows.column("home_list").to_numpy()
        q, r = compare(self.index, here, x, codes, error, units(unpacked_rows(rows.column("vector"), self.dtype)))
        # A pair with a row whose home is another list is found there too if this list's row probes that one; the lower list counts it.
        ok = home[q] == here
        ok |= home[q] > here
        ok[~ok] = ~probed[r[~ok], home[q[~ok]]]
        links.add(rows.column("node").to_numpy()[q[ok]], rows.column("weight").to_numpy()[q[ok]], node[r[ok]], weight[r[ok]])

    def seal(self, links: Links) -> None:
        """No more held rows come: compare them with each other."""
        if self.base is not None or not self.held:
            return
        t = pa.concat_tables(self.held).combine_chunks()
        here = self.key[1]
        node, weight, x = t.column("node").to_numpy(), t.column("weight").to_numpy(), units(unpacked_rows(t.column("vector"), self.dtype))
        codes = unpacked_rows(t.column("codes"), np.uint8)
        error = t.column("error").to_numpy()
        probed = np.unpackbits(unpacked_rows(t.column("probes"), np.uint8), axis=1).astype(bool)
        self.base = (node, weight, x, codes, error, probed)
        q, r = compare(self.index, here, x, codes, error, x)
        ok = q < r
        links.add(node[q[ok]], weight[q[ok]], node[r[ok]], weight[r[ok]])


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = rows.sparkSession
    kind, dtype = ("float", np.float32) if rows.select(vector_col).dtypes[0][1] == "array<float>" else ("double", np.float64)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("ok", usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = settle(rows.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vectors")

    total = classes.count()
    sample = classes.orderBy(F.xxhash64("node"), "label").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    index = None
    if len(sample):
        sizes, counts = np.unique(sample.value_lengths().to_numpy(), return_counts=True)
        dim = int(sizes[counts.argmax()])
        index = Index.fit(unit_rows(sample.filter(pa.array(sample.value_lengths().to_numpy() == dim))), int(min(4096, max(4, total**0.5 / 4))))
    shared = spark.sparkContext.broadcast(index)

    def enter(batches):
        """An entry in the home list and one in each probed list; list -length for vectors of another length."""
        for batch in batches:
            size = batch.column("vector").value_lengths().to_numpy()
            for n in np.unique(size):
                part = batch.filter(pa.array(size == n))
                index = shared.value
                node, weight, label, vector = (part.column(k) for k in ("node", "weight", "label", "vector"))
                if n != index.dim:
                    raw = vector.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(part), -1)
                    yield record_batch(ENTRY_SCHEMA, np.full(len(part), -n, np.int32), np.full(len(part), -n, np.int32), node, weight, label, packed_rows(raw), [b""] * len(part), np.zeros(len(part)), [b""] * len(part))
                    continue
                raw = vector.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(part), -1)
                x = units(raw)
                home, probed = index.assign(x)
                probed[np.arange(len(x)), home] = True
                codes, error = index.encode(x, home)
                row, at = np.nonzero(probed)
                take = pa.array(row)
                yield record_batch(ENTRY_SCHEMA, at.astype(np.int32), home[row].astype(np.int32), *(c.take(take) for c in (node, weight, label)), packed_rows(raw).take(take), packed_rows(codes).take(take), error[row], packed_rows(np.packbits(probed, axis=1)).take(take))

    entries = settle(classes.select("node", "weight", "label", "vector").mapInArrow(enter, ENTRIES), "vector-entries")
    blocks = entries.where("home_list = list").groupBy("label", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = entries.join(blocks, ["label", "list"]).withColumn("own", F.when(F.col("home_list") == F.col("list"), own)).withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("own", F.col("blocks") - 1))))
    dealt = dealt.withColumn("first", F.when(F.col("own") == F.col("block"), 0).otherwise(1)).drop("blocks")
    dealt = dealt.repartition("label", "list", "block").sortWithinPartitions("label", "list", "block", "first", "node")

    def search(batches):
        blocks, links = Block(shared.value, dtype), Links()
        for batch in batches:
            t = pa.Table.from_batches([batch])
            key = np.stack([t.column(k).to_numpy() for k in ("label", "list", "block", "first")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                blocks.take(tuple(key[s, :3].tolist()), bool(key[s, 3]), t.slice(s, e - s), links)
            if links.size > 1 << 18:
                yield links.flush()
        blocks.seal(links)
        if links.size:
            yield links.flush()

    found = settle(dealt.mapInArrow(search, "a long, n long, b long"), "vector-links")
    sums = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("other"))
    reached = components(found.where("b is not null").select("a", "b"))
    named = classes.join(sums, "node", "left").join(reached, "node", "left").select("label", "vector", (F.coalesce("other", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.where("ok").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.when(F.col("vec_id").isNotNull(), 0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
