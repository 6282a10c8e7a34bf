"""Quality classifier: supervised subword embeddings.

A text's features are its words (runs between white space), its byte n-grams that lie within one word with its bordering
white space, a mark for each word that repeats the one before it, and one end mark, all hashed into `BUCKETS`. Each bucket has a learned vector; the mean over a text's
features goes through a softmax of two classes; both are trained by plain stochastic gradient descent in numpy on a
bounded sample of labelled rows. As the output is linear in the mean, a fitted model holds one number per bucket (the
difference of the two class scores), and scoring is a gather and a mean inside Spark tasks.

Defined cases: null and empty texts have only the end mark; labels that are null are not learned from; repeated label
rows count as often as they stand; without labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table, record_batch, segment_sums, text_column, text_parts

BUCKETS, DIM, GRAMS = 1 << 16, 16, (2, 3, 4)
#: The bucket of all pairs of a word and itself.
AGAIN = 1
#: Most labelled rows that are learned from, the first by a hash of doc_id.
TRAIN_ROWS = 4000
EPOCHS, RATE = 6, 0.5
BASE = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def bucket(h: np.ndarray) -> np.ndarray:
    """Buckets 1 and up; 0 is the end mark."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lists of (text number, bucket), each in order of the texts."""
    n, owner = len(data), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not n:
        return []
    out, space, wide = [], SPACE[data], data.astype(np.uint64) + np.uint64(1)
    solid = ~space
    before = np.ones(n, bool)
    before[1:] = space[:-1] | (owner[1:] != owner[:-1])
    after = np.ones(n, bool)
    after[:-1] = before[1:]
    first, last = np.flatnonzero(solid & before), np.flatnonzero(solid & (after | np.append(space[1:], True)))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
    total = np.concatenate([[np.uint64(0)], np.add.accumulate(wide * powers[:n])])
    word = (total[last + 1] - total[first]) * back[first]
    out.append((owner[first], bucket(word)))
    again = first[1:][(word[1:] == word[:-1]) & (owner[first[1:]] == owner[first[:-1]])]
    out.append((owner[again], np.full(len(again), AGAIN)))
    inner = np.concatenate([[0], np.cumsum(space)])
    for k in GRAMS:
        if n < k:
            continue
        h = np.full(n - k + 1, np.uint64(k))
        for j in range(k):
            h = h * BASE + wide[j : n - k + 1 + j]
        ok = owner[k - 1 :] == owner[: n - k + 1]
        if k > 2:
            ok &= inner[k - 1 : n] == inner[1 : n - k + 2]
        ok &= ~(space[: n - k + 1] & space[k - 1 :])
        at = np.flatnonzero(ok)
        out.append((owner[at], bucket(h[at])))
    return out


class Model:
    """One number per bucket: score = logistic of the mean over a text's features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, data, offsets in text_parts(texts):
            total, count = np.full(b - a, float(self.weights[0])), np.ones(b - a)
            for owner, at in features(data, offsets):
                runs = np.searchsorted(owner, np.arange(b - a + 1))
                total += segment_sums(self.weights[at], runs)
                count += np.diff(runs)
            out[a:b] = 1 / (1 + np.exp(-np.clip(total / count, -50, 50)))
        return out


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 11) -> Model:
    """Stochastic gradient descent over (text, 0 or 1)."""
    rng = np.random.default_rng(seed)
    vectors, classes = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((2, DIM))
    sparse = []
    for a, b, data, offsets in text_parts(texts):
        owner, at = (np.concatenate(x) for x in zip(*[*features(data, offsets), (np.arange(b - a), np.zeros(b - a, np.int64))], strict=True))
        keys, n = np.unique(owner * BUCKETS + at, return_counts=True)
        for i, run in enumerate(np.split(np.arange(len(keys)), np.searchsorted(keys // BUCKETS, np.arange(1, b - a)))):
            share = n[run] / n[run].sum()
            sparse.append((keys[run] % BUCKETS, share, int(labels[a + i])))
    steps, done = EPOCHS * max(1, len(sparse)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sparse)):
            at, share, y = sparse[i]
            hidden = share @ vectors[at]
            z = classes @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ classes
            classes -= rate * np.outer(p, hidden)
            vectors[at] -= (rate * len(at) ** 0.5 * share)[:, None] * back
            done += 1
    return Model(vectors @ (classes[1] - classes[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most `rows` labelled documents; the ids of that sample are broadcast, its texts come to the driver."""
    few = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull()).orderBy(F.xxhash64("_id", F.lit(3)), "_id", "_y").limit(rows)
    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id").toArrow().to_pandas()
    got = got.fillna({"_text": ""}).sort_values(["_id", "_y", "_text"])
    return fit(pa.array(got["_text"], pa.large_string()), got["_y"].to_numpy())


def predict(docs: DataFrame, model: Model, held_out: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            score = shared.value.score(text_column(batch, "text"))
            yield record_batch(OUT, batch.column("doc_id"), batch.column("held_out"), score, (score >= 0.5).astype(np.int32))

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return predict(docs, train(docs, labels.where(~out)), out)
