"""Language ID by prediction by partial matching.

For each language a byte context tree of orders 0 to `order` is counted over a bounded sample of its documents. A byte
costs -log2 P under the longest context that has seen it, plus the escapes of the longer contexts that were left
(method C: a context with T occurrences and q different followers gives a follower n/(T+q) and its escape q/(T+q);
below order 0 every byte costs 8 bits; no exclusion). Statistics are frozen after counting, so the code length of a text
is exact and does not depend on partitions. The language with the shortest code wins.

Defined cases: null text or text without a letter gives `und` with score 0; ties go to the first language in
alphabetical order; repeated rows are scored alike; an empty table gives an empty result; without any learnable language
all rows are `und`. Results hold only id, held_out and the predictions, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, keep_rows, read_table, record_batch, segment_sums, small_batches, text_column, text_parts

ORDER = 4
#: Expected number of documents per language that are counted.
TRAIN_DOCS = 500
UNDETERMINED = "und"
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts: the `order` bytes before it and itself as one number; before a text stand zero bytes."""
    n = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * order, np.diff(offsets))
    padded = np.zeros(len(data) + n * order, np.uint64)
    padded[at] = data
    key = padded.copy()
    for j in range(1, order + 1):
        key[j:] |= padded[:-j] << np.uint64(8 * j)
    return key[at]


@dataclass
class Tree:
    """One language: for each order, sorted grams with the cost of the follower, and sorted contexts with the cost of their escape."""

    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def counted(cls, key: np.ndarray, n: np.ndarray, order: int) -> Tree:
        """From counts of grams of the highest order; shorter contexts are their sums."""
        out = cls([], [], [], [])
        for k in range(order + 1):
            cut = key & np.uint64((1 << 8 * (k + 1)) - 1)
            g, inverse = np.unique(cut, return_inverse=True)
            count = np.bincount(inverse, weights=n, minlength=len(g))
            c, inverse = np.unique(g >> np.uint64(8), return_inverse=True)
            total = np.bincount(inverse, weights=count, minlength=len(c))
            kinds = np.bincount(inverse, minlength=len(c))
            out.grams.append(g)
            out.costs.append(-np.log2(count / (total + kinds)[inverse]))
            out.contexts.append(c)
            out.escapes.append(-np.log2(kinds / (total + kinds)))
        return out

    def cost(self, key: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(key)), np.arange(len(key))
        for k in range(len(self.grams) - 1, -1, -1):
            g = key[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            seen = self.grams[k][at] == g
            out[left[seen]] += self.costs[k][at[seen]]
            left, g = left[~seen], g[~seen] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k], g), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == g
            out[left[known]] += self.escapes[k][at[known]]
        out[left] += 8.0
        return out


@dataclass
class Model:
    """Trees, and an open-addressing table with the costs of every learned gram of the highest order in all languages."""

    langs: list[str]
    order: int
    trees: list[Tree]
    slots: np.ndarray
    values: np.ndarray
    shift: int

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
        langs = sorted(counts)
        trees = [Tree.counted(*counts[x], order) for x in langs]
        keys = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        model = cls(langs, order, trees, np.full(1 << bits, EMPTY), np.zeros((1 << bits, len(langs))), 64 - bits)
        at, left = model._home(keys), np.arange(len(keys))
        while len(left):
            free = model.slots[at[left]] == EMPTY
            model.slots[at[left[free]]] = keys[left[free]]
            left = left[model.slots[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << bits) - 1)
        for i, tree in enumerate(trees):
            model.values[at, i] = tree.cost(keys)
        return model

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def costs(self, key: np.ndarray) -> np.ndarray:
        """Bits for each gram (rows) in each language (columns)."""
        at = self._home(key)
        got = self.slots[at]
        left = np.flatnonzero((got != key) & (got != EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            got = self.slots[at[left]]
            left = left[(got != key[left]) & (got != EMPTY)]
        out = self.values[at]
        if len(other := np.flatnonzero(self.slots[at] != key)):
            rare, inverse = np.unique(key[other], return_inverse=True)
            out[other] = np.stack([t.cost(rare) for t in self.trees], axis=1)[inverse]
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each text in each language."""
        return segment_sums(self.costs(grams(data, offsets, self.order)), offsets)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per byte of each text; texts without nulls."""
        names, score, rate = [], np.zeros(len(texts)), np.zeros(len(texts))
        for a, b, data, offsets in text_parts(texts):
            letter = segment_sums(ASCII_LETTER[data], offsets) > 0
            for i in np.flatnonzero(~letter):
                letter[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            if not self.langs:
                letter[:] = False
            if not letter.any():
                names += [UNDETERMINED] * (b - a)
                continue
            bits = self.code_lengths(data, offsets)
            best = bits.argmin(axis=1)
            least = bits[np.arange(b - a), best]
            p = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            score[a:b] = np.where(letter, p, 0)
            rate[a:b] = np.where(letter, least / np.maximum(np.diff(offsets), 1), 0)
            names += [self.langs[i] if ok else UNDETERMINED for i, ok in zip(best, letter, strict=True)]
        return names, score, rate


def train(docs: DataFrame, per_lang: int = TRAIN_DOCS, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count context trees over about `per_lang` documents of each language, chosen by a hash of the id.

    The sample is what bounds the model: it holds at most one gram per byte of the sampled texts and order.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model.build({}, order)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    chosen = docs.where((F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                sums: list[tuple[np.ndarray, np.ndarray]] = []
                for _, _, data, offsets in text_parts(text_column(batch, "text").filter(pa.array(langs == lang))):
                    sums.append(np.unique(grams(data, offsets, order), return_counts=True))
                key, n = (np.concatenate(x) for x in zip(*sums, strict=True))
                yield record_batch(schema, [lang] * len(key), key.astype(np.int64), n)

    found = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = found.toArrow().to_pandas().sort_values(["lang", "gram"])
    return Model.build({k: (x["gram"].to_numpy().astype(np.uint64), x["n"].to_numpy()) for k, x in got.groupby("lang")}, order)


def predict(docs: DataFrame, model: Model, held_out: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score (posterior of the language under equal priors), bits_per_byte for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            names, score, rate = shared.value.predict(text_column(batch, "text"))
            yield record_batch(OUT, batch.column("doc_id"), batch.column("held_out"), names, score, rate)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return predict(docs, train(docs.where(~out)), out)


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a determined language whose posterior is at least 0.5."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs))

    def keep(batch):
        names, score, _ = model.value.predict(text_column(batch, "text"))
        return np.array([n != UNDETERMINED for n in names], bool) & (score >= 0.5)

    return keep_rows(docs, keep)
