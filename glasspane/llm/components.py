"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, settle

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of the graph with these links, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        if (label == before).all():
            if (label[x] == label[y]).all():
                break
    label = label[label]
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def contracted(links: DataFrame) -> DataFrame:
    """The links of each batch as a forest: fewer rows, the same components."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
            yield record_batch(EDGES, *forest(a, b))

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without links are not in the result.

    Every round is one table in the shared folder; nothing but two numbers a round reaches the driver.
    """
    star = lambda rows: rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = settle(star(contracted(links)), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = star(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = star(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))))
        now = settle(small, "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
