"""Connected components of links between rows, by joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Links that a task contracts at once.
MOST_LINKS = 1 << 19


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each the smallest node that these links connect it to."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        # the labels' own labels move too, so that long chains take few rounds
        for target in (i, j, label[i], label[j]):
            np.minimum.at(new, target, low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def contracted(links: DataFrame) -> DataFrame:
    """The same components by at most one link for each node of a task's stretch, to its smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def forest() -> pa.RecordBatch:
            pairs = np.concatenate(held, axis=1)
            nodes, low = local_labels(pairs[0], pairs[1])
            away = nodes != low
            return pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(low[away])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            if sum(h.shape[1] for h in held) >= MOST_LINKS:
                yield forest()
                held = []
        if held:
            yield forest()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node that can be reached.

    After each task has contracted its own links, every node in turn hangs its larger neighbours onto the smallest node
    it knows (large star), then all its smaller ones (small star), until nothing changes. No step gathers the neighbours
    of a node: minima are partial sums, and what a node knows comes back by a join that can be split. Each step is
    written to the shared folder. Links of a node to itself and null nodes are left out; without links the result is
    empty.
    """
    clean = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    stars = stored(contracted(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    mark = None
    while True:
        # large star
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        hung = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        hung = hung.filter("a != b").distinct()
        # small star: links (a, b) go down from a; a and its smaller neighbours hang onto the smallest
        hung = stored(hung, "links")
        least = hung.groupBy("a").agg(F.min("b").alias("low"))
        down = hung.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a != b")
        stars = stored(contracted(down.unionByName(least.select("a", F.col("low").alias("b"))).distinct()), "links")
        found = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"), F.count_distinct("a").alias("nodes")).first()
        if (found["n"], found["sum"]) == mark:
            break
        mark = (found["n"], found["sum"])
        if found["n"] == found["nodes"] and stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # every node has one link, to a node that has none
    return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
