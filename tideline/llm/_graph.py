"""Connected components of links between ids, without collecting links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import drop, store

#: Links of a forest (16 bytes each) that one task may join; more are joined in rounds over all tasks.
ONE_TASK = 4_000_000
#: Links that a task holds before it replaces them by a forest.
HELD = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the links with the smallest one that it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:  # ids are sorted, so the least number is the least id
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        np.minimum.at(low, root[x], low[x])
        np.minimum.at(low, root[y], low[y])
        low = low[low]
        if (low == root).all():
            return ids, ids[root]
        root = low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of a task as stars (least, id): one result if the forest stays below HELD."""
    a, b, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        ids, least = least_reached(np.concatenate(a), np.concatenate(b))
        far = ids != least
        return least[far], ids[far]

    for batch in batches:
        a.append(np.asarray(batch.column("a"))), b.append(np.asarray(batch.column("b")))
        held += batch.num_rows
        if held >= 2 * HELD:
            one = joined()
            if len(one[0]) > HELD:
                yield one
                a, b, held = [], [], 0
            else:
                a, b, held = [one[0]], [one[1]], len(one[0])
    if a:
        yield joined()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task, at most ONE_TASK: ids with their component, which is listed too."""
    batches = list(batches)
    if batches:
        ids, least = least_reached(*(np.concatenate([np.asarray(x.column(c)) for x in batches]) for c in "ab"))
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "component": pa.array(least)})


def forest(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over links (a, b): links with the same components, of what a task has one fewer than there are ids in a component."""
    for a, b in _stars(links):
        far = a != b
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[far]), "b": pa.array(b[far])})


def components(links: DataFrame) -> DataFrame:
    """(id, component), stored: the smallest id reachable over links (a, b), as `forest` gives them. Ids without a link aren't listed.

    Up to ONE_TASK links are joined in one task. With more, labels take the least label of a neighbour
    and then their label's own label, until none changes: the number of rounds grows with the
    logarithm of a component's width. Each round is written, so a lost executor costs one round. Hubs
    are pre-aggregated and their joins can be split.
    """
    if links.count() <= ONE_TASK:
        return store(links.repartition(1).mapInArrow(_labels, "id long, component long"), "labels")
    edges = store(links.union(links.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = store(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        seen = edges.join(labels, edges["a"] == labels["id"]).select(F.col("b").alias("id"), "component")
        least = seen.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        new = store(least.join(up, "next").select("id", F.least("next", "jump").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(edges)
            return labels
