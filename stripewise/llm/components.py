"""Connected components of a link table, by contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _stars(batches):
    """The links of one partition as stars: each node with the smallest node that the partition's links reach.

    Links are folded in blocks, so memory follows the nodes of the partition and not its links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(x), root(y)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                up[high] = low
                up.setdefault(low, low)
        if len(up) > 2_000_000:
            yield _links(up, root)
            up.clear()
    if up:
        yield _links(up, root)


def _links(up: dict, root) -> pa.RecordBatch:
    pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
    both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), two bigint columns: root is the smallest node reachable.

    Each round maps every node to its smallest neighbour (itself included) and contracts the links; a round
    at least halves the nodes that are no local minimum. Tables of each round are stored, so lost executors
    cost one round at most. Only the emptiness of the link table comes to the driver. No links: no rows.
    Links from a node to itself and repeated links are allowed."""
    left = stored(links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a != b").mapInArrow(_stars, "a bigint, b bigint"), "links")
    labels = None
    rounds = 0
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("low")), "low")
        if labels is None:
            labels = low.withColumnRenamed("low", "root")
        else:
            labels = labels.join(low.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        one = low.select(F.col("node").alias("a"), F.col("low").alias("la"))
        two = low.select(F.col("node").alias("b"), F.col("low").alias("lb"))
        next_ = left.join(one, "a").join(two, "b").where("la != lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        left = stored(next_, "links")
        rounds += 1
        if left.isEmpty():
            return labels
        if rounds % 4 == 0:
            labels = stored(labels, "labels")
