"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, python_ready, spread_join, staged

#: Edges that a task joins by itself before they meet others'.
PER_TASK = 1_000_000


def contract(batches):
    """A star for each component of a task's edges (a, b): its nodes with the smallest one."""
    from .simhash import Forest

    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
    nodes, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(*np.split(place, 2))
    root = forest.settle()
    low = np.flatnonzero(root != np.arange(len(root)))
    for k in range(0, len(low), 65_536):
        some = low[k : k + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["a", "b"])


def components(edges: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b: longs) with the smallest node it reaches, roots themselves left out.

    Each task turns its edges into stars by union-find, as many tasks as ``per_task`` edges ask for. If
    that is more than one, large-star and small-star steps follow in turn: every node links
    its larger, then its smaller neighbours to the smallest one it knows, and
    tasks join what they hold again. Steps shrink the paths until only stars are left, in
    about the logarithm of their length, and go on to the fixed point, which they reach because every step
    lowers a neighbour or changes nothing. Each step is written in the shared folder, so lineage stays
    short and survives lost executors; its table goes once the next one is there.
    Minima combine before the shuffle, and a node with many neighbours meets its minimum by
    a broadcast, so no task gets all edges of a large group's centre. Links with
    a null end are left out. No edges: no rows.
    """

    def stars(links: DataFrame, n: int) -> DataFrame:
        return python_ready(links).select("a", "b").repartition(n).mapInArrow(contract, "a long, b long")

    given = staged(edges.where("a <> b").select("a", "b"), "edges")
    tasks = max(1, -(-given.count() // per_task))
    now = staged(stars(given, tasks), "edges")
    discard(given)
    mark = None
    while tasks > 1:
        size = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both, low, "a", "n", 2 * size).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct()
        before, now = now, staged(small, "edges")
        discard(before)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
