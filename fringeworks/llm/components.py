"""Connected components of an edge table, wholly on the executors, by rounds of contraction.

In a round each task joins the edges of its own partition (union-find over what a partition holds) and gives every node its smallest local root. Then rows meet by node: the
smallest root is the node's label, and roots that one node got in different partitions are the edges of the next round, which sees roots only. A star's edges
may lie anywhere, so a hot centre is at most one row a partition. Rounds end when no node has two roots; labels are then followed upwards, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ROWS = "node bigint, root bigint, clash boolean"


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p, q = find(u), find(v)
            if p != q:
                root[max(p, q)] = min(p, q)
    nodes = list(root)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "root"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that are sorted by node and root: the first root of a node is its label; each further one clashes with it."""
    node = label = last = None
    for b in batches:
        out: list[tuple[int, int, bool]] = []
        for n, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if n != node:
                node, label = n, r
                out.append((n, r, False))
            elif r != last:
                out.append((r, label, True))
            last = r
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["node", "root", "clash"])


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (u, v); self-loops and repeated edges do no harm."""
    rounds: list[DataFrame] = []
    now = edges.select("u", "v")
    for _ in range(max_rounds):
        local = now.mapInArrow(_local_roots, "node bigint, root bigint")
        met = local.repartition("node").sortWithinPartitions("node", "root").mapInArrow(_labels, _ROWS)
        met = common.written(met, "labels")
        rounds.append(met.where("not clash").select("node", F.col("root").alias("component")))
        now = met.where("clash").select(F.col("node").alias("u"), F.col("root").alias("v"))
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"components: not settled in {max_rounds} rounds")
    done = rounds.pop()
    while rounds:
        above = done.select(F.col("node").alias("component"), F.col("component").alias("_top"))
        done = rounds.pop().join(above, "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    return done
