"""Connected components of an edge table: joined within tasks, then by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import released, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over a written table of edges (u, v) with u > v, which is deleted: neighbours are hung on the least one.

    The least neighbour is written before it is joined back, so both sides of the
    join are plain tables and Spark may split a hub's partition.
    """
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    seen = edges.unionByName(flipped) if large else edges
    least = written(seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    hung = seen.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(hung.where("u <> v").distinct(), "star")
    released(least, edges)
    return out


#: Edges that a task joins on average before the stars.
TASK_EDGES = 1_000_000


def _joined_in_tasks(edges: DataFrame) -> DataFrame:
    """A few edges (u, v) with u > v that connect what each task's edges do: each node hangs on the least it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = {}
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                while (up := root.get(u, u)) != u:
                    root[u] = root.get(up, up)
                    u = up
                while (up := root.get(v, v)) != v:
                    root[v] = root.get(up, up)
                    v = up
                if u != v:
                    root[max(u, v)] = min(u, v)
        nodes, tops = list(root), []
        for node in nodes:
            top = node
            while (up := root.get(top, top)) != top:
                top = up
            root[node] = top
            tops.append(top)
        for at in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536], t) for x, t in zip((nodes, tops), batch.schema.types)], names=["u", "v"])

    tasks = -(-edges.count() // TASK_EDGES)
    # A task that reads a written table gets a split of it, which may be far more edges.
    dealt = edges.coalesce(max(1, tasks)) if tasks < edges.rdd.getNumPartitions() else edges.repartition(tasks)
    return dealt.mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's least node.

    ``edges`` has two columns of one ordered type.  Loops and repeated edges are
    allowed, rows with a null end are ignored, and an empty table gives an empty
    result.  A task holds the nodes of its own edges.  Each half-round is two shuffles
    of what tasks leave; rounds grow with the logarithm of the longest path there.
    """
    a, b = edges.columns
    ordered = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = written(_joined_in_tasks(written(ordered.where("u <> v").distinct(), "links")), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        now = _star(_star(now, large=True), large=False)
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
