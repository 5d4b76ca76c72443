"""Connected components of a link table, by union-find inside tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.workspace import checkpointed


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as a forest of stars: each node with the least node it is joined to, found by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) of every node of ``links`` (a bigint, b bigint); root is the least node of the component.

    Tasks first reduce their own links to a forest by union-find; its size is bounded by the task's nodes. Then each
    round joins every node to the least of its neighbours (large star) and links those to each other (small star);
    the number of rounds is logarithmic in the longest chain. Rounds are checkpointed. Loops (a = a) and repeated
    links have no effect; null ends are left out; no links give an empty result. A group of any size is never
    gathered in one task: both stars are aggregations and joins on the node.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(_forest, "a bigint, b bigint").distinct()
    edges = checkpointed(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b")))).alias("e"))
        fresh = checkpointed(small.select("e.a", "e.b").where("a <> b").distinct())
        changed = fresh.exceptAll(edges).limit(1).count() or edges.exceptAll(fresh).limit(1).count()
        edges = fresh
        if not changed:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(roots.select("root", "root").distinct())
