"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014), as grouped minima and joins.

Every step is one grouped minimum (partial aggregation, so a node with any
number of neighbours is summed map-side) and one equi-join on the node (AQE
splits a hot node).  Nothing is collected but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rounds after which the loop raises instead of returning a wrong result;
#: the alternating algorithm needs O(log^2 n).
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over undirected edges (u, v), u > v.

    large: every neighbour above u is linked to the least of u and its
    neighbours.  small: u and its neighbours below are linked to the least."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("w"))
        moved = (edges.select(F.col("v").alias("k"), F.col("u").alias("x"))
                 .join(least, "k").select(F.col("x").alias("u"), F.col("w").alias("v")))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("w")).withColumnRenamed("u", "k")
        rest = edges.withColumnRenamed("u", "k").join(least, "k").select(F.col("v").alias("u"), F.col("w").alias("v"))
        moved = rest.union(least.select(F.col("k").alias("u"), F.col("w").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that is not its own root;
    root is the least node reachable.  Self links and repeated links are
    allowed, null ends are ignored, no links give no rows."""
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        edges = materialise(_star(_star(edges, True), False), "cc")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

