"""Connected components of a link table by label spreading with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.session import enable_checkpoints


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``); root: least node reachable.

    Star contraction: a round links each node's greater neighbours to the least
    neighbour (large star), then its lesser ones (small star), until no edge
    changes; about log squared rounds, on chains as well. Minima combine before the
    shuffle, and a node with very many neighbours is split by the adaptive skew
    join. Each round is cut by ``checkpoint()``. No links: no rows.
    """
    enable_checkpoints(links.sparkSession)
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter("u <> v").distinct().checkpoint())
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = (small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint())
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes; equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
