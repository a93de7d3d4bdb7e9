"""Merging records that share an address hash, device or browser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.operators.skew import HOT_ROWS, lookup
from visitlens.session import enable_checkpoints


def stitch_identities(links: DataFrame, hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """Group of each record: ``record, group_id``.

    ``links`` is ``record, kind, value``: the record shows that value of that
    kind of key (address hash, fingerprint, browser id). Records that share a
    value, directly or through others, form one group, named after its lowest
    record.

    A shared key is a node of its own, so a key shared by n records costs n
    links and never n squared pairs; no key is ignored for being common. Groups
    are found with the large-star / small-star rounds of Kiveris et al. (2014),
    which need about log squared rounds even on long chains. A round takes the
    minimum of each node's neighbours (combined before the shuffle) and sends
    it back with a join that salts hot nodes. Lineage is cut by ``checkpoint()``
    after each round, so a lost executor costs at most one round.
    """
    edges = contracted(link_edges(links), hot_rows, max_rounds)
    groups = edges.filter(F.col("u").startswith("0")).select(
        F.expr("substring(u, 2)").alias("record"), F.expr("substring(v, 2)").alias("group_id"))
    every = links.filter(F.col("record").isNotNull()).select(
        F.col("record").cast("string").alias("record")).distinct()
    return (every.join(groups, "record", "left")
            .select("record", F.coalesce("group_id", "record").alias("group_id")))


def link_edges(links: DataFrame) -> DataFrame:
    """``u, v``: a key and a record that shows it. Records start with 0 and keys with 1, so a record is the least."""
    record = F.concat(F.lit("0"), F.col("record").cast("string"))
    key = F.concat(F.lit("1"), F.col("kind"), F.lit("\u0001"), F.col("value"))
    known = links.filter(F.col("record").isNotNull() & F.col("kind").isNotNull()
                         & F.col("value").isNotNull())
    return known.select(key.alias("u"), record.alias("v")).distinct()


def contracted(edges: DataFrame, hot_rows: int = HOT_ROWS, max_rounds: int = 60) -> DataFrame:
    """``u, v``: every node but the least of its group, and that least node. Edges come with ``u > v``."""
    enable_checkpoints(edges.sparkSession)
    edges = edges.checkpoint()
    mark = _mark(edges)
    for _ in range(max_rounds):
        edges = _small_star(_large_star(edges, hot_rows), hot_rows).checkpoint()
        before, mark = mark, _mark(edges)
        if before == mark:
            return edges
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash sum; equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Link every greater neighbour of a node to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = lookup(both.filter(F.col("v") > F.col("u")), least, "u", "v", how="inner",
                hot_rows=hot_rows)
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Link a node and its lesser neighbours to the least of them.

    Edges come with ``u > v``.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = lookup(edges, least, "u", "v", how="inner", hot_rows=hot_rows)
    moved = down.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
