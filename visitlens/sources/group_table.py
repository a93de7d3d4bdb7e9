"""Groups of records that are kept while links come in; see :mod:`visitlens.operators.stitching`.

A node (record or key) is written once, with the name its group had then. When new links put
groups together, only the names change: a second, far smaller table says what a name
is called now. New links are first expressed in names, so each batch contracts a graph of its own
size, and no member of a group is written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.operators.skew import HOT_ROWS, lookup
from visitlens.operators.stitching import contracted, link_edges
from visitlens.session import new_folder
from visitlens.sources.keyed_log import KeyedLog

NODES = T.StructType([T.StructField("node", T.StringType()), T.StructField("name", T.StringType()),
                      T.StructField("batch", T.LongType())])
NAMES = T.StructType([T.StructField("name", T.StringType()), T.StructField("now", T.StringType()),
                      T.StructField("batch", T.LongType())])


class GroupTable:
    """Groups under ``root``; batches of links are numbered upwards."""

    def __init__(self, spark: SparkSession, root: str, hot_rows: int = HOT_ROWS, **settings):
        self.spark, self.hot_rows = spark, hot_rows
        self.nodes = KeyedLog(spark, f"{root}/nodes", ["node"], lambda r: r.groupBy("node").agg(
            F.min(F.struct("batch", "name")).alias("_f")).select("node", "_f.name", "_f.batch"), **settings)
        self.names = KeyedLog(spark, f"{root}/names", ["name"], lambda r: r.groupBy("name").agg(
            F.max(F.struct("batch", "now")).alias("_l")).select("name", "_l.now", "_l.batch"), **settings)

    def _staged(self, df: DataFrame, label: str) -> DataFrame:
        path = new_folder(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def add(self, links: DataFrame, number: int) -> bool:
        """Take in ``record, kind, value``; False if that batch was taken in before.

        A record without any key is a group of its own. When a try was lost between its two writes, the next
        one finds the nodes written and does the rest.
        """
        if self.names.holds(number):
            return False
        # The batch is read once; from here on there is one row per link.
        links = self._staged(links.filter(F.col("record").isNotNull()).select("record", "kind", "value").distinct(),
                             "new-links")
        alone = links.select(F.concat(F.lit("0"), F.col("record").cast("string")).alias("node"))
        edges = self._staged(link_edges(links), "new-edges")
        every = self._staged(alone.union(edges.select("u")).union(edges.select("v")).distinct(), "new-nodes")
        names = self.names.read(NAMES).select("name", "now")
        known = self._staged(
            lookup(self.nodes.read_for(every, NODES).select("node", "name"), names, "name", "node", hot_rows=self.hot_rows)
            .select("node", F.coalesce("now", "name").alias("name")), "known-nodes")
        for side in ("u", "v"):
            named = known.select(F.col("node").alias(side), F.col("name").alias("_name"))
            edges = (lookup(edges, named, side, "v" if side == "u" else "u", hot_rows=self.hot_rows)
                     .withColumn(side, F.coalesce("_name", side)).drop("_name"))
        edges = (edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        groups = contracted(edges, self.hot_rows)
        batch = F.lit(number).cast("long").alias("batch")
        new = every.join(known, "node", "left_anti")
        least = groups.select(F.col("u").alias("node"), F.col("v").alias("name"))
        self.nodes.add(new.join(least, "node", "left").select("node", F.coalesce("name", "node").alias("name"), batch), number)
        # Names of this batch's groups that another name is less than; then older names that led to these.
        renamed = self._staged(known.select("name").distinct().join(
            groups.select(F.col("u").alias("name"), F.col("v").alias("now")), "name"), "new-names")
        led = names.join(renamed.select(F.col("name").alias("now"), F.col("now").alias("then")), "now").select(
            "name", F.col("then").alias("now"))
        self.names.add(renamed.unionByName(led).select("name", "now", batch), number)
        return True

    def read(self) -> DataFrame:
        """``record, group_id``: as one run over all links gives it."""
        records = self.nodes.read(NODES).filter(F.col("node").startswith("0")).select("node", "name")
        named = lookup(records, self.names.read(NAMES).select("name", "now"), "name", "node", hot_rows=self.hot_rows)
        return named.select(F.expr("substring(node, 2)").alias("record"),
                            F.substr(F.coalesce("now", "name"), F.lit(2)).alias("group_id"))
