"""Relations between the nodes of a tree, as recursive queries over its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, ancestor_id (itself included), hops and the length of the path between them."""
    spark: SparkSession = nodes.sparkSession
    nodes.select("node_id", "parent_id", "blen").createOrReplaceTempView("cladeflow_nodes")
    return spark.sql("""
        WITH RECURSIVE up(node_id, ancestor_id, hops, length) AS (
          SELECT node_id, node_id, 0, CAST(0 AS DOUBLE) FROM cladeflow_nodes
          UNION ALL
          SELECT u.node_id, n.parent_id, u.hops + 1, u.length + n.blen FROM up u JOIN cladeflow_nodes n ON u.ancestor_id = n.node_id WHERE n.parent_id IS NOT NULL
        ) SELECT * FROM up
    """)


def tip_distances(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """For pairs of tips: their lowest common ancestor, the hops and the length of the path between them."""
    tips = nodes.filter("is_tip").select("node_id", "name")
    own = closure.join(F.broadcast(tips), "node_id").select("ancestor_id", "name", "hops", "length")
    other = own.select("ancestor_id", *(F.col(c).alias(f"{c}_b") for c in ("name", "hops", "length")))
    pairs = own.join(other, "ancestor_id").filter("name < name_b")
    best = pairs.groupBy(F.col("name").alias("tip_a"), F.col("name_b").alias("tip_b")).agg(F.min(F.struct((F.col("hops") + F.col("hops_b")).alias("hops"), (F.col("length") + F.col("length_b")).alias("length"), F.col("ancestor_id"))).alias("x"))
    return best.select("tip_a", "tip_b", F.col("x.ancestor_id").alias("lca"), F.col("x.hops").alias("hops"), F.col("x.length").alias("length"))


def subtree_sizes(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """node_id, n_tips and the sum of the branch lengths below."""
    below = closure.join(nodes.select("node_id", "is_tip", "blen"), "node_id")
    return below.groupBy(F.col("ancestor_id").alias("node_id")).agg(F.sum(F.col("is_tip").cast("bigint")).alias("n_tips"), F.sum(F.when(F.col("hops") > 0, F.col("blen")).otherwise(0.0)).alias("length"))
