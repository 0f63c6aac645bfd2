"""Connected components of links between 64-bit nodes, by alternating large and small stars.

Each round points every node's larger neighbours, then its smaller ones, at its smallest neighbour. The number of links
never grows and the rounds needed are logarithmic. Minima are aggregated on the map side before a shuffle, and a node with
very many links is joined apart, so it is no hot group. The lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import checkpointed, spread_join


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node in the links ``a``, ``b``."""
    now = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))  # two narrow reads of one checkpoint
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = checkpointed(large)
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(below.select("u", F.col("m").alias("v"))).distinct()
        now, before = checkpointed(small), state
        state = _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
