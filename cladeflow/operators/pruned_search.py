"""Search of a query's branch from the root downwards, that leaves branches which get worse.

The frontier is a table of (query, edge) with the score above and the number of drops in a row that led there. A step
scores the frontier's edges, all queries at once; a state whose score dropped ``drops`` times in a row and lies
``threshold`` below its query's best so far ends there, all others go on to the edges below. A query whose frontier is
smaller than ``small`` edges is scored on all edges instead. With an infinite threshold every edge is scored.

Scale: the number of steps is the tree's depth. A step is one pass over blocks of patterns and counts (as the baseline
scores are) for the edges that are on any query's frontier; what is sent are sums for (query, edge). Frontiers are
written, so a lost executor costs a step at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import written
from ..plans.tree import Tree


#: Smaller differences are no drops: over a branch without length nothing changes but the last digits.
EQUAL = 1e-5


@dataclass(frozen=True)
class PruneOptions:
    """threshold: log-likelihood below the best. drops: in a row, 1 at least. small: frontiers below this end the search (0: none)."""

    threshold: float = 2.0
    drops: int = 2
    small: int = 0


def searched(tree: Tree, score: Callable[[list[int]], DataFrame], queries: DataFrame, options: PruneOptions = PruneOptions()) -> DataFrame:
    """query, edge and loglik of all edges that were scored.

    score: edges to (query, edge, loglik) of all queries on them; queries: a column ``query``.
    """
    spark = queries.sparkSession
    edges = spark.createDataFrame([(n, tree.parent[n]) for n in tree.edges()], "edge int, above int")  # a row for each edge
    own = queries.select("query").distinct()
    first = F.broadcast(edges.filter(F.col("above") == tree.root).select("edge"))
    frontier = own.crossJoin(first).select("query", "edge", F.lit(float("-inf")).alias("above_loglik"), F.lit(0).alias("streak"))  # two edges each
    found, small = None, own.limit(0)
    while True:
        frontier = written(frontier, "frontier")
        if options.small:
            few = frontier.groupBy("query").count().filter(F.col("count") < options.small).select("query")
            small = written(small.unionByName(few).distinct(), "small")
            frontier = frontier.join(small, "query", "left_anti")
        wanted = sorted(r["edge"] for r in frontier.select("edge").distinct().collect())  # edges of the tree
        if not wanted:
            break
        scored = frontier.join(score(wanted), ["query", "edge"])
        both = scored.select("query", "edge", "loglik", "above_loglik", "streak")
        found = written(both if found is None else found.unionByName(both), "searched")
        here = found.join(frontier.select("query", "edge"), ["query", "edge"], "left_semi")
        best = found.groupBy("query").agg(F.max("loglik").alias("best"))
        streak = F.when(F.col("loglik") < F.col("above_loglik") - EQUAL, F.col("streak") + 1).otherwise(0)
        going = here.join(best, "query").withColumn("streak", streak).filter(~((F.col("streak") >= max(1, options.drops)) & (F.col("loglik") < F.col("best") - options.threshold)))
        below = F.broadcast(edges.withColumnRenamed("edge", "next"))
        frontier = going.join(below, going["edge"] == below["above"]).select("query", F.col("next").alias("edge"), F.col("loglik").alias("above_loglik"), "streak")
    rows = score(sorted(tree.edges())).join(small, "query", "left_semi") if options.small else None
    if found is None:
        return rows if rows is not None else score([])
    kept = found.select("query", "edge", "loglik")
    return kept if rows is None else kept.join(small, "query", "left_anti").unionByName(rows)
