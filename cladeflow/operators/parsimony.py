"""Parsimony on a tree: unweighted (sets of states) and weighted (a cost matrix).

A pattern's whole column is one row, and the tree's few nodes are unrolled into expressions, so a score is one
projection and one sum: no shuffle but the sum, and no Python. Many candidate trees are scored in one vectorised pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Tree


def _masks(patterns: DataFrame, tree: Tree, taxa: list[str]) -> DataFrame:
    place = {name: k for k, name in enumerate(taxa)}
    return patterns.select("pattern_id", "weight", *(F.get("pattern", place[tree.name[n]]).alias(f"m{n}") for n in tree.tips()))


def fitch(tree: Tree, patterns: DataFrame, taxa: list[str]) -> DataFrame:
    """pattern_id, weight and score: the fewest changes. Levels are projected one by one, which keeps expressions short."""
    rows = _masks(patterns, tree, taxa).withColumn("score", F.lit(0))
    by_height: dict[int, list[tuple]] = {}
    for r in tree.rows():
        by_height.setdefault(r[9], []).append(r)
    for h in sorted(by_height)[1:]:
        both = {r[0]: F.col(f"m{r[2]}").bitwiseAND(F.col(f"m{r[3]}")) for r in by_height[h]}
        either = {r[0]: F.col(f"m{r[2]}").bitwiseOR(F.col(f"m{r[3]}")) for r in by_height[h]}
        rows = rows.withColumns({f"m{n}": F.when(x != 0, x).otherwise(either[n]) for n, x in both.items()} | {"score": F.col("score") + sum((x == 0).cast("int") for x in both.values())})
    return rows.select("pattern_id", "weight", "score")


def sankoff(tree: Tree, patterns: DataFrame, taxa: list[str], costs: list[list[float]]) -> DataFrame:
    """pattern_id, weight and score: the least cost under a 4 x 4 matrix of changes from parent to child."""
    rows = _masks(patterns, tree, taxa)
    state = lambda n, s: F.col(f"c{n}_{s}")
    rows = rows.select("pattern_id", "weight", *(F.when(F.col(f"m{n}").bitwiseAND(F.lit(1 << s)) > 0, 0.0).otherwise(1e9).alias(f"c{n}_{s}") for n in tree.tips() for s in range(4)))

    def least(child: int, up: int) -> Column:
        return F.least(*(state(child, s) + float(costs[up][s]) for s in range(4)))

    by_height: dict[int, list[tuple]] = {}
    for r in tree.rows():
        by_height.setdefault(r[9], []).append(r)
    for h in sorted(by_height)[1:]:
        rows = rows.withColumns({f"c{r[0]}_{s}": least(r[2], s) + least(r[3], s) for r in by_height[h] for s in range(4)})
    return rows.select("pattern_id", "weight", F.least(*(state(tree.root, s) for s in range(4))).alias("score"))


def stepwise_tree(patterns: DataFrame, taxa: list[str], score) -> Tree:
    """Taxa are added one by one where the score is least. Each step scores all edges in one Spark job.

    ``score(trees) -> list of numbers``; with ties the smallest edge wins.
    """
    tree = Tree.parse(f"(({taxa[0]}:0.1,{taxa[1]}:0.1):0.1,{taxa[2]}:0.1);")
    for name in taxa[3:]:
        options = []
        for edge in tree.edges():
            option = tree.copy()
            option.insert(name, edge, option.blen[edge] / 2, 0.1)
            options.append(option)
        scores = score(options)
        tree = options[min(range(len(options)), key=lambda k: (scores[k], k))].renumbered()
    return tree


def fitch_scores(trees: list[Tree], patterns: DataFrame, taxa: list[str]) -> list[int]:
    """The scores of several trees in one pass over the patterns; a row for each tree comes to the driver."""
    place = {name: k for k, name in enumerate(taxa)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(trees), np.int64)
        for batch in batches:
            if batch.num_rows:
                masks = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                weight = batch.column(1).to_numpy()
                for k, tree in enumerate(trees):
                    sets: dict[int, np.ndarray] = {}
                    for node in tree.postorder():
                        if tree.children[node]:
                            a, b = (sets.pop(child) for child in tree.children[node])
                            both = a & b
                            sums[k] += int(weight[both == 0].sum())
                            sets[node] = np.where(both == 0, a | b, both)
                        else:
                            sets[node] = masks[:, place[tree.name[node]]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), pa.array(sums)], names=["k", "score"])

    rows = patterns.select("pattern", F.col("weight").cast("bigint").alias("weight")).mapInArrow(run, "k bigint, score bigint").groupBy("k").agg(F.sum("score").alias("score")).collect()
    return [r["score"] for r in sorted(rows, key=lambda r: r["k"])]
