"""Nearest-neighbour interchange with rollback, and classes of equal subtrees' columns (site repeats)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tree import Tree


def interchanges(tree: Tree) -> list[tuple[int, int]]:
    """(child of an inner edge's node, that node's sibling) for every interchange: two for each inner edge."""
    return [(child, tree.sibling(node)) for node in tree.edges() if tree.children[node] for child in tree.children[node]]


def interchange(tree: Tree, child: int, other: int) -> None:
    """Swap two subtrees in place; the same call again takes it back."""
    a, b = tree.parent[child], tree.parent[other]
    i, j = tree.children[a].index(child), tree.children[b].index(other)
    tree.children[a][i], tree.children[b][j] = other, child
    tree.parent[child], tree.parent[other] = b, a


def best_interchange(tree: Tree, score) -> tuple[Tree, float] | None:
    """The best tree that one interchange reaches, by ``score(trees) -> numbers`` (higher is better), in one job."""
    options = []
    for pair in interchanges(tree):
        options.append(tree.copy())
        interchange(options[-1], *pair)
    scores = score(options) if options else []
    best = max(range(len(options)), key=lambda k: (scores[k], -k), default=None)
    return None if best is None else (options[best], scores[best])


def site_repeats(tree: Tree, patterns: DataFrame, taxa: list[str]) -> DataFrame:
    """node_id, pattern_id and class: patterns of one class look the same below a node, so its vector is needed once.

    Inner classes are numbered by their children's classes, level by level, in one wide row a pattern.
    """
    place = {name: k for k, name in enumerate(taxa)}
    rows = patterns.select("pattern_id", *(F.get("pattern", place[tree.name[n]]).cast("bigint").alias(f"c{n}") for n in tree.tips()))
    for r in sorted(tree.rows(), key=lambda r: r[9]):
        if not r[4]:
            rows = rows.withColumn(f"c{r[0]}", F.xxhash64(f"c{r[2]}", f"c{r[3]}"))
    inner = [r[0] for r in tree.rows() if not r[4]]
    long = rows.select("pattern_id", F.explode(F.array(*(F.struct(F.lit(n).alias("node_id"), F.col(f"c{n}").alias("code")) for n in inner))).alias("x")).select("pattern_id", "x.*")
    return long.withColumn("class", F.min("pattern_id").over(Window.partitionBy("node_id", "code"))).select("node_id", "pattern_id", "class")
