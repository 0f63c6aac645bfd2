"""jplace version 3: the tree with edge numbers, and a record for each query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import Tree

FIELDS = ["edge_num", "likelihood", "like_weight_ratio", "distal_length", "pendant_length"]
FLAT = 1e-15


def exported(tree: Tree) -> tuple[str, dict[int, int]]:
    """The tree's text and its edge numbers, in post-order. One inner child of the root without length is left out."""
    flat = [n for n in tree.children[tree.root] if tree.children[n] and tree.blen[n] <= FLAT]
    out = tree.copy()
    if len(flat) == 1:
        at = out.children[out.root].index(flat[0])
        out.children[out.root][at : at + 1] = out.children[flat[0]]
        for child in out.children[flat[0]]:
            out.parent[child] = out.root
    numbers = {n: k for k, n in enumerate(x for x in out.postorder() if x != out.root)}
    return out.newick(numbers), numbers


def records(placements: DataFrame, tree: Tree) -> DataFrame:
    """query and json: placements on edges that the text has, best first."""
    _, numbers = exported(tree)
    edges = placements.sparkSession.createDataFrame(list(numbers.items()), "edge int, edge_num int")
    row = F.concat(F.lit("["), F.concat_ws(",", *(F.col(c).cast("string") for c in ("edge_num", "loglik", "lwr", "distal", "pendant"))), F.lit("]"))
    rows = placements.join(F.broadcast(edges), "edge").groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))), lambda x: x["row"]), ",").alias("p"))
    name = F.to_json(F.array(F.coalesce(F.col("query").cast("string"), F.lit(""))))
    return rows.select("query", F.concat(F.lit('{"p":['), "p", F.lit('],"n":'), name, F.lit("}")).alias("json"))


def write_jplace(placements: DataFrame, tree: Tree, path: str, invocation: str = "") -> None:
    """One text file, written as a stream of lines: no record is held longer than its line."""
    spark, (text, _) = placements.sparkSession, exported(tree)
    head = json.dumps({"version": 3, "tree": text, "fields": FIELDS, "metadata": {"invocation": invocation}})[:-1] + ', "placements": ['
    lines = records(placements, tree).select(F.lit(1).alias("part"), F.col("query").cast("string").alias("q"), F.col("json").alias("line"))
    ends = spark.createDataFrame([(0, "", head), (2, "", "]}")], "part int, q string, line string")
    ordered = lines.unionByName(ends).repartition(1).sortWithinPartitions("part", "q").withColumn("at", F.monotonically_increasing_id())  # one file: line numbers
    ordered.select(F.concat(F.when((F.col("part") == 1) & (F.col("at") > 1), ",").otherwise(""), "line").alias("line")).write.text(path)


def read_jplace(text: str) -> dict:
    return json.loads(text)
