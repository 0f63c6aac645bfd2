"""A Merkle manifest of a dataset that stores every third level only, and proofs that regenerate the rest.

Rows are leaves of one tree a group (language), in the order of their ids; the groups' roots are leaves of a tree above.
``WIDTH`` consecutive nodes become their digest, until one is left. ``manifest`` writes the leaves and every
``KEPT``-th level above them to the shared folder, and drops the levels between. ``proofs`` goes down from the top: a
stored node's aligned subtree of ``WIDTH ** KEPT`` stored descendants is folded again, each descendant gets the siblings
on its way through it and those of its subtree's node above, and the regenerated nodes are discarded.

Scale: texts are read once, for the leaves; all later rows are digests. Places come from ranges over (group, id) and a
sum over the ranges, so a group with a third of all rows is dealt out like the rest. Work is grouped by aligned subtree,
512 nodes at most. The driver loops over stored levels (four for 10^11 rows) and knows only how many there are.

Null groups are a group of their own, in front; null ids come first in a group, and equal ids stand in the order of
their leaves. Repeated rows are leaves of their own. Null fields have their own code in a leaf. An empty table has no
rows, no groups and no root. Extra columns are not read, unless they are named as fields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spark_util import small_batches, stored

#: Nodes that become one, and levels from one stored level to the next.
WIDTH, KEPT = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a proof: the node's place in its run, and the digests of the others.
STEPS = "array<struct<place: int, others: array<string>>>"
#: Subtrees of an Arrow batch.
SUBTREES = 8
#: Rows of small tables (a row for each range and group) that are broadcast.
MOST_STARTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    """levels: stored tables (tree, place, size, digest), from the leaves up, with what the leaves carry; roots: (tree,
    digest) of the groups; above: the manifest of the groups' roots, None for the topmost tree."""

    levels: list[DataFrame]
    roots: DataFrame
    above: Manifest | None = None


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields: ``-`` for null, else the value's length in bytes, ``:`` and the value."""
    coded = []
    for c in columns.values():
        value = c.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*coded), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds place (from 0) and size, by ``tree``: ranges over (tree, order), places within them, and a sum of those before."""
    ranged = stored(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "ranges")
    within = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order)) - 1
    counts = ranged.groupBy("tree", "part").count()  # a row for each range, and one more for each tree that begins in it
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("count").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("tree").alias("of_tree"), F.col("part").alias("of_part"), before.alias("start"), F.sum("count").over(of_tree).alias("size"))
    starts = stored(starts, "starts")
    if starts.count() <= MOST_STARTS:
        starts = F.broadcast(starts)
    both = ranged.withColumn("within", within).join(starts, (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree")))
    return both.withColumn("place", F.col("start") + F.col("within")).drop("part", "within", "of_tree", "of_part", "start")


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def folded(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of a subtree, from its stored nodes up."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][k : k + WIDTH]) for k in range(0, len(out[-1]), WIDTH)])
    return out


def levels_left(size: int) -> int:
    """Levels above a row of ``size`` nodes, until one is left."""
    n = 0
    while size > 1:
        size, n = -(-size // WIDTH), n + 1
    return n


def subtrees(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """tree, above (the place of the stored node above), size and nodes: aligned subtrees of stored nodes, each in order."""
    above = F.expr(f"place div {WIDTH**KEPT}")
    entry = F.struct("place", "digest", *carry)
    return nodes.groupBy("tree", above.alias("above"), "size").agg(F.array_sort(F.collect_list(entry)).alias("nodes"))  # bounded: WIDTH ** KEPT


def next_level(nodes: DataFrame) -> DataFrame:
    """tree, place, size and digest of the next stored level; a tree with fewer levels ends in its root. size: nodes of a tree in this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for size, digests in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                (top,) = folded(digests, min(KEPT, levels_left(size)))[-1]
                found.append(top)
                sizes.append(-(-size // WIDTH**KEPT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.string())], names=["tree", "place", "size", "digest"])

    rows = subtrees(nodes.select("tree", "place", "size", "digest"), []).select("tree", "above", "size", F.col("nodes.digest").alias("digests"))
    return rows.mapInArrow(run, f"tree {nodes.schema['tree'].dataType.simpleString()}, place bigint, size bigint, digest string")


def build(leaves: DataFrame) -> Manifest:
    """The stored levels of trees. leaves: tree, place, size, digest and what is carried along."""
    levels = [stored(leaves, "merkle")]
    while levels[-1].filter("size > 1").limit(1).count():
        levels.append(stored(next_level(levels[-1].filter("size > 1")), "merkle"))
    roots = levels[0].filter("size = 1").select("tree", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("size = 1").select("tree", "digest"))
    return Manifest(levels, stored(roots, "roots"))


def manifest(rows: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table, stored in the shared folder: leaves carry ``key`` and the columns ``also``."""
    carried = also or {}
    leaves = rows.select(F.col(f"`{group}`").alias("tree"), F.col(f"`{key}`").alias("id"), leaf_digest({f: F.col(f"`{f}`") for f in fields}).alias("digest"), *(c.alias(n) for n, c in carried.items()))
    leaves = stored(leaves, "leaves").withColumn("tie", F.monotonically_increasing_id())  # equal rows are dealt out by it; their leaves are equal
    own = build(numbered(leaves, ["id", "digest", "tie"]).drop("tie"))
    tops = own.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("id"), "digest")
    return Manifest(own.levels, own.roots, build(numbered(tops, ["id"])))


def regenerated(nodes: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """Stored nodes that aren't roots, with the steps of their way through their subtree and of its node above.

    nodes: tree, place, size, digest, ``carry``; above: tree, place, steps and tops of the stored nodes one level up.
    """
    fields = [nodes.schema["tree"], nodes.schema["place"], *(nodes.schema[c] for c in carry), nodes.schema["digest"]]
    schema = StructType([*fields, above.schema["steps"], above.schema["tops"]])
    step = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a subtree each
                row = batch.slice(k, 1)
                entries, upper, tops = row.column(2).flatten(), row.column(3)[0].as_py(), row.column(4)[0].as_py()
                digests, steps = entries.field("digest").to_pylist(), []
                levels = folded(digests, min(KEPT, levels_left(row.column(1)[0].as_py())))[:-1]
                for at in range(len(digests)):
                    own, here = [], at
                    for level in levels:
                        place = here % WIDTH
                        members = level[here - place : here - place + WIDTH]
                        own.append({"place": place, "others": members[:place] + members[place + 1 :]})
                        here //= WIDTH
                    steps.append(own + upper)
                tree = row.column(0).take(pa.array([0] * len(digests)))
                yield pa.RecordBatch.from_arrays([tree, *(entries.field(f.name) for f in fields[1:]), pa.array(steps, step), pa.array([tops] * len(digests), pa.list_(pa.string()))], names=schema.names)

    small_batches(nodes.sparkSession, SUBTREES)
    rows = subtrees(nodes, carry)
    up = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), "steps", "tops")
    joined = rows.join(up, rows["tree"].eqNullSafe(up["up_tree"]) & (rows["above"] == up["up_place"]))
    return joined.select("tree", "size", "nodes", "steps", "tops").mapInArrow(run, schema)


def proofs(found: Manifest, carry: list[str]) -> DataFrame:
    """tree, place, ``carry``, digest, steps and tops of all leaves: folding a leaf with its steps gives the last of its tops.

    ``steps`` go from the leaf to the root of all: the node's place in its run, and the digests of the others from left
    to right. ``tops`` are the roots of the trees on the way: the group's, and the one of all.
    """
    if found.above is None:
        start = found.roots.select(F.col("tree").alias("of_tree"), F.array().cast(STEPS).alias("steps"), F.array().cast("array<string>").alias("tops"))
    else:
        start = stored(proofs(found.above, ["id"]).select(F.col("id").alias("of_tree"), "steps", "tops"), "proofs")
    up = None
    for k in range(len(found.levels) - 1, -1, -1):
        level, own = found.levels[k], carry if k == 0 else []
        roots = level.filter("size = 1").join(start, F.col("tree").eqNullSafe(F.col("of_tree")))
        here = roots.select("tree", "place", *own, "digest", "steps", F.concat(F.array("digest"), "tops").alias("tops"))
        if up is not None:
            here = here.unionByName(regenerated(level.filter("size > 1"), up, own))
        up = here if k == 0 else stored(here.select("tree", "place", "steps", "tops"), "proofs")
    return up


def refolded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a proof's steps lead to."""
    others = lambda s, a, n: F.array_join(F.slice(s["others"], a, n), "")
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(others(s, F.lit(1), s["place"]), acc, others(s, s["place"] + 1, F.lit(WIDTH))), 256))


def tampered_leaf(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row with A-Z in its text lower-cased, where 3 divides the CRC-32 of its decimal id; else null."""
    changed = {f: F.translate("text", UPPER, LOWER) if f == "text" else F.col(f"`{f}`") for f in fields}
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_digest(changed))


def verified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256 (of the siblings), folded_root (of the tampered leaf, where
    there is one, and the untampered siblings) and verified: whether it equals root."""
    found = proofs(manifest(docs, also={"tampered": tampered_leaf(docs)}), ["id", "tampered"])
    siblings = F.array_join(F.flatten(F.transform("steps", lambda s: s["others"])), "")
    out = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), F.get("tops", 0).alias("subroot"), F.get("tops", 1).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), refolded(F.coalesce("tampered", "digest"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
