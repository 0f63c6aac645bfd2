"""Likelihoods on a tree: two forms of the same recursion.

The relational form joins conditional likelihoods with transition probabilities, level by level. It is transparent and
is checked against SQL. The blocked form is for scale: site patterns are dealt out in blocks, each task replays the
tree's operations on its block with vectorised arithmetic, and only sums leave it. The tree and its matrices are a few
numbers for each node and go with the task; nothing that grows with sites is broadcast or collected.

Both carry a logarithmic scale instead of raw products, so that deep trees don't underflow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..functions.alphabet import ALL
from ..functions.model import Model
from ..plans.shared import written
from ..plans.tree import Tree

LEAST = 1e-300
#: Vectors (a pattern and a node) that a task makes at once, where trees grow: 128 bytes each with four categories, up and down.
HELD = 1 << 21
#: Levels of a tree after which the relational form writes its table, so that plans stay short.
LEVELS = 12


class Names(list):
    """Names of which those with equal sequences share a column of the patterns; ``column`` has each name's."""

    def __init__(self, column: dict[str, int]) -> None:
        super().__init__(column)
        self.column = column

    def index(self, name: str) -> int:
        return self.column[name]


def places(taxa: list[str]) -> dict[str, int]:
    """Each name's column of the patterns."""
    return taxa.column if isinstance(taxa, Names) else {name: k for k, name in enumerate(taxa)}


def at_once(tree: Tree, most: int) -> int:
    """Patterns that a task takes at once: fewer for a large tree, so that its memory doesn't grow with the tree."""
    return max(1, min(most, HELD // max(1, len(tree.parent))))


def eigen_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """(i, k, j, value, product of both eigenvectors) and (cat, rate, weight)."""
    values, v, inverse = model.eigen()
    basis = [(i, j, k, float(values[k]), float(v[i, k] * inverse[k, j])) for i in range(4) for j in range(4) for k in range(4)]
    cats = [(c, r, w) for c, (r, w) in enumerate(zip(model.site_rates, model.weights, strict=True))]
    return spark.createDataFrame(basis, "i int, j int, k int, lambda double, vv double"), spark.createDataFrame(cats, "cat int, rate double, weight double")


def transition_table(nodes: DataFrame, model: Model) -> DataFrame:
    """node_id, cat, i, j, p for every node below the root."""
    basis, cats = eigen_tables(nodes.sparkSession, model)
    each = nodes.filter("parent_id is not null").select("node_id", "blen").join(F.broadcast(cats)).join(F.broadcast(basis))
    p = F.sum(F.col("vv") * F.expm1(F.col("lambda") * F.col("rate") * F.col("blen"))) + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    return each.groupBy("node_id", "cat", "i", "j").agg(p.alias("p"))


def up_vectors(tree: Tree, cells: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """The root's conditional likelihoods: ``keys``, vec (category by state) and scale. cells: taxon, ``keys``, mask.

    One pass a level: the children of the level's nodes are moved up their branches and multiplied, all others stay.
    The table is partitioned by ``keys`` once, and every level groups by them too, so no level shuffles.
    """
    spark, width = cells.sparkSession, 4 * model.ncat
    tips = spark.createDataFrame([(n, tree.name[n]) for n in tree.tips()], "node_id int, taxon string")
    slots = F.sequence(F.lit(0), F.lit(width - 1))
    bits = F.transform(slots, lambda k: F.col("mask").bitwiseAND(F.pow(F.lit(2), k % 4).cast("int")).cast("boolean").cast("double"))
    table = cells.join(F.broadcast(tips), "taxon").select("node_id", *keys, bits.alias("vec"), F.lit(0.0).alias("scale")).repartition(*keys)
    by_height: dict[int, list[tuple]] = {}
    for r in tree.rows():
        by_height.setdefault(r[9], []).append(r)
    up = {child: (r[0], h) for h, rows in by_height.items() if h for r in rows for child in (r[2], r[3])}
    matrices = model.transition(np.array([tree.blen[n] for n in up])).reshape(len(up), -1)
    columns = [pa.array(list(up), pa.int32()), pa.array([n for n, _ in up.values()], pa.int32()), pa.array([h for _, h in up.values()], pa.int32()), pa.array(list(matrices), pa.list_(pa.float64()))]
    steps = spark.createDataFrame(pa.table(columns, names=["node_id", "parent", "level", "p"]))  # a row for each node
    for h in sorted(by_height)[1:]:
        step = steps.filter(F.col("level") == h).drop("level")
        sent = F.transform(slots, lambda k: sum(F.get("p", k * 4 + j) * F.get("vec", k - k % 4 + j) for j in range(4)))
        moved = table.join(F.broadcast(step), "node_id", "left").select(F.coalesce("parent", "node_id").alias("node_id"), *keys, F.when(F.col("p").isNull(), F.col("vec")).otherwise(sent).alias("vec"), "scale")
        grouped = moved.groupBy("node_id", *keys).agg(F.collect_list("vec").alias("vecs"), F.sum("scale").alias("scale"))  # two vectors at most
        value = F.when(F.size("vecs") == 2, F.zip_with(F.get("vecs", 0), F.get("vecs", 1), lambda a, b: a * b)).otherwise(F.get("vecs", 0))
        most = F.greatest(F.array_max("vec"), F.lit(LEAST))
        table = grouped.select("node_id", *keys, value.alias("vec"), "scale").select("node_id", *keys, F.transform("vec", lambda x: x / most).alias("vec"), (F.col("scale") + F.log(most)).alias("scale"))
        if h % LEVELS == 0:
            table = written(table, "vectors").repartition(*keys)
    return table


def pattern_likelihoods(tree: Tree, cells: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` and ln_lk, by the relational form. cells: taxon, ``keys``, mask."""
    root = up_vectors(tree, cells, model, keys)
    weights = [w * pi for w in model.weights for pi in model.freqs]
    lk = F.aggregate(F.zip_with("vec", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return root.select(*keys, (F.log(F.greatest(lk, F.lit(LEAST))) + F.col("scale")).alias("ln_lk"))


def tree_loglik(tree: Tree, patterns: DataFrame, model: Model, taxa: list[str]) -> DataFrame:
    """One row: loglik and n_sites. patterns: pattern_id, weight and the masks of ``taxa``, in that order."""
    order = F.array(*map(F.lit, taxa))
    cells = patterns.select("pattern_id", F.posexplode("pattern").alias("at", "mask")).select("pattern_id", F.get(order, F.col("at")).alias("taxon"), "mask")
    lk = pattern_likelihoods(tree, cells, model, ["pattern_id"])
    return patterns.select("pattern_id", "weight").join(lk, "pattern_id").agg(F.sum(F.col("weight") * F.col("ln_lk")).alias("loglik"), F.sum("weight").alias("n_sites"))


class Block:
    """The tree's vectors for a block of patterns: arrays [node][pattern, category, state] with logarithmic scales."""

    def __init__(self, tree: Tree, model: Model, taxa: dict[str, int], masks: np.ndarray, down: bool = False, transposed: bool = False) -> None:
        """masks: [pattern, taxon]. ``transposed``: the downward pass applies the transpose, as some programs do."""
        self.tree, self.model = tree, model
        count, ncat = len(masks), model.ncat
        bits = (masks[:, :, None] >> np.arange(4) & 1).astype(float)
        self.p = dict(zip(tree.edges(), model.transition(np.array([tree.blen[n] for n in tree.edges()])), strict=True)) if tree.edges() else {}
        self.up: dict[int, np.ndarray] = {}
        self.scale: dict[int, np.ndarray] = {}
        self.sent: dict[int, np.ndarray] = {}
        for node in tree.postorder():
            if tree.children[node]:
                a, b = tree.children[node]
                value, scale = self.sent[a] * self.sent[b], self.scale[a] + self.scale[b]
                value, scale = self._scaled(value, scale)
            else:
                value, scale = np.repeat(bits[:, None, taxa[tree.name[node]]], ncat, axis=1), np.zeros(count)
            self.up[node], self.scale[node] = value, scale
            if node != tree.root:
                self.sent[node] = self._moved(self.p[node], value)
        if down:
            self.base: dict[int, np.ndarray] = {}
            self.base_scale: dict[int, np.ndarray] = {}
            above = {tree.root: (np.ones((count, ncat, 4)), np.zeros(count))}
            for node in tree.preorder():
                if node == tree.root:
                    continue
                other, (outer, scale) = tree.sibling(node), above[tree.parent[node]]
                self.base[node], self.base_scale[node] = self._scaled(outer * self.sent[other], scale + self.scale[other])
                above[node] = self._moved(self.p[node].swapaxes(1, 2) if transposed else self.p[node], self.base[node]), self.base_scale[node]

    @staticmethod
    def _moved(p: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Each category's matrix applied to each pattern's vector."""
        return (value.swapaxes(0, 1) @ p.swapaxes(1, 2)).swapaxes(0, 1)

    @staticmethod
    def _scaled(value: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = reduce(np.maximum, reduce(np.maximum, np.moveaxis(value, 2, 0)).T)  # along patterns: an axis of four is slow to reduce
        most = np.where(most > 0, most, 1.0)
        return value / most[:, None, None], scale + np.log(most)

    def loglik(self) -> np.ndarray:
        root = self.tree.root
        lk = np.einsum("c,i,sci->s", self.model.weights, self.model.freqs, self.up[root])
        return np.log(np.maximum(lk, LEAST)) + self.scale[root]

    def insertion(self, edge: int, distal: float, pendant: float) -> np.ndarray:
        """ln of the likelihood with a new tip on an edge, for each pattern and each state of the tip, and for each sum of states: [pattern, mask]."""
        lower, upper, tip = self.model.transition(np.array([distal, self.tree.blen[edge] - distal, pendant]))
        inner = self._moved(lower, self.up[edge]) * self._moved(upper, self.base[edge])
        state = np.einsum("c,i,cix,sci->sx", self.model.weights, self.model.freqs, tip, inner)
        chosen = (np.arange(16)[:, None] >> np.arange(4) & 1).astype(float)
        return np.log(np.maximum(state @ chosen.T, LEAST)) + (self.scale[edge] + self.base_scale[edge])[:, None]


def blocked_loglik(tree: Tree, patterns: DataFrame, model: Model, taxa: list[str], keys: list[str] | None = None) -> DataFrame:
    """loglik and n_sites for each of ``keys`` (or of all), by the blocked form. One pass, partial sums, no join."""
    own, place = keys or [], {name: k for k, name in enumerate(taxa)}
    schema = patterns.select(*own).schema.add("loglik", DoubleType()).add("n_sites", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                masks = batch.column(len(own)).flatten().to_numpy().reshape(batch.num_rows, -1)
                weight = batch.column(len(own) + 1).to_numpy()
                each = Block(tree, model, place, masks).loglik() * weight
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(each), pa.array(weight)], names=schema.names)

    rows = patterns.select(*own, "pattern", F.col("weight").cast("bigint")).mapInArrow(run, schema)
    return rows.groupBy(*own).agg(F.sum("loglik").alias("loglik"), F.sum("n_sites").alias("n_sites"))


def edge_logliks(tree: Tree, patterns: DataFrame, model: Model, taxa: list[str], transposed: bool = False) -> DataFrame:
    """edge and the tree's loglik as it is seen from that edge: a tip without data at any place changes nothing."""
    place = {name: k for k, name in enumerate(taxa)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                masks = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                block = Block(tree, model, place, masks, down=True, transposed=transposed)
                sums = [float(block.insertion(e, tree.blen[e] / 2, 0.1)[:, 15] @ batch.column(1).to_numpy()) for e in tree.edges()]
                yield pa.RecordBatch.from_arrays([pa.array(tree.edges(), pa.int32()), pa.array(sums)], names=["edge", "loglik"])

    return patterns.select("pattern", F.col("weight").cast("double")).mapInArrow(run, "edge int, loglik double").groupBy("edge").agg(F.sum("loglik").alias("loglik"))


def ancestral_states(tree: Tree, patterns: DataFrame, model: Model, taxa: list[str]) -> DataFrame:
    """pattern_id, node_id, state and its marginal probability, for the inner nodes."""
    place, inner = {name: k for k, name in enumerate(taxa)}, [n for n in tree.preorder() if tree.children[n]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                masks = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                block, n = Block(tree, model, place, masks, down=True), batch.num_rows
                for node in inner:
                    outer = 1.0 if node == tree.root else np.einsum("cij,scj->sci", block.p[node], block.base[node])
                    joint = np.einsum("c,i,sci->si", model.weights, model.freqs, block.up[node] * outer)
                    shares = joint / joint.sum(axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), 4))), pa.array(np.full(4 * n, node, np.int32)), pa.array(np.tile(np.arange(4, dtype=np.int32), n)), pa.array(shares.ravel())], names=["pattern_id", "node_id", "state", "probability"])

    return patterns.select("pattern_id", "pattern").mapInArrow(run, "pattern_id int, node_id int, state int, probability double")


def with_invariant(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ln_lk_inv: a share ``pinv`` of the sites doesn't change. rows: ln_lk and pattern (masks)."""
    common = F.aggregate("pattern", F.lit(ALL), lambda a, m: a.bitwiseAND(m))
    pi = sum(F.when(common.bitwiseAND(F.lit(1 << b)) > 0, F.lit(model.freqs[b])).otherwise(0.0) for b in range(4))
    variable, fixed = F.log(F.lit(1 - model.pinv)) + F.col("ln_lk"), F.when(pi * model.pinv > 0, F.log(pi * model.pinv))
    most = F.greatest(variable, fixed)  # nulls don't count; the sum is taken relative to it, so that small likelihoods stay
    return rows.withColumn("ln_lk_inv", most + F.log(F.exp(variable - most) + F.coalesce(F.exp(fixed - most), F.lit(0.0))))


def lewis_correction(loglik: float, weight: float, constant_likelihoods: list[float]) -> float:
    """Ascertainment: only variable sites were seen. ``constant_likelihoods``: of the four constant columns."""
    return loglik - weight * float(np.log1p(-sum(constant_likelihoods)))


def felsenstein_correction(loglik: float, constant_weight: float, constant_likelihoods: list[float]) -> float:
    """Ascertainment: ``constant_weight`` sites are known to be constant, but not in which state."""
    return loglik + constant_weight * float(np.log(sum(constant_likelihoods)))


def stamatakis_correction(loglik: float, weights: list[float], constant_likelihoods: list[float]) -> float:
    """Ascertainment: how many sites are constant in each state is known."""
    return loglik + float(np.dot(weights, np.log(constant_likelihoods)))


def constant_likelihoods(tree: Tree, model: Model) -> list[float]:
    """The likelihoods of the four constant columns."""
    taxa = {tree.name[n]: k for k, n in enumerate(tree.tips())}
    masks = np.repeat(1 << np.arange(4)[:, None], len(taxa), axis=1)
    return np.exp(Block(tree, model, taxa, masks).loglik()).tolist()
