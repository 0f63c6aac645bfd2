"""The registered queries of the engine, on data derived from the star-schema tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.alphabet import mask_of
from .operators import alignment, likelihood, moves, parsimony, placement, pruned_search, rings, spr, tree_relations, vectors
from .plans import derived, oracle
from .plans.derived import COSTS, MODEL
from .plans.shared import shared_path, written
from .plans.tree import Tree
from .sources import jplace, text
from .streaming.placement import commit_stream, each_batch

#: Queries that one commit batch takes (a setting of the commit loop, which is sequential).
BATCH = 3
#: Registered placements optimise every edge of every query, as the reference does by default.
FULL = placement.Options(candidates=None, passes=4)
#: Commits screen all edges and optimise those in the best quarter of the span of their scores.
COMMIT = placement.Options(candidates=None, passes=4, keep=0.25)
#: Sites whose keys are equal but for these last bits are one range of a sequence.
RANGE = 14
#: The pruned search, and the radius of registered rings.
PRUNED, RADIUS = pruned_search.PruneOptions(), 4


def taxa(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names in row order; 25 rows."""
    return [r[0] for r in derived.table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]


def patterns(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    """Site patterns as arrays of masks."""
    return alignment.site_patterns(alignment.encoded(derived.cells(spark, sf_dir)), keys, "mask")


def stored_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed alignment is used several times, so it is written once."""
    return _dealt(spark, patterns(spark, sf_dir))


def _dealt(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Patterns as a table of several files: they are few and each costs much work, so no task shall hold all of them."""
    return written(found.repartition(spark.sparkContext.defaultParallelism, "pattern_id"), "patterns")


def counts(spark: SparkSession, sf_dir: str, queries: DataFrame, found: DataFrame) -> DataFrame:
    sites = alignment.site_map(alignment.encoded(derived.cells(spark, sf_dir)), found, "mask")
    return placement.query_counts(queries.select("query", "site", mask_of(F.col("sym")).alias("mask")), sites)


class Queries:
    """Suppliers as queries. Those with equal sequences have equal counts, scores and places, so these are made for one of
    them, and the others take its rows over at the end."""

    def __init__(self, spark: SparkSession, sf_dir: str, found: DataFrame, suppliers: DataFrame | None = None) -> None:
        suppliers = derived.table(spark, sf_dir, "supplier") if suppliers is None else suppliers
        rows = suppliers.select("s_suppkey", "s_nationkey")
        self.members = written(derived.members(spark, sf_dir, rows), "members")
        like = self.members.select(F.col("like").alias("s_suppkey")).distinct()
        firsts = rows.join(like, rows["s_suppkey"].eqNullSafe(like["s_suppkey"]), "left_semi")
        #: query, pattern_id, mask and weight of one query for each sequence; ``dealt`` also has block and chunk, by which they lie.
        self.dealt = derived.joint_counts(spark, sf_dir, found, firsts, placement.block_of(F.col("pattern_id")), placement.chunk_of(F.col("query")), placement.CHUNKS)
        self.counts = self.dealt.drop("block", "chunk")

    def all(self, found: DataFrame) -> DataFrame:
        """Results of the queries in ``counts`` for all queries."""
        names, other = found.columns, self.members.withColumnRenamed("query", "member")
        both = found.join(other, found["query"].eqNullSafe(other["like"]))
        return both.select(*(F.col("member").alias("query") if c == "query" else c for c in names))


def tree_loglik(spark, sf_dir):
    """Encode, compress, and sum the log-likelihood level by level."""
    names = taxa(spark, sf_dir)
    out = likelihood.tree_loglik(derived.tree(spark, sf_dir), patterns(spark, sf_dir), MODEL, names)
    return out.select(F.round("loglik", 6).alias("loglik"), "n_sites")


def tree_loglik_blocked(spark, sf_dir):
    out = likelihood.blocked_loglik(derived.tree(spark, sf_dir), patterns(spark, sf_dir), MODEL, taxa(spark, sf_dir))
    return out.select(F.round("loglik", 6).alias("loglik"), "n_sites")


def gene_logliks(spark, sf_dir):
    """Many genes in one job: brands are genes."""
    out = likelihood.blocked_loglik(derived.tree(spark, sf_dir), patterns(spark, sf_dir, ["gene_id"]), MODEL, taxa(spark, sf_dir), ["gene_id"])
    return out.select("gene_id", F.round("loglik", 6).alias("loglik"), "n_sites")


def alignment_encode(spark, sf_dir):
    return alignment.encoded(derived.cells(spark, sf_dir)).select("gene_id", "site", "taxon", "sym", "mask")


def site_patterns(spark, sf_dir):
    return alignment.site_patterns(derived.cells(spark, sf_dir)).select("pattern_id", "first_site", "weight", "pattern")


def site_pattern_map(spark, sf_dir):
    cells = derived.cells(spark, sf_dir)
    return alignment.site_map(cells, alignment.site_patterns(cells))


def base_frequencies(spark, sf_dir):
    n = alignment.base_counts(derived.cells(spark, sf_dir))
    return n.select("state", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9).alias("freq"))  # four rows


def invariant_sites(spark, sf_dir):
    """In each clade (region) the sites where one state fits all its taxa; all taxa are read."""
    regions = derived.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_ix"), F.col("n_regionkey").alias("region"))
    return alignment.invariant_sites(derived.cells(spark, sf_dir).join(F.broadcast(regions), "row_ix"), ["region"])  # 25 nations


def invariant_sites_all(spark, sf_dir):
    """The sites where one state fits all taxa."""
    return alignment.invariant_sites(derived.cells(spark, sf_dir))


def transition_matrices(spark, sf_dir):
    nodes = derived.tree(spark, sf_dir).nodes(spark)
    p = likelihood.transition_table(nodes, MODEL)
    return p.join(F.broadcast(nodes.filter("is_tip").select("node_id", "name")), "node_id").select("name", "cat", "i", "j", F.round("p", 9).alias("p"))


def pattern_likelihoods(spark, sf_dir):
    cells = alignment.encoded(derived.cells(spark, sf_dir))
    found = alignment.site_patterns(cells, value="mask")
    names = F.array(*map(F.lit, taxa(spark, sf_dir)))
    long = found.select("pattern_id", F.posexplode("pattern").alias("at", "mask")).select("pattern_id", F.get(names, F.col("at")).alias("taxon"), "mask")
    lk = likelihood.pattern_likelihoods(derived.tree(spark, sf_dir), long, MODEL, ["pattern_id"])
    return lk.select("pattern_id", F.round("ln_lk", 6).alias("ln_lk"))


def edge_logliks(spark, sf_dir):
    """Seen from each edge, the likelihood is the tree's."""
    out = likelihood.edge_logliks(derived.tree(spark, sf_dir), patterns(spark, sf_dir), MODEL, taxa(spark, sf_dir))
    return out.select("edge", F.round("loglik", 6).alias("loglik"))


def root_states(spark, sf_dir):
    out = likelihood.ancestral_states(derived.tree(spark, sf_dir), patterns(spark, sf_dir), MODEL, taxa(spark, sf_dir))
    return out.filter("node_id = 0").select("pattern_id", "state", F.round("probability", 6).alias("probability"))


def ancestral_states(spark, sf_dir):
    out = likelihood.ancestral_states(derived.tree(spark, sf_dir), patterns(spark, sf_dir), MODEL, taxa(spark, sf_dir))
    return out.withColumn("probability", F.round("probability", 6))


def fitch_parsimony(spark, sf_dir):
    return parsimony.fitch(derived.tree(spark, sf_dir), patterns(spark, sf_dir), taxa(spark, sf_dir))


def sankoff_parsimony(spark, sf_dir):
    """Transversions cost twice as much as transitions."""
    return parsimony.sankoff(derived.tree(spark, sf_dir), patterns(spark, sf_dir), taxa(spark, sf_dir), COSTS)


def site_repeats(spark, sf_dir):
    out = moves.site_repeats(derived.tree(spark, sf_dir), patterns(spark, sf_dir), taxa(spark, sf_dir))
    return out.groupBy("node_id").agg(F.countDistinct("class").alias("n_classes"))


def best_interchange(spark, sf_dir):
    """The nearest tree by one interchange; a row for each node, and its log-likelihood."""
    found, names = stored_patterns(spark, sf_dir), taxa(spark, sf_dir)
    tree, loglik = moves.best_interchange(derived.tree(spark, sf_dir), lambda trees: spr.tree_logliks(trees, found, MODEL, names))
    return tree.nodes(spark).withColumn("loglik", F.lit(loglik))


def query_counts(spark, sf_dir):
    own = Queries(spark, sf_dir, patterns(spark, sf_dir))
    return own.all(own.counts)


def _baseline(spark, sf_dir, tree: Tree, edges: list[int]) -> tuple[Queries, DataFrame]:
    """Scores of one query for each sequence, on ``edges``."""
    found = stored_patterns(spark, sf_dir)
    own = Queries(spark, sf_dir, found)
    out = placement.baseline_scores(tree, found, own.dealt, MODEL, taxa(spark, sf_dir), False, edges)
    return own, out.withColumn("loglik", F.round("loglik", 6))


def placement_baseline(spark, sf_dir):
    """All queries on all edges."""
    tree = derived.tree(spark, sf_dir)
    own, out = _baseline(spark, sf_dir, tree, tree.edges())
    return own.all(out)


def placement_tip_edges(spark, sf_dir):
    """The scores at the tree's tips, by their names; only these edges are scored."""
    tree = derived.tree(spark, sf_dir)
    own, out = _baseline(spark, sf_dir, tree, tree.tips())
    names = spark.createDataFrame([(n, tree.name[n]) for n in tree.tips()], "edge int, tip string")
    return own.all(out.join(F.broadcast(names), "edge").select("query", "tip", "loglik"))


def placement_edge_ranking(spark, sf_dir):
    """The five best of all edges, inner ones too, with weight ratios and gaps; queries with equal sequences are ranked once."""
    tree = derived.tree(spark, sf_dir)
    own, scores = _baseline(spark, sf_dir, tree, tree.edges())
    out = own.all(placement.ranked(scores, 5))
    return out.select("query", "edge", "rank", "loglik", F.round("lwr", 6).alias("lwr"), F.round("gap_top2", 5).alias("gap_top2"), F.round("gap_top5", 5).alias("gap_top5"))


def placement_ranking(spark, sf_dir):
    return placement_edge_ranking(spark, sf_dir).drop("loglik")


def _searched(spark, sf_dir, options: pruned_search.PruneOptions) -> DataFrame:
    found, tree, names = stored_patterns(spark, sf_dir), derived.tree(spark, sf_dir), taxa(spark, sf_dir)
    own = Queries(spark, sf_dir, found)
    counted = written(own.counts, "counts")
    return own.all(pruned_search.searched(tree, lambda edges: placement.baseline_scores(tree, found, counted, MODEL, names, edges=edges), counted.select("query"), options))


def pruned_placement(spark, sf_dir):
    """The search from the root downwards that leaves branches which get worse; all (query, edge) that it scored."""
    return _searched(spark, sf_dir, PRUNED).withColumn("loglik", F.round("loglik", 6))


def ring_edges(spark, sf_dir):
    """The rings of edges around the place of each subtree of the tree, when it is pruned."""
    return rings.ring_edges(derived.tree(spark, sf_dir).nodes(spark), RADIUS)


def regraft_logliks(spark, sf_dir):
    """The tree's log-likelihood with each nation's tip moved to the middle of each other one's branch."""
    tree, found = derived.tree(spark, sf_dir), stored_patterns(spark, sf_dir)
    tips = tree.tips()
    work = [(t, tree.blen[t], [u for u in tips if u != t]) for t in tips]
    out = vectors.regraft_scores(tree, found, MODEL, taxa(spark, sf_dir), work)
    names = spark.createDataFrame([(n, tree.name[n]) for n in tips], "node int, name string")
    moved, target = (F.broadcast(names.toDF(c, n)) for c, n in (("node", "tip"), ("edge", "target")))
    return out.join(moved, "node").join(target, "edge").select("tip", "target", F.round("loglik", 6).alias("loglik"))


def placements(spark, sf_dir):
    found = stored_patterns(spark, sf_dir)
    own = Queries(spark, sf_dir, found)
    return own.all(placement.placed(derived.tree(spark, sf_dir), found, written(own.counts, "counts"), MODEL, taxa(spark, sf_dir), FULL))


def selective_placements(spark, sf_dir):
    """All edges in one pass, and three more for the best edges of ambiguous queries."""
    found = stored_patterns(spark, sf_dir)
    own = Queries(spark, sf_dir, found)
    return own.all(placement.selectively_placed(derived.tree(spark, sf_dir), found, written(own.counts, "counts"), MODEL, taxa(spark, sf_dir), FULL))


def jplace_records(spark, sf_dir):
    return jplace.records(placements(spark, sf_dir), derived.tree(spark, sf_dir))


def _with_queries(spark, sf_dir, keys: list[int] | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Patterns over the taxa and all queries (or those with ``keys``), in input order; a row for each query comes to the driver, where the commit loop is.

    Queries with equal sequences share a column, so a pattern is no wider than there are sequences.
    """
    rows = derived.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    if keys is not None:
        rows = rows.join(F.broadcast(spark.createDataFrame([(key,) for key in keys], "s_suppkey bigint")), "s_suppkey", "left_semi")
    nation = {r["s_suppkey"]: r["s_nationkey"] for r in rows.orderBy("s_suppkey").collect()}
    like = {r["query"]: r["like"] for r in derived.members(spark, sf_dir, rows).collect()}
    keys = list(nation) if keys is None else keys
    firsts = list(dict.fromkeys(like[key] for key in keys))
    nations = [r[0] for r in derived.table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    grouped = derived.joint_patterns(spark, sf_dir, nations, [(nation[key], key) for key in firsts])
    alike = F.pmod("first_site", F.lit(derived.QUERY_PERIOD)).alias("alike")  # by it, queries differ from their nations at the same patterns
    found = alignment.numbered(grouped, "first_site", "pattern_id").select("pattern_id", "first_site", "weight", "pattern", alike)
    column = {key: len(nations) + k for k, key in enumerate(firsts)}
    queries = {f"query_{key}": column[like[key]] for key in keys}
    names = likelihood.Names({name: k for k, name in enumerate(taxa(spark, sf_dir))} | queries)
    return _dealt(spark, found), names, list(queries)


def committed_tree(spark, sf_dir):
    """All queries, each inserted at its best place, in input order."""
    found, names, queries = _with_queries(spark, sf_dir)
    return placement.committed(derived.tree(spark, sf_dir), found, MODEL, names, queries, COMMIT).nodes(spark)


def refined_tree(spark, sf_dir):
    """Insert a batch, then refine around it, until all queries are in; a row for each node, and the log-likelihood of the tree."""
    found, names, queries = _with_queries(spark, sf_dir)
    tree, found = derived.tree(spark, sf_dir), placement.blocks(found)
    for k in range(0, len(queries), BATCH):
        batch = queries[k : k + BATCH]
        tree, loglik = spr.refined(placement.committed(tree, found, MODEL, names, batch, COMMIT), found, MODEL, names, batch)
    return tree.nodes(spark).withColumn("loglik", F.lit(loglik))


def committed_batch(spark, sf_dir, tree, batch: DataFrame):
    """The tree with a batch of suppliers, in the order of their keys: patterns are those of all tips that it then has."""
    new = [r[0] for r in batch.select("s_suppkey").orderBy("s_suppkey").collect()]  # a row for each query of the batch
    old = sorted(int(tree.name[n].removeprefix("query_")) for n in tree.tips() if tree.name[n].startswith("query_"))
    found, names, queries = _with_queries(spark, sf_dir, old + new)
    return placement.committed(tree, found, MODEL, names, queries[len(old) :], COMMIT)


def streamed_tree(spark, sf_dir):
    """Suppliers arrive in three parts; each is committed to the tree that the one before has left. The tips of the last tree."""
    source, suppliers = shared_path(spark, "arrivals"), derived.table(spark, sf_dir, "supplier")
    cuts = suppliers.approxQuantile("s_suppkey", [1 / 3, 2 / 3], 0.01)
    part = F.lit(0) + sum((F.col("s_suppkey") > c).cast("int") for c in cuts)
    for k in range(3):
        suppliers.filter(part == k).coalesce(1).write.mode("append").parquet(source)  # an arrival is a file
    stream = spark.readStream.schema(suppliers.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tree = commit_stream(stream, derived.tree(spark, sf_dir), lambda now, batch: committed_batch(spark, sf_dir, now, batch), shared_path(spark, "trees"), shared_path(spark, "tree-state"))
    return tree.nodes(spark).filter("is_tip").select("name")


def tip_distances(spark, sf_dir):
    nodes = derived.tree(spark, sf_dir).nodes(spark)
    out = tree_relations.tip_distances(nodes, tree_relations.ancestors(nodes))
    return out.select("tip_a", "tip_b", F.round("length", 6).alias("length"))


def subtree_sizes(spark, sf_dir):
    nodes = derived.tree(spark, sf_dir).nodes(spark)
    return tree_relations.subtree_sizes(nodes, tree_relations.ancestors(nodes)).withColumn("length", F.round("length", 6))


def name_mismatches(spark, sf_dir):
    """Tree tips against the nations of all suppliers."""
    tips = derived.tree(spark, sf_dir).nodes(spark).filter("is_tip").select("name")
    rows = derived.table(spark, sf_dir, "supplier").join(derived.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return alignment.name_mismatches(tips, rows.select(F.col("n_name").alias("name")))


def name_mismatches_all(spark, sf_dir):
    """The former name of the whole job."""
    return name_mismatches(spark, sf_dir)


def mixed_name_mismatches(spark, sf_dir):
    """Tree tips against the names of all regions and of the nations of the first three: both sides miss some."""
    tips = derived.tree(spark, sf_dir).nodes(spark).filter("is_tip").select("name")
    rows = derived.table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("name"))
    return alignment.name_mismatches(tips, rows.unionByName(derived.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))))


def _part_names(spark, sf_dir) -> DataFrame:
    return derived.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_type").alias("name"), F.col("p_name").alias("seq"), "p_partkey")


def bad_symbols(spark, sf_dir):
    """Part names read as sequences."""
    return alignment.bad_symbols(alignment.wide_to_cells(_part_names(spark, sf_dir), ["p_partkey"])).select("p_partkey", F.col("site").cast("bigint").alias("site"), "sym")


def bad_names(spark, sf_dir):
    return alignment.bad_names(_part_names(spark, sf_dir))


def unequal_lengths(spark, sf_dir):
    return alignment.unequal_lengths(_part_names(spark, sf_dir)).select("gene_id", "name", F.col("n").cast("bigint").alias("n"))


def _msa(spark, sf_dir) -> DataFrame:
    """A row for each taxon. Ranges of sites are joined first, so a task has strings of a taxon's ranges, not a row for each of its sites."""
    joined = lambda at, of: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, of))), lambda x: x[of]), "").alias("seq")
    ranges = derived.cells(spark, sf_dir).groupBy("row_ix", F.col("taxon").alias("name"), F.shiftright("site", RANGE).alias("range")).agg(joined("site", "sym"))
    return ranges.groupBy("row_ix", "name").agg(joined("range", "seq"))


def fasta_round_trip(spark, sf_dir):
    path = shared_path(spark, "fasta")
    text.write_fasta(_msa(spark, sf_dir).coalesce(1), path)
    return text.read_alignment(spark, path).select("name", "seq")


def phylip_round_trip(spark, sf_dir):
    path = shared_path(spark, "phylip")
    text.write_phylip(_msa(spark, sf_dir).withColumn("name", F.translate("name", " ", "_")), path)
    return text.read_alignment(spark, path).select("name", "seq")


def stream_query_counts(spark, sf_dir):
    """Suppliers arrive as a stream; each batch is reduced to counts."""
    found = stored_patterns(spark, sf_dir)
    schema = derived.table(spark, sf_dir, "supplier").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "supplier.parquet").parquet(sf_dir)
    path = shared_path(spark, "stream")

    def process(batch: DataFrame) -> DataFrame:
        own = Queries(spark, sf_dir, found, batch)
        return own.all(own.counts)

    each_batch(stream, process, path, shared_path(spark, "stream-state"))
    return spark.read.parquet(path).drop("batch")


QUERIES = [
    tree_loglik, tree_loglik_blocked, gene_logliks, alignment_encode, site_patterns, site_pattern_map, base_frequencies, invariant_sites, invariant_sites_all, transition_matrices,
    pattern_likelihoods, edge_logliks, root_states, ancestral_states, fitch_parsimony, sankoff_parsimony, site_repeats, best_interchange, query_counts, placement_baseline, placement_tip_edges,
    placement_ranking, placement_edge_ranking, pruned_placement, ring_edges, regraft_logliks, placements, selective_placements, jplace_records, committed_tree, streamed_tree, refined_tree, tip_distances, subtree_sizes, name_mismatches, name_mismatches_all, mixed_name_mismatches, bad_symbols, bad_names,
    unequal_lengths, fasta_round_trip, phylip_round_trip, stream_query_counts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
