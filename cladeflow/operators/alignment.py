"""Alignments in long form (site, taxon or row, sym): checks, encoding, site patterns, frequencies, invariant sites.

Everything here groups by site or by pattern, so it scales with sites and taxa; no site is gathered beyond its column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import ALLOWED, MISSING, STATES, mask_of
from ..functions.model import floored
from ..plans.shared import written


def wide_to_cells(msa: DataFrame, keys: list[str]) -> DataFrame:
    """From (``keys``, seq) to (``keys``, site, sym); sites count from 0."""
    return msa.select(*keys, F.posexplode(F.split("seq", "")).alias("site", "sym")).filter("sym <> ''")


def bad_symbols(cells: DataFrame) -> DataFrame:
    """Cells whose symbol isn't allowed, with 1-based sites."""
    return cells.filter(~F.upper("sym").isin(*ALLOWED)).withColumn("site", F.col("site") + 1)


def bad_names(msa: DataFrame) -> DataFrame:
    """Names that are empty or not unique, and how often they stand."""
    return msa.groupBy("name").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.trim("name") == "") | F.col("name").isNull())


def unequal_lengths(msa: DataFrame) -> DataFrame:
    """Rows whose length isn't the longest one of their gene."""
    longest = msa.groupBy("gene_id").agg(F.max(F.length("seq")).alias("sites"))
    return msa.join(longest, "gene_id").filter((F.length("seq") != F.col("sites")) | (F.col("sites") == 0)).select("gene_id", "name", F.length("seq").alias("n"))


def name_mismatches(tips: DataFrame, msa: DataFrame) -> DataFrame:
    """Names that only the tree or only the alignment has."""
    joined = tips.select("name").distinct().withColumn("in_tree", F.lit(True)).join(msa.select("name").distinct().withColumn("in_msa", F.lit(True)), "name", "full_outer")
    return joined.filter("in_tree is null or in_msa is null").select("name", F.when(F.col("in_tree").isNull(), "tree").otherwise("alignment").alias("missing_in"))


def shared_names(queries: DataFrame, msa: DataFrame) -> DataFrame:
    return queries.select("name").join(msa.select("name"), "name", "left_semi").distinct()


def encoded(cells: DataFrame) -> DataFrame:
    return cells.withColumn("mask", mask_of(F.col("sym")))


def columns(cells: DataFrame, keys: list[str], row: str = "row_ix", value: str = "sym") -> DataFrame:
    """Each site's column of symbols, in row order: one string, or one array of masks."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(row, value))), lambda x: x[value])
    return cells.groupBy(*keys, "site").agg((F.array_join(ordered, "") if value == "sym" else ordered).alias("pattern"))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in an order, without bringing them together: places in ranges, and a sum of the ranges before."""
    placed = written(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "numbered")  # written once, as ranges are sampled
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.join(F.broadcast(starts), "part").withColumn(name, (F.col("start") + within - 1).cast("int")).drop("part", "start")


def site_patterns(cells: DataFrame, keys: list[str] | None = None, value: str = "sym") -> DataFrame:
    """Equal columns as one pattern: ``keys``, pattern_id (by first site), first_site, weight, pattern."""
    own = keys or []
    grouped = columns(cells, own, value=value).groupBy(*own, "pattern").agg(F.min("site").alias("first_site"), F.count("*").alias("weight"))
    if own:
        order = Window.partitionBy(*own).orderBy("first_site")  # of distinct patterns
        found = grouped.withColumn("pattern_id", F.row_number().over(order) - 1)
    else:
        found = numbered(grouped, "first_site", "pattern_id")
    return found.select(*own, "pattern_id", "first_site", "weight", "pattern")


def site_map(cells: DataFrame, patterns: DataFrame, value: str = "sym") -> DataFrame:
    """site and pattern_id."""
    return columns(cells, [], value=value).join(patterns.select("pattern", "pattern_id"), "pattern").select("site", "pattern_id")


def base_counts(cells: DataFrame) -> DataFrame:
    """How often each state stands, an ambiguous symbol in equal shares; missing ones don't count."""
    shares = {s: of for s, of in STATES.items() if s not in MISSING and len(of) < 4}
    table = F.create_map(*[F.lit(x) for s, of in shares.items() for x in (s, of)])
    states = F.try_element_at(table, F.upper("sym"))
    each = cells.groupBy(states.alias("states")).count().filter("states is not null")  # a row for each symbol from here on
    return each.select(F.explode(F.split("states", "")).alias("state"), (F.col("count") / F.length("states")).alias("share")).filter("state <> ''").groupBy("state").agg(F.sum("share").alias("n"))


def empirical_frequencies(cells: DataFrame) -> list[float]:
    """The four frequencies; four rows come to the driver."""
    found = {r["state"]: r["n"] for r in base_counts(cells).collect()}
    import numpy as np

    counts = np.array([found.get(s, 0.0) for s in "ACGT"])
    return floored(counts / counts.sum()).tolist() if counts.sum() else [0.25] * 4


def invariant_sites(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sites where one state fits all taxa (of each of ``keys``): ``keys``, site and state (0 to 3)."""
    own = keys or []
    common = encoded(cells).groupBy(*own, "site").agg(F.bit_and("mask").alias("common"))
    return common.filter(F.bit_count("common") == 1).select(*own, "site", F.log2("common").cast("int").alias("state"))


def informative_patterns(patterns: DataFrame) -> DataFrame:
    """Patterns (arrays of masks) that at least two states have in two or more rows each."""
    counts = [F.size(F.filter("pattern", lambda m, b=b: m == F.lit(1 << b))) for b in range(4)]
    return patterns.filter(sum((c >= 2).cast("int") for c in counts) >= 2)
