"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its target weight times the corpus size over the source's own size. Each document
draws a count from a Poisson distribution with that mean, by inverting the distribution function at a number that is
hashed from its id and a seed; it is replicated that many times, and all replicas are dealt out and ordered by a hash.
The same seed gives the same mixture on any cluster, and a document's count depends on no other document.

Scale: the sizes are one aggregation with partial sums on the map side. The rates have one row a source; they are
counted, and broadcast only up to ``BROADCAST_SOURCES`` rows. A hot source is dealt out by replica, never by source.

Weights of present sources above 1 in all are scaled to 1; negative ones are refused. Very long texts are carried as they
are, and count all their characters. Null sources are a source of their own. Documents with the same id get the same count. Null and empty texts count no
characters; a source without any characters keeps its documents at rate 1. Extra columns come along; an own column ``replica`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import set_aside

#: Rows of rates that are broadcast; each is a name and a number.
BROADCAST_SOURCES = 100_000
#: A larger mean is drawn as a sum of independent parts, since exp(-mean) would vanish.
MOST_MEAN = 500.0
SEED = "mix-1"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the seed and the parts."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, seed: str, doc_id: Column) -> Column:
    """The least k with u < P(X <= k), X of Poisson distribution: by summing its terms up from k = 0."""
    parts = F.greatest(F.lit(1), F.ceil(mean / MOST_MEAN).cast("int"))
    each = mean / parts

    def drawn(part: Column) -> Column:
        u = uniform(seed, doc_id, part)
        terms = F.sequence(F.lit(1), F.ceil(each + 12 * F.sqrt(each) + 30).cast("int"))
        start = F.struct(F.exp(-each).alias("p"), F.exp(-each).alias("below"), F.lit(0).alias("k"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * each / k
            return F.struct(p.alias("p"), (s["below"] + p).alias("below"), F.when(u >= s["below"], k).otherwise(s["k"]).alias("k"))

        return F.aggregate(terms, start, step, lambda s: s["k"])

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, part: acc + drawn(part))


def rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0) -> DataFrame:
    """mix_source and mix_rate: the target repetition rate of each source.

    ``weights`` maps sources to shares of the mixture's characters; the others share the rest by their sizes. Weights of
    present sources that add up to more than 1 are scaled to 1, and nothing is left for the others.
    """
    if any(not 0 <= w < float("inf") for w in weights.values()):
        raise ValueError("weights must be numbers from 0 on")
    named = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    sizes = sizes.withColumn("weight", F.when(F.col("mix_source").isNotNull(), F.try_element_at(named, F.col("mix_source").cast("string"))))
    totals = sizes.agg(F.sum("size").alias("all"), F.sum(F.when(F.col("weight").isNull(), F.col("size"))).alias("others"), F.sum("weight").alias("given"))
    given = F.coalesce(F.col("given"), F.lit(0.0))
    share = F.coalesce(F.col("weight") / F.greatest(given, F.lit(1.0)), F.greatest(1 - given, F.lit(0.0)) * F.col("size") / F.col("others"))
    rate = F.when(F.col("size") > 0, share * F.lit(float(epochs)) * F.col("all") / F.col("size")).otherwise(F.lit(1.0))
    return sizes.crossJoin(F.broadcast(totals)).select("mix_source", rate.alias("mix_rate"))  # totals: one row


def mixed(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` and ``replica`` (1, 2, ...), in an order that is random for the whole mixture."""
    own, back = set_aside(docs.drop("replica"), ("mix_source", "mix_rate", "mix_count", "mix_place"))
    table = rates(docs, weights, epochs)
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    counted = own.join(table, own["source"].eqNullSafe(F.col("mix_source")), "left")
    copies = counted.withColumn("mix_count", poisson(F.col("mix_rate"), seed, F.col("doc_id"))).filter("mix_count > 0")
    replicas = copies.withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("replica"))
    return replicas.withColumn("mix_place", place).select(*own.columns, "replica", "mix_place").repartition("mix_place").sortWithinPartitions("mix_place").select(*back, "replica")
