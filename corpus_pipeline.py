"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its predecessor kept. ``run`` writes a
stage's result as Parquet to the shared folder and reads it again as the next one's documents, so a lost executor costs
a stage's tasks at most.

Null ids stay documents of their own; null and empty texts are copies of each other, so one of them stays. Rows with one
id and different texts are different documents. Without labels nothing is toxic; without test items nothing is cut; an
empty table gives no rows. Replicas of the mixture are rows with one id, and each has its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeflow.llm import decontaminate, mixing, simhash, spark_util, token_store, toxicity
from cladeflow.llm.queries import WEIGHTS, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain predicts toxic go; it is trained on the labelled documents among ``docs``."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 or more (5-word shingles) stays: that with the smallest id."""
    return simhash.deduplicated(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson count says. The columns stay; replicas are rows with the same doc_id."""
    return mixing.mixed(docs, WEIGHTS).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every replica, read back from the token files."""
    return token_store.token_index(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: SQL can't express the chain's training, nor the fingerprints; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spark_util.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
