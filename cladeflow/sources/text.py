"""Alignments and trees as text files; many genes at once, a file or a folder of files for each run.

Alignments become (gene_id, row_ix, name, seq), with gene_id the file's name without its ending.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.model import Model, parse_best_model
from ..plans.tree import Tree

GENE = r"([^/]+?)(?:\.[A-Za-z0-9]+)*$"
SPACE = r"\s+"


def _gene() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), GENE, 1)


def read_fasta(spark: SparkSession, path: str, equal: bool = False) -> DataFrame:
    """``>`` and the whole header line as name; sequence lines are joined, white space goes. Large files are split at records.

    equal: a sequence that is shorter than its gene's longest one is an error, as in an alignment.
    """
    # A record's place in its file orders rows; files are split by bytes, so this is where a record begins.
    rows = spark.read.option("lineSep", "\n>").text(path).select(_gene().alias("gene_id"), (F.col("_metadata.file_block_start") * 1_000_000 + F.monotonically_increasing_id() % (1 << 33)).alias("place"), F.regexp_replace("value", r"^\s*>", "").alias("record"))
    cut = F.instr("record", "\n")
    name = F.trim(F.regexp_replace(F.when(cut > 0, F.substring("record", F.lit(1), cut - 1)).otherwise(F.col("record")), r"\r", ""))
    seq = F.regexp_replace(F.when(cut > 0, F.substring("record", cut, F.length("record"))).otherwise(""), SPACE, "")
    order = Window.partitionBy("gene_id").orderBy("place")
    found = rows.filter(F.trim("record") != "").select("gene_id", (F.row_number().over(order) - 1).alias("row_ix"), name.alias("name"), seq.alias("seq"))
    if not equal:
        return found
    wrong = F.length("seq") != F.max(F.length("seq")).over(Window.partitionBy("gene_id"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("another length than the longest sequence: "), F.col("name")))).otherwise(F.col("seq"))
    return found.select("gene_id", "row_ix", "name", checked.cast("string").alias("seq"))


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """Relaxed PHYLIP, sequential or interleaved: a header with the counts of taxa and sites, then lines of name and sequence."""
    files = spark.read.text(path, wholetext=True).select(_gene().alias("gene_id"), F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    head = F.split(F.trim(F.get("lines", 0)), SPACE)
    counted = files.select("gene_id", F.get(head, 0).cast("int").alias("ntax"), F.get(head, 1).cast("int").alias("nsites"), F.posexplode(F.filter("lines", lambda x, k: k > 0)).alias("at", "line"))
    parts = F.split(F.trim("line"), SPACE)
    first = F.col("at") < F.col("ntax")
    text = F.array_join(F.filter(parts, lambda x, k: ~first | (k > 0)), "")
    rows = counted.select("gene_id", "ntax", "nsites", (F.col("at") % F.col("ntax")).alias("row_ix"), "at", F.when(first, F.get(parts, 0)).alias("name"), text.alias("text"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    found = rows.groupBy("gene_id", "row_ix", "ntax", "nsites").agg(F.max("name").alias("name"), seq.alias("seq"))
    wrong = F.length("seq") != F.col("nsites")
    return found.select("gene_id", "row_ix", "name", F.when(wrong, F.raise_error(F.concat(F.lit("wrong number of sites: "), F.col("name")))).otherwise(F.col("seq")).cast("string").alias("seq"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or PHYLIP, by the first character of the first line that isn't blank; all sequences of a gene have one length."""
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    return read_fasta(spark, path, equal=True) if first[0][0].lstrip().startswith(">") else read_phylip(spark, path)


def write_fasta(msa: DataFrame, path: str) -> None:
    msa.orderBy("row_ix").select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


def write_phylip(msa: DataFrame, path: str) -> None:
    """One file: the header, then a line for each taxon."""
    head = msa.agg(F.lit(-1).alias("row_ix"), F.concat_ws(" ", F.count("*"), F.max(F.length("seq"))).alias("line"))
    msa.select("row_ix", F.concat_ws(" ", "name", "seq").alias("line")).unionByName(head).repartition(1).sortWithinPartitions("row_ix").select("line").write.text(path)


def read_tree(spark: SparkSession, path: str) -> Tree:
    (row,) = spark.read.text(path, wholetext=True).limit(1).collect()
    return Tree.parse(row[0])


def read_model(spark: SparkSession, path: str, base: Model | None = None) -> Model:
    (row,) = spark.read.text(path, wholetext=True).limit(1).collect()
    return parse_best_model(row[0], base)


def check_output(path: str, *others: str) -> str:
    """The path to write to, if its folder exists and no other output has it."""
    full = Path(path).expanduser().resolve()
    if not full.parent.is_dir():
        raise ValueError(f"{full.parent} is no folder")
    if full in {Path(x).expanduser().resolve() for x in others}:
        raise ValueError(f"{full} is written twice")
    return str(full)
