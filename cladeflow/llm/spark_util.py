"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch. Very long texts make few-row batches instead of large ones.
BATCH_ROWS = 250
BATCH_BYTES = 4 << 20

#: Bytes that stand between words: all ASCII but letters and digits. Upper case becomes lower case.
WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased; null has none."""
    return text.translate(WORD_TABLE).split() if text else []


class RecentWords:
    """What a function gives for short keys, kept for those that came back; the many that don't soon make room."""

    def __init__(self, make: Callable, most: int = 400_000, longest: int = 200) -> None:
        self.make, self.most, self.longest = make, most, longest
        self.often: dict = {}
        self.once: dict = {}

    def missed(self, key):
        """For a key that is not in ``often``."""
        if len(key) > self.longest:
            return self.make(key)
        known = self.once.pop(key, None)
        if known is not None:
            if len(self.often) >= self.most:
                self.often.clear()
            self.often[key] = known
            return known
        if len(self.once) >= self.most:
            self.once.clear()
        self.once[key] = known = self.make(key)
        return known


def give_back() -> None:
    """Give free memory back to the system, as the Python process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep what a Python task holds at once small, however long the texts are."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, one machine) is a local folder made for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, carry: list[str], inputs: list[str], schema: str, factory: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """The ``carry`` columns as they are, and the columns of ``schema``: what a kernel makes of each row's ``inputs``.

    ``factory`` runs once a task and gives the kernel. Strings reach it as UTF-8 bytes, nulls as None. Narrow: no
    shuffle, and only these columns are read.
    """
    small_batches(df.sparkSession)
    added = StructType.fromDDL(schema)
    out = StructType([*(df.schema[c] for c in carry), *added.fields])
    names, types, kept = out.names, [to_arrow_type(f.dataType) for f in added.fields], len(carry)
    more = [c for c in inputs if c not in carry]  # what is carried anyway isn't sent twice
    places = [carry.index(c) if c in carry else kept + more.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = factory()
        for batch in batches:
            columns = [(c.cast(pa.binary()) if pa.types.is_string(c.type) else c).to_pylist() for c in map(batch.column, places)]
            rows = list(zip(*map(kernel, *columns), strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(x, t) for x, t in zip(rows, types, strict=True))], names=names)
        give_back()

    return df.select(*(F.col(f"`{c}`") for c in carry), *(F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(more))).mapInArrow(run, out)


def map_texts(df: DataFrame, schema: str, factory: Callable[[], Callable[[bytes | None], tuple]], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``map_rows`` for one id and one text column."""
    return map_rows(df, [id_col], [text_col], schema, factory)


def set_aside(df: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """The table with those of its columns renamed that an operator needs the names of; and all columns, named back."""
    own = {c: f"own_{k}_{c}" if c in taken else c for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), [F.col(f"`{n}`").alias(c) for c, n in own.items()]


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that has each key once, however many rows of ``left`` one key has.

    Keys with more than half a partition's share of the rows are fewer than twice the partitions, so their rows of
    ``right`` are broadcast; all others are joined as usual.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).count().filter(F.col("count") > max(100, total // (2 * parts))).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key))
