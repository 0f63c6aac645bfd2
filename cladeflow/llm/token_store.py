"""Token ids in ORC: integer run-length encoded id lists, row indexes, and Bloom filters on the document ids.

``write_tokens`` range-partitions the documents by id, encodes them in id order and writes one ORC file a partition.
ORC keeps min/max and row indexes for each stripe and row group and a Bloom filter on ``doc_id``, so a reader skips
files, stripes and row groups from metadata alone, and reads stripes in parallel. ``read_tokens`` adds each document's
offset in the whole id stream: a prefix sum over the files' totals, plus the offset inside the file.

Scale: one shuffle (the range partitioning of the texts). Only a row for each file meets in the prefix sum.

Null and empty texts have only the end id. Null ids come first. Documents with equal ids stay, in the order
of a hash of their texts, by which they are also dealt out: no id is one task's, however many rows have it. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spark_util import fresh_path, give_back, small_batches

END_ID = 1
#: Rows between two entries of the row index, and bytes of a stripe.
INDEX_STRIDE, STRIPE_BYTES = 1000, 16 << 20
#: Words whose ids a Python process keeps: those that came back, and those seen once.
OFTEN_WORDS, ONCE_WORDS = 150_000, 150_000
#: Characters of a text that are encoded at once, which bounds the memory for very long texts.
PIECE_CHARS = 1_000_000
#: Words that are looked up together, and texts of a batch: the more, the fewer times a word is looked up.
FLUSH_WORDS, TEXTS = 200_000, 1000
#: What marks a text that isn't split here, and the place of the end id.
WHOLE, END = b" ", b" end"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class BatchEncoder:
    """Encodes texts with a tokenizers model, each distinct word once.

    Texts in Latin-1 without special tokens are lower-cased and split here, by the tokenizer's own pattern, and each
    distinct word goes through the tokenizer's model; in that range its other steps change nothing. Any other text goes
    through the whole tokenizer. Both give the same ids (tests compare them).
    """

    #: The tokenizer's split pattern, with its classes written out for lower-case Latin-1.
    SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+".encode("latin-1"))
    #: What plain prose has: letters, spaces, and single commas and full stops.
    PROSE = "abcdefghijklmnopqrstuvwxyzªµºßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ \t\n,.".encode("latin-1")
    PAIRS = (b"..", b",,", b".,", b",.")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in a byte-level vocabulary
        self.byte_level = dict(zip((b for b in range(256) if b not in plain), map(chr, range(256, 512)), strict=False))
        self.once: dict[bytes, bytes] = {}
        self.often: dict[bytes, bytes] = {}

    def __call__(self, texts: list[bytes | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's with the end id, and how many each text has."""
        counts, ids, words, owners = np.zeros(len(texts), np.int64), [], [], []
        for k, text in enumerate(texts):
            for piece in self._pieces(text):
                new = self._split(piece)
                words += new
                owners.append((k, len(new)))
                if len(words) > FLUSH_WORDS:
                    ids.append(self._flush(words, owners, counts, end_id))
            words.append(END)
            owners.append((k, 1))
        ids.append(self._flush(words, owners, counts, end_id))
        return np.concatenate(ids), counts

    def _pieces(self, text: bytes | None) -> Iterator[str]:
        """Very long texts in pieces that end before a space."""
        at, string = 0, text.decode() if text else ""
        while at < len(string):
            end = string.find(" ", at + PIECE_CHARS)
            end = len(string) if end < 0 else end
            yield string[at:end]
            at = end

    def _split(self, text: str) -> list[bytes]:
        """The words in Latin-1; or the whole text behind a space, which no word has."""
        try:
            low = text.lower().encode("latin-1")
        except UnicodeEncodeError:
            low = None
        if low is None or not text.isascii() and "İ" in text or "<|" in text and self.special.search(text):
            return [WHOLE + text.encode()]
        if not low.translate(None, self.PROSE) and not any(x in low for x in self.PAIRS):
            return low.replace(b",", b" , ").replace(b".", b" . ").split()
        return self.SPLIT.findall(low)

    def _ids(self, word: bytes) -> bytes:
        if word.startswith(WHOLE):
            return array("i", self.tokenizer.encode(word[1:].decode(), add_special_tokens=False).ids).tobytes()
        text = word.decode("latin-1")
        if not (text.isascii() and text.isprintable()):
            text = text.encode().decode("latin-1").translate(self.byte_level)
        return array("i", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _cached(self, word: bytes) -> bytes | None:
        """Words that come back in a later look-up are kept, the many that don't soon make room; END has no ids of its own."""
        if (known := self.often.get(word)) is not None:
            return known
        if word.startswith(WHOLE):
            return None if word == END else self._ids(word)
        if (known := self.once.pop(word, None)) is not None:
            if len(self.often) >= OFTEN_WORDS:
                self.often.clear()
            self.often[word] = known
            return known
        if len(self.once) >= ONCE_WORDS:
            self.once.clear()
        self.once[word] = known = self._ids(word)
        return known

    def _flush(self, words: list[bytes], owners: list[tuple[int, int]], counts: np.ndarray, end_id: int) -> np.ndarray:
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        at, own = coded.indices.to_numpy(), [self._cached(w) for w in coded.dictionary.to_pylist()]
        own = [array("i", [end_id]).tobytes() if x is None else x for x in own]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        begin = (np.cumsum(sizes) - sizes)[at]
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(b"".join(own), "<i4")
        ids = flat[np.repeat(begin - (ends - lengths), lengths) + np.arange(total)]
        docs, n = np.array(owners, np.int64).reshape(-1, 2).T
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]
        np.add.at(counts, docs, np.diff(upto))
        words.clear()
        owners.clear()
        return ids


@lru_cache(maxsize=1)
def encoder_for(path: str) -> BatchEncoder:
    """One encoder for all tasks of a Python process: loading it, and learning the usual words, is most of its cost."""
    return BatchEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> StructType:
    """Write the documents' ids to ORC files below ``path`` in ascending order of doc_id; returns the files' schema.

    Columns: doc_id, part (the file's place in the order), part_start (ids of the part's earlier documents), n_tokens
    and ids.
    """
    small_batches(docs.sparkSession, TEXTS)
    model = tokenizer or default_tokenizer()
    two = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("part int, part_start bigint, n_tokens bigint, ids array<int>").fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, encoder = TaskContext.get().partitionId(), 0, encoder_for(model)
        for batch in batches:
            ids, counts = encoder(batch.column(1).cast(pa.binary()).to_pylist(), end_id)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            values = pa.array(ids, pa.int32())
            starts = start + offsets[:-1].astype(np.int64)
            start += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(starts), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), values)], names=schema.names)
        give_back()

    options = {"orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": INDEX_STRIDE, "orc.stripe.size": STRIPE_BYTES, "compression": "zstd"}
    two.mapInArrow(encode, schema).write.options(**{k: str(v) for k, v in options.items()}).orc(path)
    return schema


def read_tokens(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids from the files."""
    rows = spark.read.schema(schema).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))  # a row for each file
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the ids as little-endian unsigned 32-bit integers."""
    small_batches(tokens.sparkSession)
    schema = StructType([*(tokens.schema[c] for c in ("doc_id", "start", "n_tokens")), *StructType.fromDDL("ids_crc32 bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], names=schema.names)

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, schema)


def token_index(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the ids, read the files back, and return doc_id, start, n_tokens and ids_crc32 from them."""
    path = fresh_path(docs.sparkSession, "tokens")
    return checksums(read_tokens(docs.sparkSession, path, write_tokens(docs, path, tokenizer)))
