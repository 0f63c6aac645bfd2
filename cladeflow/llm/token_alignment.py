"""Cross-tokenizer alignment with corpus-wide link counts, by external spill counting.

Two tokenizers cut a text into tokens A and B; where their byte ranges overlap there is a link. A link's count is the
number of documents that hold its pair of ids. One pass over the texts finds each document's links and spills them:

1. Records (pair, document, links) are gathered up to ``RUN_RECORDS``, sorted by pair and document, dealt out by a radix of
   the A id, and written as zstd runs to the shared folder. A document is in one run, so a run knows how many of its
   documents hold a pair: runs are pre-aggregated, and a pair that all documents have is one entry a run.
2. The pair lists of up to ``FAN_IN`` runs of a radix are merged by a heap, in rounds, until a radix has one. They are in
   A-major order, so an A id's highest count is known as soon as the next A id comes, while the list is streamed.
3. Each run looks its pairs up in its radix's list and sends each of its documents their sums; records themselves are
   never shuffled.

Both tokenizers cut before a space behind a character that is none and before one that is no white space, so a text is
cut there, and the links of usual parts are kept. Long texts are cut into parts all the same, in pieces.

Scale: what moves is pair lists and sums. Radixes hold A ids by a hash; a hot id is one entry a run and pair. Lists of
all radixes are broadcast up to ``MOST_BYTES``, else they are dealt out by radix and a salt of the run.

Null and empty texts, and texts that a tokenizer doesn't give back (U+2581 becomes a space), have no tokens: zeros and an
empty ``groups_sha256``. Repeated rows and ids are documents of their own. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .piece_codec import SPACE, default_model
from .spark_util import give_back, small_batches, stored

#: Records of a run, radixes, runs that are merged at once, and bytes of pair lists that are broadcast.
RUN_RECORDS, RADIXES, FAN_IN, MOST_BYTES = 1 << 20, 64, 64, 64 << 20
#: A pair is one number: the A id before this many bits of the B id.
B_BITS = 24
#: Parts of texts whose links a Python process keeps (twice as many at most), the characters of the longest, and
#: characters of a text that are cut at once.
MOST_PARTS, LONGEST, PIECE_CHARS = 200_000, 64, 1_000_000
#: Letters before this one are Latin.
MOST_LATIN = "\u0250"
#: What a task makes: a row for each document, and a row for each run and radix.
MADE = "run bigint, slot int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, radix int, pairs binary, records binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: What a part of a text has: how many tokens A and B, groups and links, the pairs of its links as 64-bit numbers, and
#: its groups as text, each with a semicolon behind.
Part = tuple[int, int, int, int, bytes, bytes]
NO_PART: Part = (0, 0, 0, 0, b"", b"")


class Aligner:
    """Texts to links."""

    #: Before a space that no space is before and no white space behind.
    CUT = re.compile(r"(?<=[^ ])(?= \S)")

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        byte = dict(zip([chr(b) for b in plain] + [chr(256 + k) for k in range(256 - len(plain))], [*plain, *(b for b in range(256) if b not in plain)], strict=True))
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.b.get_piece_size())]
        self.merge = self._merger()
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        most = max(len(self.length_a), len(self.length_b))
        self.comma, self.bar, self.end = ([b"%d%s" % (i, c) for i in range(most)] for c in (b",", b"|", b";"))
        texts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        #: Neighbours within B's pieces, and single signs that no word of A goes on with: their ids in A and B.
        self.pairs = {t[k : k + 2] for t in texts for k in range(len(t) - 1)}
        self.signs = {c: (self.a.token_to_id(c), self.b.piece_to_id(c)) for c in ".,;:!?"}
        self.new: dict[str, Part | None] = {}
        self.old: dict[str, Part | None] = {}

    def _merger(self) -> Callable[[str], list[int]]:
        """Words to ids, where a pair's rank is the id it merges into (else by the whole tokenizer)."""
        import tiktoken

        whole = lambda p: self.a.encode(p, add_special_tokens=False).ids
        merges = json.loads(self.a.to_str())["model"]["merges"]
        vocabulary = self.a.get_vocab()
        ranked = [vocabulary["".join(m)] for m in merges]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        if ranked != sorted(ranked) or any(len(b) == 1 and i > ranked[0] for i, b in self.bytes_a.items()):
            return whole
        ranks = {self.bytes_a[i]: i for t, i in vocabulary.items() if t not in special}
        try:
            words = tiktoken.Encoding("words", pat_str=r" ?\p{L}+", mergeable_ranks=ranks, special_tokens={})
        except ValueError:
            return whole
        return words.encode_ordinary

    def parts(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers cut; few cuts of very long texts are left out."""
        whole, out, at = " " + text, [], 0
        while at < len(whole):
            cut = self.CUT.search(whole, at + PIECE_CHARS) if len(whole) - at > PIECE_CHARS else None
            end = cut.start() if cut else len(whole)
            piece = whole[at:end]
            words = piece.split(" ")
            if words[0] == "" and "" not in words[1:] and not re.search(r" \s", piece):
                out += [" " + w for w in words[1:]]
            else:
                out += self.CUT.split(piece)
            at = end
        return out

    def _ids_a(self, parts: list[str]) -> list[list[int]]:
        """A space and Latin letters are one word of A, which only merges; all else goes through the whole tokenizer."""
        out: list[list[int] | None] = [self.merge(p) if p[1:].isalpha() and p < MOST_LATIN and max(p) < MOST_LATIN else None for p in parts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, coded in zip(rest, self.a.encode_batch_fast([parts[k] for k in rest], add_special_tokens=False) if rest else (), strict=True):
            out[k] = coded.ids
        return out

    def _parts(self, parts: list[str]) -> list[Part | None]:
        """Several parts at once; None where the tokens don't give a part back.

        Between two ends of tokens that follow each other there is one token of A and one of B, and each link is once
        such a place; where an A and a B token end together, a group ends.
        """
        coded_a, coded_b = self._ids_a(parts), self.b.encode([p[1:] for p in parts])
        sizes = np.array([len(p.encode()) for p in parts], np.int64)
        whole = [b"".join(map(self.bytes_a.__getitem__, a)) == p.encode() == b"".join(map(self.bytes_b.__getitem__, b)) for p, a, b in zip(parts, coded_a, coded_b, strict=True)]
        if not all(whole):
            coded_a, coded_b = ([x if ok else [] for x, ok in zip(coded, whole, strict=True)] for coded in (coded_a, coded_b))
            sizes = np.where(whole, sizes, 0)
        n_a, n_b = np.array([len(a) for a in coded_a], np.int64), np.array([len(b) for b in coded_b], np.int64)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(c), np.int64, int(n.sum())) for c, n in ((coded_a, n_a), (coded_b, n_b)))
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        ends = np.union1d(ends_a, ends_b)
        pairs = ids_a[np.searchsorted(ends_a, ends)] << B_BITS | ids_b[np.searchsorted(ends_b, ends)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        part_ends = np.cumsum(sizes)
        links, groups = (np.diff(np.searchsorted(x, part_ends, "right"), prepend=0) for x in (ends, cuts))
        # tokens in the order of the groups' text, each with the sign behind it
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        last_a, last_b = np.isin(ends_a, cuts, assume_unique=True), np.isin(ends_b, cuts, assume_unique=True)
        order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable").tolist()
        tables = [(self.comma, self.bar), (self.comma, self.end)]
        words = [t[k][i] for ids, last, t in ((ids_a, last_a, tables[0]), (ids_b, last_b, tables[1])) for i, k in zip(ids.tolist(), last.tolist(), strict=True)]
        words = list(map(words.__getitem__, order))
        raw, at_pair, at_word, out = pairs.astype("<i8").tobytes(), 0, 0, []
        for ok, a, b, n_groups, n in zip(whole, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(), strict=True):
            out.append((a, b, n_groups, n, raw[8 * at_pair : 8 * (at_pair + n)], b"".join(words[at_word : at_word + a + b])) if ok else None)
            at_pair, at_word = at_pair + n, at_word + a + b
        return out

    def look_up(self, parts: list[str]) -> list[Part | None]:
        """What different parts have; the ones that are new are encoded together.

        A is cut between a letter and a sign, and B where no piece has both; such a part is its word's, and the sign.
        """
        if len(self.new) >= MOST_PARTS:
            self.old, self.new = self.new, {}
        missing, signed, seen, extra = [], [], set(), {}
        new, old, signs, pairs = self.new, self.old, self.signs, self.pairs
        for p in parts:
            if p in new:
                continue
            if p in old:
                new[p] = old[p]
                continue
            if p[-1] in signs and p[-2].isalpha() and p[-2:] not in pairs:
                signed.append(p)
                p = p[:-1]
                if p in new:
                    continue
                if p in old:
                    new[p] = old[p]
                    continue
            if p not in seen:
                seen.add(p)
                missing.append(p)
        for p, found in zip(missing, self._parts(missing) if missing else (), strict=True):
            (new if len(p) <= LONGEST else extra)[p] = found
        for p in signed:
            word = new[p[:-1]] if p[:-1] in new else extra[p[:-1]]
            if word is None:
                extra[p] = None
                continue
            a, b = signs[p[-1]]
            n_a, n_b, n_groups, n, raw, text = word
            (new if len(p) <= LONGEST else extra)[p] = n_a + 1, n_b + 1, n_groups + 1, n + 1, raw + (a << B_BITS | b).to_bytes(8, "little"), text + b"%d|%d;" % (a, b)
        return [new[p] if p in new else extra[p] for p in parts]


@dataclass
class Aligned:
    """A batch of texts: a row for each, and records (slot, pair, links) sorted by slot and pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    slot: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(values, starts) if len(keys) else values


def aligned(texts: list[str | None], aligner: Aligner) -> Aligned:
    parts_of = [aligner.parts(t) if t and SPACE not in t else [] for t in texts]
    sizes = np.array([len(p) for p in parts_of], np.int64)
    coded = pa.array([p for parts in parts_of for p in parts], pa.large_string()).dictionary_encode()
    codes, found = coded.indices.to_numpy(zero_copy_only=False), aligner.look_up(coded.dictionary.to_pylist())
    bad = np.array([f is None for f in found], bool)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if bad.any():  # these texts have no tokens at all
        out = np.isin(owner, owner[bad[codes]])
        codes, owner = codes[~out], owner[~out]
    values = [f or NO_PART for f in found]
    counts = np.array([v[:4] for v in values], np.int64).reshape(-1, 4)
    totals = [np.bincount(owner, counts[codes, k], len(texts)).astype(np.int64) for k in range(4)]
    ends, strings, groups = np.searchsorted(owner, np.arange(len(texts) + 1)), [v[5] for v in values], []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        text = b"".join([strings[c] for c in codes[lo:hi].tolist()])[:-1]
        groups.append(hashlib.sha256(text).hexdigest() if text else "")
    lengths, width = counts[:, 3], max(1, len(values))
    begin = np.cumsum(lengths) - lengths
    pairs, place = np.unique(np.frombuffer(b"".join([v[4] for v in values]), "<i8"), return_inverse=True)
    used, often = np.unique(owner * width + codes, return_counts=True)
    slot, code = np.divmod(used, width)
    n = lengths[code]
    at = np.repeat(begin[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    keys, times = summed(np.repeat(slot, n) * max(1, len(pairs)) + place[at], np.repeat(often, n))
    slot, which = np.divmod(keys, max(1, len(pairs)))
    return Aligned(*totals, groups, slot, pairs[which] if len(pairs) else keys, times)


@lru_cache(maxsize=1)
def aligner_for(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python process: loading both models, and learning the usual parts, is most of its cost."""
    return Aligner(path_a, path_b)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one zstd frame; the first one is sorted and kept by its differences."""
    import zstandard

    first, *others = (np.asarray(c, np.int64) for c in columns)
    raw = b"".join([np.array([len(first), *(len(c) for c in others)], "<i8").tobytes(), np.diff(first, prepend=0).astype("<i8").tobytes(), *(c.astype("<i8").tobytes() for c in others)])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(frame: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), "<i8")
    out = np.split(numbers[columns:], np.cumsum(numbers[: columns - 1]))
    return [np.cumsum(out[0]), *out[1:]]


def radix_of(pairs: np.ndarray) -> np.ndarray:
    a = (pairs >> B_BITS).astype(np.uint64)
    return (a * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % RADIXES


def runs_of(pair: np.ndarray, slot: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pair list, records) of gathered records: pairs with how many documents hold them; documents and links in that order."""
    order = np.lexsort((slot, pair, radix_of(pair)))
    pair, slot, times = pair[order], slot[order], times[order]
    radix = radix_of(pair)
    cuts = np.searchsorted(radix, np.arange(RADIXES + 1))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if hi > lo:
            pairs, counts = np.unique(pair[lo:hi], return_counts=True)
            yield k, packed(pairs, counts), packed(slot[lo:hi], times[lo:hi])


def spilled(docs: DataFrame, path_a: str, path_b: str, run_records: int) -> DataFrame:
    """``MADE`` and doc_id, written to the shared folder: rows of documents (without radix), and of runs."""
    small_batches(docs.sparkSession)
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(MADE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number, held, slots = aligner_for(path_a, path_b), TaskContext.get().partitionId() << 32, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            for radix, pairs, records in runs_of(*(np.concatenate(x) for x in zip(*held, strict=True))):
                nulls = [pa.nulls(1, f) for f in (id_type, pa.int32(), *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([nulls[0], pa.array([number], pa.int64()), *nulls[1:], pa.array([radix], pa.int32()), pa.array([pairs], pa.binary()), pa.array([records], pa.binary())], names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            found, n = aligned(batch.column(1).to_pylist(), aligner), batch.num_rows
            held.append((found.pair, found.slot + slots, found.times))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, number)), pa.array(np.arange(slots, slots + n, dtype=np.int32)), *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(found.groups), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=schema.names)
            slots += n
            if sum(len(h[0]) for h in held) >= run_records:
                yield from full()
                held, slots, number = [], 0, number + 1
        if any(len(h[0]) for h in held):
            yield from full()
        give_back()

    return stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "alignment")


def merged(lists: list[bytes], last: bool) -> bytes:
    """One sorted pair list of several, by a heap; the last one of a radix also marks the pairs with their A id's highest count."""
    streams = [zip(*(x.tolist() for x in unpacked(frame, 2)), strict=True) for frame in lists]
    pairs, counts, best = [], [], []
    start = 0
    for pair, count in heapq.merge(*streams):
        if pairs and pairs[-1] == pair:
            counts[-1] += count
            continue
        if last and pairs and pairs[-1] >> B_BITS != pair >> B_BITS:  # the A id before is complete
            most = max(counts[start:])
            best += [c == most for c in counts[start:]]
            start = len(pairs)
        pairs.append(pair)
        counts.append(count)
    if not last:
        return packed(np.array(pairs), np.array(counts))
    most = max(counts[start:])
    best += [c == most for c in counts[start:]]
    return packed(np.array(pairs), np.array(counts), np.array(best))


def pair_lists(made: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """radix and list: each radix's pairs with their counts, and whether they are their A id's best."""
    rows = made.filter("radix is not null").select("radix", "run", F.col("pairs").alias("list"))
    count = rows.select("run").distinct().count()
    while True:
        parts = -(-count // fan_in)
        last = parts <= 1
        grouped = rows.groupBy("radix", F.pmod(F.xxhash64("run"), F.lit(max(1, parts))).alias("run")).agg(F.collect_list("list").alias("lists"))  # about fan_in runs

        def run(batches: Iterator[pa.RecordBatch], last: bool = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([merged(x, last) for x in batch.column(2).to_pylist()], pa.binary())], names=["radix", "run", "list"])

        rows = stored(grouped.mapInArrow(run, "radix int, run bigint, list binary"), "pairs")
        if last:
            return rows.select("radix", "list")
        count = parts


def contributions(made: DataFrame, lists: DataFrame, salts: int = 16) -> DataFrame:
    """run, slot, n_best and count_sum: what each run and radix adds to its documents."""
    runs = made.filter("radix is not null").select("run", "radix", "pairs", "records")
    if (lists.agg(F.sum(F.length("list"))).first()[0] or 0) <= MOST_BYTES:
        both = runs.join(F.broadcast(lists), "radix")
    else:
        salted = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = runs.withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int")).join(salted, ["radix", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[np.ndarray]] = {}  # the lists of the radixes, which a task meets again and again

        def sums(number: int, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            slots, times, both = (np.concatenate(x) for x in zip(*rows, strict=True))
            width = int(slots.max()) + 1
            best, count = np.zeros(width, np.int64), np.zeros(width, np.int64)
            np.add.at(best, slots, times * (both & 1))
            np.add.at(count, slots, times * (both >> 1))
            own = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(own.astype(np.int32)), pa.array(best[own]), pa.array(count[own])], names=["run", "slot", "n_best", "count_sum"])

        current, rows = None, []
        for batch in batches:
            for number, radix, pairs, records, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != current and rows:
                    yield sums(current, rows)
                    rows = []
                current = number
                if radix not in known:
                    if len(known) >= RADIXES // 4:
                        known.clear()
                    known[radix] = unpacked(found, 3)
                (own, n), (slots, times), (listed, counts, best) = unpacked(pairs, 2), unpacked(records, 2), known[radix]
                at = np.searchsorted(listed, own)
                rows.append((slots, times, np.repeat(counts[at] << 1 | best[at], n)))
        if rows:
            yield sums(current, rows)

    return both.select("run", "radix", "pairs", "records", "list").mapInArrow(run, "run bigint, slot int, n_best bigint, count_sum bigint")


def alignments(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None, run_records: int = RUN_RECORDS, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = spilled(docs, tokenizer_a or default_tokenizer(), model_b or default_model(), run_records)
    added = contributions(made, pair_lists(made, fan_in)).groupBy("run", "slot").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = made.filter("radix is null").join(added, ["run", "slot"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
