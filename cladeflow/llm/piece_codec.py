"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For BPE the last token of each prefix of a text is unique: a token that ends there is the one if the prefix before it
ends in a token that is compatible with it, which is when merging the two tokens' characters gives just these two.
An automaton of all pieces gives the tokens that end at each place, longest first; the table keeps the one that fits,
and the ids are recovered backwards from the end. This takes one pass over the text, whatever its length, where merging
by a queue takes time that grows faster.

Compatibility is read off the pieces' merge trees: the right edge of the first and the left edge of the second are
walked together in the order of merging, and no pair that is adjacent at some time may merge before both have moved on.

The normaliser of such a model puts a space in front and turns spaces into U+2581, which is all that is supported here
(others are refused). No piece has U+2581 behind another character, so a text is cut before each run of them, every
part has its own table, and the ids of usual parts are kept. A character that no piece has becomes its bytes' pieces.

Scale: narrow, no shuffle. Long texts are read in pieces; a part without spaces is a table of its own length.

``encoded`` gives an empty list of ids for null and empty texts; ``decoded`` gives the empty text for them. Repeated
rows and ids are kept as they are; extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .spark_util import BATCH_ROWS, RecentWords, give_back, small_batches

SPACE, UNKNOWN_TEXT = "▁", " ⁇ "
#: Characters of a text that are split at once, and compatibility answers that are kept.
PIECE_CHARS, MOST_PAIRS = 1_000_000, 2_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a BPE model: texts, ranks, kinds, and how each piece is merged from two others."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its table only
        count = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(count)]
        self.sizes, self.unknown = [len(t) for t in self.text], model.unk_id()
        byte = [i for i in range(count) if model.is_byte(i)]
        self.byte = {int(self.text[i][3:-1], 16): i for i in byte}
        self.control = {i for i in range(count) if model.is_control(i)}
        plain = [i for i in range(count) if not (model.is_byte(i) or i in self.control or model.is_unknown(i) or model.is_unused(i))]
        if model.normalize(" A  b ﬁ") != f"{SPACE * 2}A{SPACE * 2}b ﬁ":
            raise ValueError("only models whose normaliser changes nothing but spaces are supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", self.text[i]) for i in plain) or any(model.is_unused(i) for i in range(count)):
            raise ValueError("pieces with an inner space mark, or unused ones, are not supported")
        self.id = {self.text[i]: i for i in plain}
        #: Neighbours within pieces: no token spans two other characters.
        self.pairs = {t[k : k + 2] for t in self.id for k in range(len(t) - 1)}
        self.rank = {i: -model.get_score(i) for i in plain}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Pieces whose own merging isn't in the order of ranks; for these compatibility is found by merging.
        self.odd: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            steps: list[tuple[float, int, int, int]] = []
            if self.merged(self.text[i], steps) != [i]:
                continue  # no text ever ends up as this piece
            ranks = [s[0] for s in steps]
            if ranks != sorted(ranks):
                self.odd.add(i)
            if steps:
                self.parts[i] = steps[-1][1:3]
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        often = Counter(self.rank[i] for i in self.parts)
        self.odd |= {i for i in self.parts if often[self.rank[i]] > 1}
        below = True
        while below:  # what is merged from an odd piece is odd
            below = {i for i, p in self.parts.items() if i not in self.odd and not self.odd.isdisjoint(p)}
            self.odd |= below

    def merged(self, text: str, steps: list | None = None) -> list[int]:
        """The pieces of a short text by plain merging: the best rank first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            found = [(self.rank[self.id[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id]
            if not found:
                return [self.id.get(p, -1) for p in parts]
            rank, k = min(found)
            if steps is not None:
                steps.append((rank, self.id[parts[k]], self.id[parts[k + 1]], k))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the characters of ``a`` and ``b`` in a row merge into just these two."""
        if a in self.odd or b in self.odd:
            return self.merged(self.text[a] + self.text[b]) == [a, b]
        # (piece, rank at which it goes into the next one) along the edges that meet, from the last merge inwards
        x, y, x_end, y_end = a, b, float("inf"), float("inf")
        while True:
            joined = self.id.get(self.text[x] + self.text[y])
            if joined is not None and self.rank[joined] < x_end and self.rank[joined] <= y_end:
                return False
            x_start = self.rank[x] if x in self.parts else -1.0
            y_start = self.rank[y] if y in self.parts else -1.0
            if x_start < 0 and y_start < 0:
                return True
            if x_start >= y_start:  # of both, the one that was merged last is undone
                x, x_end = self.parts[x][1], x_start
            else:
                y, y_end = self.parts[y][0], y_start


class PieceEncoder:
    """Texts to ids."""

    RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    CUT = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]")

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.known = RecentWords(self._part)
        self.fits: dict[int, bool] = {}

    def _compatible(self, a: int, b: int) -> bool:
        if len(self.fits) >= MOST_PAIRS:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self.pieces.compatible(a, b)
        return found

    def table(self, part: str) -> list[int]:
        """The last token of each prefix (of one or more characters), -1 where a character has no piece."""
        last, fits, end_of = [-1] * (len(part) + 1), self.fits.get, self.pieces.automaton.iter
        for at, (token, size) in end_of(part):
            at += 1
            if last[at] < 0:
                before = last[at - size]
                if before < 0:  # nothing is before, or bytes
                    last[at] = token
                else:
                    fit = fits(before << 32 | token)
                    if self._compatible(before, token) if fit is None else fit:
                        last[at] = token
        return last

    def _part(self, part: str) -> bytes:
        """The ids of one part, as 32-bit integers. A last character that no piece has behind the one before is a token of
        its own, so the part is looked up without it."""
        if len(part) > 2 and part[-2:] not in self.pieces.pairs:
            return (self.known.often.get(part[:-1]) or self.known.missed(part[:-1])) + self._part(part[-1])
        last, at, back, sizes = self.table(part), len(part), [], self.pieces.sizes
        while at:
            token = last[at]
            if token < 0:
                back += [self.pieces.byte.get(b, self.pieces.unknown) for b in reversed(part[at - 1].encode())]
                at -= 1
            else:
                back.append(token)
                at -= sizes[token]
        back.reverse()
        return array("i", back).tobytes()

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The text with a space in front, in parts that begin with their run of spaces."""
        at = 0
        while at < len(text):
            cut = self.CUT.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
            end = cut.start() if cut else len(text)
            piece = text[at:end].replace(" ", SPACE)
            whole = piece if at else SPACE + piece
            if SPACE * 2 in whole:
                yield self.RUNS.findall(whole)
            else:
                yield [SPACE + w for w in whole[1:].split(SPACE)]
            at = end

    def __call__(self, text: str | None) -> bytes:
        """All ids of a text, as 32-bit integers."""
        out, often, missed = [], self.known.often.get, self.known.missed
        for parts in self._parts(text or ""):
            out += [often(p) or missed(p) for p in parts]
        return b"".join(out)


class PieceDecoder:
    """Ids to text."""

    def __init__(self, path: str) -> None:
        pieces = Pieces(path)
        of_byte = {i: bytes([b]) for b, i in pieces.byte.items()}
        self.table = [of_byte.get(i, b"" if i in pieces.control else t.replace(SPACE, " ").encode()) for i, t in enumerate(pieces.text)]
        self.table[pieces.unknown] = UNKNOWN_TEXT.encode()
        self.last_silent = max(pieces.control, default=-1)
        self.silent, self.spaced = pieces.control, {i for i, t in enumerate(pieces.text) if t.startswith(SPACE)}

    def __call__(self, ids: list[int]) -> str:
        if not ids or min(ids) > self.last_silent or self.silent.isdisjoint(ids):
            return self._text(ids, bool(ids) and ids[0] in self.spaced)
        out: list[str] = []
        for silent, run in groupby(ids, self.silent.__contains__):  # bytes on both sides of a silent piece make no character
            if not silent:
                own = list(run)
                out.append(self._text(own, not out and own[0] in self.spaced))
        return "".join(out)

    def _text(self, ids: list[int], spaced: bool) -> str:
        found = b"".join(map(self.table.__getitem__, ids))[spaced:]
        try:
            return found.decode()
        except UnicodeDecodeError:
            return self._repaired(found)

    @staticmethod
    def _repaired(found: bytes) -> str:
        """Each byte that is not part of a character becomes U+FFFD."""
        out, at = [], 0
        while at < len(found):
            try:
                out.append(found[at:].decode())
                break
            except UnicodeDecodeError as e:
                out += [found[at : at + e.start].decode(), "�"]
                at += e.start + 1
        return "".join(out)


@lru_cache(maxsize=1)
def encoder_for(path: str) -> PieceEncoder:
    """One for all tasks of a Python process: reading the model, and learning the usual parts, is most of its cost."""
    return PieceEncoder(path)


@lru_cache(maxsize=1)
def decoder_for(path: str) -> PieceDecoder:
    return PieceDecoder(path)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of integers) of every text."""
    small_batches(docs.sparkSession)
    path, schema = model or default_model(), StructType([docs.schema["doc_id"], *StructType.fromDDL("ids array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(path)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(k, BATCH_ROWS)
                found = [encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(found), "<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=schema.names)
        give_back()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _over_ids(tokens: DataFrame, carry: list[str], schema: str, factory: Callable[[], Callable[[list[int]], tuple]]) -> DataFrame:
    """The ``carry`` columns, and what a kernel makes of each row's ids."""
    small_batches(tokens.sparkSession)
    added = StructType.fromDDL(schema)
    out, kept = StructType([*(tokens.schema[c] for c in carry), *added.fields]), len(carry)
    types = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = factory()
        for batch in batches:
            ids = batch.column(kept).fill_null([])
            values, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy()).tolist()
            rows = [kernel(values[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)]
            columns = list(zip(*rows, strict=True)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=out.names)
        give_back()

    return tokens.select(*(F.col(f"`{c}`") for c in carry), F.col("ids").alias("in_ids")).mapInArrow(run, out)


def decoded(tokens: DataFrame, model: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (doc_id) and text: what the ids stand for."""
    path = model or default_model()

    def factory() -> Callable[[list[int]], tuple]:
        decode = decoder_for(path)
        return lambda ids: (decode(ids),)

    return _over_ids(tokens, ["doc_id"] if carry is None else carry, "text string", factory)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the text that the ids decode to)."""
    path = model or default_model()

    def factory() -> Callable[[list[int]], tuple]:
        decode = decoder_for(path)
        decimal = [str(i) for i in range(len(decode.table))]
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        return lambda ids: (len(ids), digest(",".join(map(decimal.__getitem__, ids))), digest(decode(ids)))

    return _over_ids(encoded(docs, model), ["doc_id"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", factory)
