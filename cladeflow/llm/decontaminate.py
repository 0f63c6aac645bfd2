"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training texts stream through the automaton; the longest matching lengths mark every word inside an occurrence of an
item's window. Windows are ``window`` consecutive words, or the whole item where it is shorter.

Scale: the texts stay where they are (no shuffle, one pass). The items are a stated query set; their words are counted
first, and sets beyond ``BLOCK_WORDS`` are matched in blocks, one automaton in memory at a time.

Null, empty and word-less texts have no words and no hits. Items without words match nothing; an item without an id
marks words, but is not listed. Repeated ids count once. Texts are read as a whole, however long they are. Of the items'
table only ``item_id`` and ``text`` are read, so other columns can't clash. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .spark_util import checkpointed, map_rows, set_aside, words

#: Words of test items in one automaton, which takes about 1 KB a word.
BLOCK_WORDS = 200_000
WINDOW = 10
#: In ``decontaminated``: a text goes if this share of its words or more is hit; else only the spans go.
MOST_COVERAGE = 0.5
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SCHEMA = "n_words bigint, spans array<bigint>, items array<string>"


class ItemIndex:
    """The automaton of a block of items, and which items own which window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> None:
        self.window = window
        self.automaton = a = SuffixAutomaton()
        self.ids: list[str | None] = []
        for item_id, text in items:
            if found := words(text):
                a.add(found)
                self.ids.append(item_id)
        self.least = min([window, *map(len, a.sequences)])
        self.owners: dict[int, set[int]] = {}
        self.shorts: dict[int, list[tuple[int, int]]] = {}
        for k, sequence in enumerate(a.sequences):
            state = 0
            for n, state in enumerate(a.walk(sequence), 1):
                if n >= window:
                    self.owners.setdefault(a.up(state, window), set()).add(k)
            if len(sequence) < window:
                self.shorts.setdefault(state, []).append((len(sequence), k))
        #: The nearest state with short items, from a state upwards; its own included.
        self.near = [-1] * len(a.next)
        for state in a.top_down() if self.shorts else ():
            self.near[state] = state if state in self.shorts else self.near[a.link[state]]

    def hits(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint spans of hit words (from, to), in order, and the items that own the windows."""
        a, window, spans, items = self.automaton, self.window, [], set()
        for i, state, length in a.matches(a.encode(text), self.least) if a.sequences else ():
            begin = i + 1
            if length >= window:
                items |= self.owners[a.up(state, window)]
                begin = i + 1 - length
            at = self.near[state]
            while at > 0:
                for n, k in self.shorts[at]:
                    if n <= length:
                        items.add(k)
                        begin = min(begin, i + 1 - n)
                at = self.near[a.link[at]] if a.link[at] > 0 else -1
            if begin <= i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items in blocks of about ``block_words`` words at most; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.size(F.split("text", SEPARATORS)))).first()[0] or 0
    count = 1 + total // block_words
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield [(r[0], None if r[1] is None else r[1].encode()) for r in rows]


def passages(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The ``carry`` columns of docs with n_words, spans (word offsets: from, to, from, to ...) and items (ids)."""
    spark, out = docs.sparkSession, None
    blocks = item_blocks(benchmark, block_words)
    block, after = next(blocks), next(blocks, None)
    while block is not None:
        index = spark.sparkContext.broadcast(ItemIndex(block, window))

        def factory(index=index):
            own = index.value

            def kernel(text, spans=None, items=None):
                found = words(text)
                new, owners = own.hits(found)
                both = merged([*new, *zip(*[iter(spans or ())] * 2, strict=True)])
                ids = {own.ids[k] for k in owners} - {None} | {x.decode() if isinstance(x, bytes) else x for x in items or ()}
                return len(found), [x for span in both for x in span], sorted(ids)

            return kernel

        more = after is not None
        kept = [*carry, *(["text"] if more and "text" not in carry else [])]
        if out is None:
            out = map_rows(docs, kept, ["text"], SCHEMA, factory)
        else:
            out = map_rows(out.drop("n_words"), [c for c in kept if c in out.columns], ["text", "spans", "items"], SCHEMA, factory)
        if more:
            out = checkpointed(out)
        block, after = after, next(blocks, None) if more else None
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    flat = F.col("spans")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size(flat) - 1), F.lit(0).cast("bigint"), lambda acc, i: acc + F.when(i % 2 == 1, F.get(flat, i)).otherwise(-F.get(flat, i)))
    return passages(docs, benchmark, ["doc_id"], window, block_words).select(
        "doc_id",
        "n_words",
        F.when(F.size(flat) > 0, n_hit).otherwise(F.lit(0).cast("bigint")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size(flat) > 0).alias("contaminated"),
    )


def without_spans(text: bytes | None, spans: list[int]) -> str | None:
    """The text without the words of these spans; what stands around a span is joined by one space."""
    if text is None or not spans:
        return None if text is None else text.decode()
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[a][0]].rstrip())
        last = at[b - 1][1]
    return b" ".join([*out, text[last:].lstrip()]).decode().strip()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """The documents without the test items' passages, in the columns of ``docs``.

    Spans that reach the window's length (or are a whole shorter item) are cut out of the text; a document of which
    ``most_coverage`` or more of the words are hit goes as a whole. ``n_chars``, where there is one, follows the text.
    Documents without hits stay exactly as they are.
    """
    own, back = set_aside(docs, ("n_words", "spans", "items"))
    found = passages(own, benchmark, own.columns, window)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("bigint"), lambda acc, i: acc + F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    kept = found.filter((F.size("spans") == 0) | (hit < F.lit(most_coverage) * F.col("n_words")))
    cut = map_rows(kept, [c for c in own.columns if c != "text"], ["text", "spans"], "text string", lambda: lambda text, spans: (without_spans(text, spans),))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return cut.select(*back)
