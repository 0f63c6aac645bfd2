"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are reduced to distinct ones, so exact copies never meet in a join. The trie of the sorted fingerprints is
joined with itself: node pairs are traversed together, differing bits add up, and a pair is left as soon as it exceeds
the error budget. Of two fingerprints with at most k differing bits, one of their h halves of 64-bit words has at most
k/h of them; so the trie is joined h times, each time with another half in front and the budget k/h for its 32 bits, and
k for all. A node pair whose leaves are in one component already is left too, which keeps dense groups of near copies
from costing all their pairs.

``near_duplicates`` has the fingerprints of its contract: 64 bits, 4-word shingles, 4 bits. ``deduplicated`` has 128
bits and ``WIDE`` words; its budget of ``WIDE_BITS`` is what two texts with a Jaccard similarity of 0.8 differ in (19.4
bits expected) and nearly one standard deviation. It has ``WIDE_PARTS`` parts of 16 bits, of which one has two errors at
most, so no pair within the budget is missed. That many bits are loose, so a second look follows: texts have a sketch of
their shingles (the least hash in each of ``BINS`` bins), and in each component the pairs whose sketches agree in
``SIMILAR`` or more of their bins are the links that count. Tests measure the share of pairs that are found and kept.

Scale: the first levels of the traversal are a shuffle. Each fingerprint goes to its own node at depth d, and to the
nodes within the half's budget whose number is larger; d grows with the number of fingerprints, so that a node holds
about ``NODE_SIZE``. What a node receives, its own keys and its visitors, is counted; beyond ``BLOCK_SIZE`` both are
split into blocks that meet pairwise, so no task holds a hot node as a whole. Tasks return a star for each of their
components, never all pairs. Keys of joins with more than their share of the rows are joined apart (``spread_join``).

Null and empty texts have no words and the fingerprint zero, which is linked like any other. Documents with null ids
get their component's smallest id, null if it has none. Repeated rows are exact copies; rows with one id and different
texts are different documents.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .spark_util import checkpointed, give_back, map_rows, set_aside, spread_join, stored

WIDTH, SEED, MOST_BITS = 4, 42, 4
#: Words of a shingle, differing bits of 128, and the parts that these are looked up by, in ``deduplicated``.
WIDE, WIDE_BITS, WIDE_PARTS = 5, 23, 8
#: Bins of a sketch, the share of them that agree in similar texts, and rows of a component that are compared in one task.
BINS, SIMILAR, LOOKED_AT = 256, 0.76, 8192
NODE_SIZE, BLOCK_SIZE = 32_768, 65_536
#: Rows of split nodes that are broadcast: there is one for ``BLOCK_SIZE`` arrivals at most.
MOST_SPLIT = 1_000_000
#: Shingles that are hashed at once, and fingerprint pairs that are compared at once.
PIECE, COMPARED = 200_000, 200_000
#: Node pairs that are traversed at once.
NODE_PAIRS = 40_000
#: Node pairs of this many fingerprint pairs or fewer are compared directly.
LEAF = 64
#: The least hash of a bin without any.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For each byte, its bits in the bytes of a 64-bit number: 255 of them can be added without a carry.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()


def fingerprint(text: bytes | None, width: int = WIDTH, words: int = 1, bins: int = 0) -> tuple:
    """The majority bits of the shingles' hashes, as signed 64-bit words; 0 without words. One word: XXH64; two: XXH3-128.

    With bins, a sketch follows: a byte for each, of the least hash of the shingles that fall in it, and 0 without any.
    """
    import xxhash

    found = text.lower().split() if text else []
    if not found:
        return (0,) * words + ((bytes(bins),) if bins else ())
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(found) - width + 1)]
    ends, digest = ends[min(width, len(found)) - 1 :], xxhash.xxh64_digest if words == 1 else xxhash.xxh3_128_digest
    size = 8 * words
    ones, least = np.zeros((size, 8), np.int64), np.full(bins, NONE)
    for i in range(0, len(starts), PIECE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist(), strict=True)])
        if bins:
            own = np.frombuffer(hashes, ">u8")[:: size // 8].astype(np.uint64)
            np.minimum.at(least, (own % np.uint64(bins)).astype(np.int64), own // np.uint64(bins))
        bits = SPREAD[np.frombuffer(hashes, np.uint8).reshape(-1, size)[:, ::-1]]
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).reshape(-1, size, 8).sum(axis=0, dtype=np.int64)
    sketch = np.where(least == NONE, 0, 1 + least % np.uint64(255)).astype(np.uint8).tobytes()
    return (*np.packbits(2 * ones.ravel() > len(starts), bitorder="little").view(np.int64).tolist(), *((sketch,) if bins else ()))


def fingerprints(docs: DataFrame, carry: list[str], width: int = WIDTH, words: int = 1, bins: int = 0) -> DataFrame:
    """The ``carry`` columns, and fp, fp1 ...: a column for each word; and sketch, with bins."""
    schema = ", ".join([*(f"{name} bigint" for name in word_names(words)), *(["sketch binary"] if bins else [])])
    return map_rows(docs, carry, ["text"], schema, lambda: lambda text: fingerprint(text, width, words, bins))


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


class TrieJoin:
    """The trie of sorted keys: a node is a range of them that share their first bits."""

    def __init__(self, keys: np.ndarray, rest: np.ndarray, most: int, half: int, front: int = 32) -> None:
        """keys: sorted; rest: [word, key] the fingerprints' other words. most: differing bits of the whole; half: of the ``front`` first ones."""
        self.keys, self.rest, self.most, self.half, self.front = keys, rest, most, half, front
        self.root = np.arange(len(keys))

    def _merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join the components of linked keys."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            parent = np.arange(len(self.keys))
            np.minimum.at(parent, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.root = parent[self.root]

    def _compare(self, a0, a1, b0, b1) -> None:
        """All key pairs of small node pairs, some at a time."""
        sizes = (a1 - a0) * (b1 - b0)
        upto = np.cumsum(sizes)
        cuts = np.searchsorted(upto, np.arange(COMPARED, upto[-1] + COMPARED, COMPARED))
        for lo, hi in zip([0, *(cuts[:-1] + 1)], np.minimum(cuts + 1, len(sizes)), strict=True):
            n = sizes[lo:hi]
            if not len(n):
                continue
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat((b1 - b0)[lo:hi], n)
            i, j = np.repeat(a0[lo:hi], n) + k // wide, np.repeat(b0[lo:hi], n) + k % wide
            x = self.keys[i] ^ self.keys[j]
            near = np.flatnonzero((np.bitwise_count(x >> np.uint64(64 - self.front)) <= self.half) & (i != j))
            i, j, bits = i[near], j[near], np.bitwise_count(x[near])
            for word in self.rest:
                bits = bits + np.bitwise_count(word[i] ^ word[j])
            near = bits <= self.most
            self._merge(i[near], j[near])

    def _split(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the keys with the next bit set begin."""
        bit = np.uint64(1) << np.uint64(63 - depth)
        first = (self.keys[lo] & ~(bit | (bit - np.uint64(1)))) | bit
        return np.clip(np.searchsorted(self.keys, first), lo, hi)

    def run(self, a0, a1, b0, b1, errors, depth: int) -> None:
        """Traverse node pairs of one depth, depth first, in bounded pieces."""
        stack = [(depth, a0, a1, b0, b1, errors)]
        while stack:
            depth, a0, a1, b0, b1, errors = stack.pop()
            if len(a0) > NODE_PAIRS:
                for i in range(0, len(a0), NODE_PAIRS // 2):
                    stack.append((depth, *(x[i : i + NODE_PAIRS // 2] for x in (a0, a1, b0, b1, errors))))
                continue
            changes = np.concatenate(([0], np.cumsum(self.root[1:] != self.root[:-1])))
            one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (self.root[a0] == self.root[b0])
            open_ = (a1 > a0) & (b1 > b0) & ~one
            small = open_ & (((a1 - a0) * (b1 - b0) <= LEAF) | (depth == 64))
            if small.any():
                self._compare(a0[small], a1[small], b0[small], b1[small])
            wide = open_ & ~small
            if not wide.any():
                continue
            a0, a1, b0, b1, errors = (x[wide] for x in (a0, a1, b0, b1, errors))
            am, bm, same = self._split(a0, a1, depth), self._split(b0, b1, depth), a0 == b0
            left, right = (a0, am, b0, bm, errors), (am, a1, bm, b1, errors)
            cross, back = (a0, am, bm, b1, errors + 1), tuple(x[~same] for x in (am, a1, b0, bm, errors + 1))
            budget = self.half if depth < self.front else self.most
            ahead = [np.concatenate(x) for x in zip(left, right, cross, back, strict=True)]
            ok = (ahead[1] > ahead[0]) & (ahead[3] > ahead[2]) & (ahead[4] <= budget)
            if ok.any():
                stack.append((depth + 1, *(x[ok] for x in ahead)))


#: What meets in a task: a whole node; two blocks of its own keys; a block of its own keys and one of its visitors.
WHOLE, OWN, VISITED = 0, 1, 2


def joined_node(keys: np.ndarray, rest: np.ndarray, home: np.ndarray, kind: int, depth: int, most: int, half: int, front: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Stars (place of a key, place of its root) of what a node's keys and its visitors link."""
    order = np.argsort(keys, kind="stable")
    keys, home = keys[order], home[order]
    join = TrieJoin(keys, rest[:, order], most, half, front)
    nodes = keys >> np.uint64(64 - depth) if depth else np.zeros(len(keys), np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
    ends = np.append(starts[1:], len(keys))
    if home.any():
        at = int(np.flatnonzero(home[starts])[0])
        own = np.full(len(starts), starts[at]), np.full(len(starts), ends[at])
        errors = np.bitwise_count(nodes[starts] ^ nodes[starts[at]]).astype(np.int64)
        mine = np.arange(len(starts)) == at
        for part in (mine,) * (kind != VISITED) + (~mine,) * (kind != OWN):
            join.run(starts[part], ends[part], own[0][part], own[1][part], errors[part], depth)
    moved = np.flatnonzero(join.root != np.arange(len(keys)))
    return order[moved], order[join.root[moved]]


def split_nodes(keyed: DataFrame, own: Column, masks: list[int]) -> DataFrame:
    """turn, node, and in how many blocks its own keys and its visitors are split, for nodes that receive more than ``BLOCK_SIZE``."""
    sizes = checkpointed(keyed.groupBy("turn", own.alias("own")).count())
    arrivals = sizes.select("turn", "own", "count", F.explode(F.array(*map(F.lit, masks))).alias("mask")).select("turn", F.col("own").bitwiseXOR(F.col("mask")).alias("node"), "own", "count").filter("node >= own")
    is_own = F.col("node") == F.col("own")
    both = arrivals.groupBy("turn", "node").agg(F.sum(F.when(is_own, F.col("count")).otherwise(0)).alias("n_own"), F.sum(F.when(is_own, 0).otherwise(F.col("count"))).alias("n_visitors"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SIZE).cast("int")
    return both.filter(F.col("n_own") + F.col("n_visitors") > BLOCK_SIZE).select("turn", "node", blocks("n_own").alias("own_blocks"), blocks("n_visitors").alias("visitor_blocks"))


def links(distinct: DataFrame, most: int = MOST_BITS, words: int = 1, parts: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints that differ in ``most`` bits or fewer.

    distinct: the words' columns and ``key_id``, which names a fingerprint in the links. parts: of equal length, over all
    words (halves of words, if not given); each is in front in a turn, with its share of the budget.
    """
    parts = parts or 2 * words
    names, count = word_names(words), distinct.count()
    half, front = most // parts, 64 * words // parts
    depth = min(24, front, max(0, int(np.ceil(np.log2(max(1, count) / NODE_SIZE)))))
    masks = [sum(1 << b for b in bits) for n in range(min(half, depth) + 1) for bits in combinations(range(depth), n)]
    turned = lambda n, by: F.shiftleft(n, by).bitwiseOR(F.shiftrightunsigned(n, 64 - by)) if by else F.col(n)
    turns = [F.struct(F.lit(64 // front * w + k).alias("turn"), turned(n, front * k).alias("key"), *(F.col(x).alias(f"rest{i}") for i, x in enumerate(y for y in names if y != n))) for w, n in enumerate(names) for k in range(64 // front)]
    keyed = distinct.select("key_id", F.explode(F.array(*turns)).alias("x")).select("key_id", "x.*")
    own = F.shiftrightunsigned("key", 64 - depth).cast("int") if depth else F.lit(0)
    sent = keyed.withColumn("own", own).withColumn("node", F.explode(F.array(*map(F.lit, masks)))).withColumn("node", F.col("own").bitwiseXOR(F.col("node"))).filter("node >= own").withColumn("home", F.col("node") == F.col("own")).drop("own")
    split = checkpointed(split_nodes(keyed, own, masks))
    pairs, n_split = ["turn", "node"], split.count()
    if n_split:
        block = lambda n: F.pmod(F.xxhash64("key_id"), F.greatest(F.col(n), F.lit(1))).cast("int")
        upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        pair = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
        mine, theirs = block("own_blocks"), block("visitor_blocks")
        home = F.concat(F.transform(upto("own_blocks"), lambda j: pair(F.least(j, mine), F.greatest(j, mine), OWN)), F.transform(upto("visitor_blocks"), lambda j: pair(mine, j, VISITED)))
        away = F.transform(upto("own_blocks"), lambda i: pair(i, theirs, VISITED))
        one = F.array(pair(F.lit(0), F.lit(0), WHOLE))
        met = F.when(F.col("own_blocks").isNull(), one).when(F.col("home"), home).otherwise(away)
        sent = sent.join(F.broadcast(split) if n_split <= MOST_SPLIT else split, ["turn", "node"], "left").withColumn("pair", F.explode(met)).drop("own_blocks", "visitor_blocks")
        pairs = [*pairs, "pair"]

    def join(table: pa.Table) -> pa.Table:
        unsigned = lambda name: table.column(name).to_numpy().view(np.uint64)
        rest = np.array([unsigned(f"rest{k}") for k in range(words - 1)], np.uint64).reshape(words - 1, table.num_rows)
        kind = table.column("pair")[0].as_py()["kind"] if "pair" in table.column_names else WHOLE
        a, b = joined_node(unsigned("key"), rest, table.column("home").to_numpy(zero_copy_only=False), kind, depth, most, half, front)
        ids = table.column("key_id").to_numpy()
        if table.num_rows > NODE_SIZE:
            give_back()
        return pa.table({"a": ids[a], "b": ids[b]})

    return sent.groupBy(*pairs).applyInArrow(join, "a bigint, b bigint")


def rooted(groups: DataFrame, linked: DataFrame) -> DataFrame:
    """key_id, best and root of all groups; those without links are their own roots."""
    roots = components(linked).withColumnRenamed("node", "key_id")
    return checkpointed(groups.select("key_id", "best").join(roots, "key_id", "left").select("key_id", "best", F.coalesce("root", "key_id").alias("root")))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (hex) and component_id, the smallest doc_id that links lead to."""
    prints = stored(fingerprints(docs, ["doc_id"]), "fingerprints")
    groups = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("best")).withColumn("key_id", F.col("fp")))
    found = rooted(groups, links(groups, most))
    least = found.groupBy("root").agg(F.min("best").alias("best"))
    found = spread_join(found.select("key_id", "root"), least, "root").select(F.col("key_id").alias("fp"), F.col("best").alias("component_id"))
    joined = spread_join(prints, found, "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def agreeing(sketches: np.ndarray, one: int, others: np.ndarray, similar: float) -> np.ndarray:
    """Which of the others' sketches agree with one in that share of the bins that either has; empty ones agree."""
    own, far = sketches[one], sketches[others]
    same = ((own == far) & (own > 0)).sum(axis=1)
    return same >= similar * ((own > 0) | (far > 0)).sum(axis=1)


def looked_at(sketches: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars (place, place of its root) of all similar sketches: a reached one is compared with those not reached yet only."""
    root, waiting = np.arange(len(sketches)), np.arange(len(sketches))
    while len(waiting):
        first, waiting = waiting[0], waiting[1:]
        ahead = [first]
        while ahead and len(waiting):
            near = agreeing(sketches, ahead.pop(), waiting, similar)
            root[waiting[near]] = first
            ahead += waiting[near].tolist()
            waiting = waiting[~near]
    moved = np.flatnonzero(root != np.arange(len(sketches)))
    return moved, root[moved]


def similar_links(found: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links ``a``, ``b`` that connect the similar sketches of each component. found: key_id, root, sketch.

    Components of more than ``LOOKED_AT`` rows are split into blocks that meet pairwise, so no task holds one as a whole.
    """
    sizes = found.groupBy("root").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / LOOKED_AT).cast("int")
    own = F.pmod(F.xxhash64("key_id"), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    sent = spread_join(found, checkpointed(sizes), "root").select("root", "key_id", "sketch", F.explode(pair).alias("pair"))

    def look(table: pa.Table) -> pa.Table:
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        a, b = looked_at(sketches, similar)
        ids = table.column("key_id").to_numpy()
        return pa.table({"a": ids[a], "b": ids[b]})

    return sent.groupBy("root", "pair").applyInArrow(look, "a bigint, b bigint")


def deduplicated(docs: DataFrame, most: int = WIDE_BITS, similar: float = SIMILAR, width: int = WIDE) -> DataFrame:
    """One row of each component, in the columns of ``docs``: that with the smallest id; null ids come last.

    Links are between texts whose fingerprints are in one component at ``most`` bits and whose sketches are ``similar``.
    Every row is a document of its own, whatever its id: of rows with one id and different texts, each stays that no
    other is like.
    """
    own, back = set_aside(docs, ("fp", "fp1", "sketch", "row_place"))
    placed = own.withColumn("row_place", F.monotonically_increasing_id())
    prints = stored(fingerprints(placed, placed.columns, width, 2, BINS), "fingerprints")
    rows = prints.select("fp", "fp1", "sketch", "row_place", F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_place").alias("rank"))
    groups = rows.groupBy("fp", "fp1", "sketch").agg(F.min("rank").alias("best")).withColumn("key_id", F.monotonically_increasing_id())
    groups = stored(groups, "groups")  # written, so that these names stay
    loose = components(links(groups.select("key_id", "fp", "fp1"), most, 2, WIDE_PARTS)).withColumnRenamed("node", "key_id")
    linked = similar_links(loose.join(groups.select("key_id", "sketch"), "key_id"), similar)
    least = rooted(groups, linked).groupBy("root").agg(F.min("best").alias("best"))
    gone = stored(rows.select("row_place").join(least.select(F.col("best.row_place").alias("row_place")), "row_place", "left_anti"), "copies")
    return prints.join(gone, "row_place", "left_anti").select(*back)
