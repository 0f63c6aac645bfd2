"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents carry the labels; words don't. So labelled tokens are made first: a greedy cover picks the words and word
beginnings that explain the toxic training documents and that clean ones hardly have, and the tokens with them are
labelled toxic. The chain is trained on windows around such tokens and on windows of clean documents. Its features are
hashed: the word, its beginnings and its endings. For a text, the forward-backward marginals of the chain over each
line give the toxic words and their offsets; a document's score is the chance that any word is toxic, calibrated on the
training documents to their labels.

Scale: the model is fitted on the driver to a bounded sample (``SAMPLE`` documents a class, of ``LONGEST`` characters
at most) and sent as a broadcast of fixed size. Scoring is narrow: one pass, no shuffle, memory bounded by a batch.

Null and empty texts score the chance of a document without any toxic word. Without training documents of both labels
every score is 0. Of several labels for an id the largest holds. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spark_util import WORD_TABLE, give_back, set_aside, small_batches, stored

#: Training documents of each label, and the longest text that is trained on.
SAMPLE, LONGEST = 2000, 30_000
BUCKETS = 1 << 18
#: Words to each side of a labelled token in a training window.
REACH = 8
#: Training windows around the labelled tokens of one document.
WINDOWS = 3
#: A cue must explain this many toxic documents that no other does, in as many contexts, and be this many times as frequent in toxic documents as in clean ones.
LEAST_GAIN, LEAST_RATIO = 4, 6.0
#: Cues that the cover doesn't need count too, from this many contexts and times on: too often for chance.
SURE_CONTEXTS, SURE_RATIO = 25, 50.0
THRESHOLD = 0.3
#: Training texts that are scored together.
SCORED = 200
#: As between words, but line breaks stay.
LINE_TABLE = bytes(10 if c == 10 else x for c, x in enumerate(WORD_TABLE))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Marginals below this don't count towards a document, however many there are.
LEAST_MARGINAL = 0.05


def lines(text: bytes | None) -> list[list[bytes]]:
    """The lower-case words of each line."""
    return [x.split() for x in text.decode().lower().encode().translate(LINE_TABLE).split(b"\n")] if text else []


def cues(word: bytes) -> list[str]:
    """The word itself and its beginnings of 4 to 7 letters."""
    w = word.decode(errors="replace").lower()
    return [w, *(f"{w[:n]}*" for n in range(4, min(8, len(w) + 1)))]


#: A word's features: itself, its beginnings of 3 to 7 bytes, and its endings of 2 to 4.
BEGINNINGS, ENDINGS = range(3, 8), range(2, 5)
FEATURES = 1 + len(BEGINNINGS) + len(ENDINGS)
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def feature_ids(words: pa.Array) -> np.ndarray:
    """[word, feature]: the hashed features of distinct words, all words at once; 0 where a word is too short for one."""
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else np.zeros(0, np.uint8)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    begin, end = bounds[:-1], bounds[1:]
    out = np.zeros((len(words), FEATURES), np.int64)

    def put(column: int, hashes: np.ndarray, long: np.ndarray) -> None:
        x = (hashes + np.uint64(column + 1)) * MIX
        x = (x ^ (x >> np.uint64(32))) * MIX
        out[long, column] = 1 + ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS - 1)).astype(np.int64)[long]

    def rolled(sizes: range, first: int, at) -> None:
        """Hashes of a growing number of bytes, the next one at ``at(k)``."""
        hashes = np.zeros(len(words), np.uint64)
        for k in range(sizes.stop - 1):
            long = end - begin > k
            hashes = hashes * FACTOR + np.where(long, letters[np.where(long, at(k), begin)] if len(letters) else 0, 0).astype(np.uint64) + np.uint64(1)
            if k + 1 in sizes:
                put(first + k + 1 - sizes.start, hashes, long)

    if len(words):
        powers = np.cumprod(np.full(int((end - begin).max()), FACTOR))
        place = np.arange(bounds[0], bounds[-1]) - np.repeat(begin, end - begin)
        whole = np.add.reduceat(letters[bounds[0] : bounds[-1]].astype(np.uint64) * powers[place], begin - bounds[0])
        put(0, whole, np.full(len(words), True))
        rolled(BEGINNINGS, 1, lambda k: begin + k)
        rolled(ENDINGS, 1 + len(BEGINNINGS), lambda k: end - 1 - k)
    return out


def token_cues(toxic: list[list[bytes]], clean: list[list[bytes]]) -> set[str]:
    """Greedy cover of the toxic documents by cues that clean documents hardly have."""
    in_toxic = Counter(c for doc in toxic for c in {c for w in set(doc) for c in cues(w)})
    in_toxic = Counter({c: n for c, n in in_toxic.items() if n >= LEAST_GAIN})
    in_clean = Counter(c for doc in clean for c in {c for w in set(doc) for c in cues(w)} if c in in_toxic)
    scale = len(clean) / max(1, len(toxic))
    strong = {c for c, n in in_toxic.items() if n * scale >= LEAST_RATIO * (in_clean[c] + 0.1)}
    where: dict[str, set[int]] = {c: set() for c in strong}
    contexts: dict[str, set[tuple[bytes, bytes]]] = {c: set() for c in strong}
    for k, doc in enumerate(toxic):
        for before, w, after in zip([b"", *doc], doc, [*doc[1:], b""], strict=False):
            for cue in strong.intersection(cues(w)):
                where[cue].add(k)
                contexts[cue].add((before, after))
    usable = {c: d for c, d in where.items() if len(contexts[c]) >= LEAST_GAIN}
    worth = {c: math.log(len(d) * scale / (in_clean[c] + 0.1)) for c, d in usable.items()}
    chosen: set[str] = set()
    open_ = set(range(len(toxic)))
    while usable:
        gains = {c: len(d & open_) for c, d in usable.items()}
        best = max(gains, key=lambda c: (gains[c] * worth[c], -len(c), c))
        if gains[best] < LEAST_GAIN:
            break
        chosen.add(best)
        open_ -= usable.pop(best)
        usable = {c: d for c, d in usable.items() if gains[c] >= LEAST_GAIN}
    return chosen | {c for c, d in where.items() if min(len(contexts[c]), len(d)) >= SURE_CONTEXTS and len(d) * scale >= SURE_RATIO * (in_clean[c] + 0.1)}


@dataclass
class Chain:
    """Two tags. ``weights``: for the toxic tag, by feature; ``step[a, b]``: from tag a to tag b; ``start``: of the first tag."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of each word. ``scores``: of the toxic tag, rows of ``lengths`` one after the other."""
        if not len(scores):
            return scores
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        long = lengths[order]
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")  # rows longer than t
        s, ahead, back = self.step, np.empty(len(scores)), np.empty(len(scores))
        for t, n in enumerate(active):
            at = begin[:n] + t
            ahead[at] = scores[at] + (self.start[1] - self.start[0] if t == 0 else np.logaddexp(s[0, 1], s[1, 1] + last[:n]) - np.logaddexp(s[0, 0], s[1, 0] + last[:n]))
            last = ahead[at]
        nxt = np.zeros(len(long))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            deeper = active[t + 1] if t + 1 < len(active) else 0
            at = begin[:n] + t
            value = np.zeros(n)
            e = nxt[:deeper]
            value[:deeper] = np.logaddexp(s[1, 0], s[1, 1] + e) - np.logaddexp(s[0, 0], s[0, 1] + e)
            back[at] = value
            nxt[:n] = value + scores[at]
        return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        raw = np.clip(raw, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(raw / (1 - raw)) + self.shift)))


def raw_score(marginals: np.ndarray) -> float:
    """The chance that any word is toxic."""
    high = marginals[marginals >= LEAST_MARGINAL]
    return float(-np.expm1(np.log1p(-np.minimum(high, 1 - 1e-9)).sum())) if len(high) else float(marginals.max(initial=0.0))


def fit_chain(rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 80, rate: float = 0.5, penalty: float = 1e-6) -> Chain:
    """Maximum likelihood by AdaGrad over all windows at once. rows: (features of each word, tag of each word)."""
    count, longest = len(rows), max(len(y) for _, y in rows)
    x, y, mask = np.zeros((count, longest, FEATURES), np.int64), np.zeros((count, longest), np.int64), np.zeros((count, longest))
    for k, (features, tags) in enumerate(rows):
        x[k, : len(tags)], y[k, : len(tags)], mask[k, : len(tags)] = features, tags, 1
    weights, step, start = np.zeros(BUCKETS), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-8) for v in (weights, step, start)]
    rows_ = np.arange(count)
    for _ in range(steps):
        weights[0] = 0  # the empty feature
        e = np.zeros((count, longest, 2))
        e[..., 1] = weights[x].sum(axis=2)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(a[:, t - 1, :1] + step[0], a[:, t - 1, 1:] + step[1]) + e[:, t]
            a[:, t] = np.where(mask[:, t, None] > 0, new, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            into = e[:, t + 1] + b[:, t + 1]
            new = np.stack([np.logaddexp(step[i, 0] + into[:, 0], step[i, 1] + into[:, 1]) for i in (0, 1)], axis=1)
            b[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = np.logaddexp(a[:, 0, 0] + b[:, 0, 0], a[:, 0, 1] + b[:, 0, 1])
        p = np.exp(a + b - z[:, None, None]) * mask[..., None]
        residual = (p[..., 1] - y * mask) / count
        g_w = np.bincount(x.ravel(), np.repeat(residual.ravel(), FEATURES), BUCKETS) + penalty * weights
        g_step = np.zeros((2, 2))
        both = mask[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                pair = np.exp(np.minimum(a[:, :-1, i] + step[i, j] + e[:, 1:, j] + b[:, 1:, j] - z[:, None], 0)) * both
                g_step[i, j] = (pair.sum() - ((y[:, :-1] == i) & (y[:, 1:] == j) & (both > 0)).sum()) / count
        g_start = p[:, 0].mean(axis=0) - np.bincount(y[rows_, 0], minlength=2) / count
        for value, grad, total in zip((weights, step, start), (g_w, g_step, g_start), sums, strict=True):
            total += grad * grad
            value -= rate * grad / np.sqrt(total)
    weights[0] = 0
    return Chain(weights.astype(np.float32), step, start)


def _windows(doc: list[bytes], tags: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[int, int]]:
    """Around some labelled tokens; and one anywhere."""
    at = np.flatnonzero(tags)
    for i in rng.permutation(at)[:WINDOWS].tolist():
        yield max(0, i - REACH), min(len(doc), i + REACH + 1)
    begin = int(rng.integers(0, max(1, len(doc) - 3 * REACH)))
    yield begin, min(len(doc), begin + 3 * REACH)


def train(texts: list[bytes], toxic: list[int], weights: tuple[float, float] = (1.0, 1.0)) -> Chain | None:
    """Label tokens, fit the chain, and calibrate. weights: how many documents one clean and one toxic sample stand for."""
    docs = [[w for line in lines(x) for w in line] for x in texts]
    y = np.array(toxic)
    if not y.any() or y.all():
        return None
    chosen = token_cues([d for d, t in zip(docs, toxic, strict=True) if t], [d for d, t in zip(docs, toxic, strict=True) if not t])
    rng, windows, tagged = np.random.default_rng(7), [], {}
    for doc, t in zip(docs, toxic, strict=True):
        for w in doc if t else ():
            if w not in tagged:
                tagged[w] = not chosen.isdisjoint(cues(w))
        tags = np.array([tagged[w] for w in doc] if t else [0] * len(doc), np.int64)
        for a, b in _windows(doc, tags, rng) if doc else ():
            windows.append((doc[a:b], tags[a:b]))
    coded = pa.array([w for x, _ in windows for w in x], pa.large_binary()).dictionary_encode()
    features, ends = feature_ids(coded.dictionary)[coded.indices.to_numpy()], np.cumsum([len(x) for x, _ in windows])
    chain = fit_chain([(features[end - len(x) : end], y) for end, (x, y) in zip(ends.tolist(), windows, strict=True)])
    scorer = Scorer(chain)
    raw = np.clip([raw_score(p) for i in range(0, len(texts), SCORED) for p, _ in scorer.batch(texts[i : i + SCORED])], 1e-6, 1 - 1e-6)
    chain.slope, chain.shift = logistic(np.log(raw / (1 - raw)), y, np.where(y == 1, weights[1], weights[0]))
    return chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small penalty on the slope."""
    beta, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    weight = weight / weight.sum() * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + np.array([0.1, 0.01]) * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 0.01])
        move = np.linalg.solve(hess, grad)
        beta -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Scorer:
    """Marginals of the texts of a batch; each distinct word is weighed once."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain

    def batch(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, int]]:
        """For each text the marginals of its words."""
        rows = [lines(x) for x in texts]
        coded = pa.array([w for doc in rows for line in doc for w in line], pa.large_binary()).dictionary_encode()
        scores = self.chain.weights[feature_ids(coded.dictionary)].sum(axis=1, dtype=np.float64)[coded.indices.to_numpy()]
        p = self.chain.marginals(scores, np.array([len(line) for doc in rows for line in doc if line], np.int64))
        ends = np.cumsum([sum(map(len, doc)) for doc in rows])
        return [(p[a:b], b - a) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    """The chain for a bounded sample of the labelled documents that aren't held out; chosen by a hash of the id.

    Only labelled documents of up to ``LONGEST`` characters can be drawn, so labels without such a one take no place. Of
    several texts with one id the smallest is taken.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= LONGEST)
    known = stored(known.join(own.select("doc_id").distinct(), "doc_id"), "labelled")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # a row for each label
    if not counts.get(0) or not counts.get(1):
        return None
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    rows = own.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    drawn = [sum(r["toxic"] == t for r in rows) for t in (0, 1)]
    return train([r["text"].encode() for r in rows], [r["toxic"] for r in rows], (counts[0] / drawn[0], counts[1] / drawn[1]))


def offsets(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets of runs of toxic words, in time linear in the text."""
    at, out = [m.span() for m in WORD.finditer(text)], []
    first = np.frombuffer(text, np.uint8) & 0xC0 != 0x80  # of each character's bytes
    before = np.concatenate(([0], np.cumsum(first))).tolist()
    for i in np.flatnonzero(hit).tolist():
        a, b = (before[x] for x in at[i])
        if out and i and hit[i - 1]:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
    return out


def scored(docs: DataFrame, chain: Chain | None, carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The ``carry`` columns (doc_id), score, predicted, and the character offsets of the toxic spans."""
    spark = docs.sparkSession
    small_batches(spark)
    kept = carry or ["doc_id"]
    model = spark.sparkContext.broadcast(chain)
    added = StructType.fromDDL("score double, predicted int, spans array<struct<start: bigint, end: bigint>>")
    schema = StructType([*(docs.schema[c] for c in kept), *added.fields])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value) if model.value else None
        for batch in batches:
            texts = batch.column(kept.index("text") if "text" in kept else len(kept)).cast(pa.binary()).to_pylist()
            found = [p for p, _ in scorer.batch(texts)] if scorer else [np.zeros(0)] * len(texts)
            scores = model.value.calibrated(np.array([raw_score(p) for p in found])) if scorer else np.zeros(len(texts))
            spans = [offsets(x, p >= 0.5) if len(p) and p.max() >= 0.5 else [] for x, p in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, span_type)], names=schema.names)
        give_back()

    own = [] if "text" in kept else [F.col("text").cast("string").alias("scored_text")]  # what is carried anyway isn't sent twice
    return docs.select(*(F.col(f"`{c}`") for c in kept), *own).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, spans."""
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, in the columns of ``docs``."""
    own, back = set_aside(docs, ("score", "predicted", "spans", "scored_text"))
    return scored(own, fit(docs, labels), own.columns).filter("predicted = 0").select(*back)
