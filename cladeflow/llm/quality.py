"""Quality rules under weak supervision: rules vote or abstain, and a label model weighs their votes.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation over the counts of the vote
patterns of all documents estimates each rule's accuracy, how often it abstains, and how many documents are of which
class; the posterior probability of good quality, not a chain of must-pass rules, decides. So one bad vote of a rule
that the others contradict doesn't drop a document, and several abstentions that usually go with bad votes can.

Scale: the statistics are computed in one narrow pass and written once. Vote patterns are counted with partial sums on
the map side; at most ``3 ** len(RULES)`` of them reach the driver, whatever the corpus's size.

Null, empty and word-less texts have no words: they fail the base rule. Repeated rows count, and are judged, one by one.
A posterior of exactly ``LEAST_POSTERIOR`` keeps a document.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import map_texts, stored

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
WINDOW = 5
LEAST_POSTERIOR = 0.5
#: Every rule is taken to be right this often, when the estimation begins; what it ends with is free.
FIRST_ACCURACY = 0.7
#: Documents that a rule's first accuracy counts for in each class, and those that its overall share of abstentions does.
PRIOR, ABSTENTIONS = 1.0, 20.0
#: Base rule: fewer words, or a larger share (in per cent) of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_exclaims bigint, n_distinct bigint, n_same_next bigint"


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside windows that the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code = ids[:n].copy()
    size = distinct
    for k in range(1, WINDOW):
        if size > (1 << 62) // max(1, distinct):  # number the codes anew before they overflow
            seen, code = np.unique(code, return_inverse=True)
            size = len(seen)
        code = code * distinct + ids[k : n + k]
        size *= distinct
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes | None) -> tuple[int, ...]:
    found = (text or b"").split()
    if not found:
        return 0, 0, len(text or b"") - len((text or b"").translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (
        len(found),
        len(text.translate(None, SPACES).decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"!"),
        len(numbers),
        int((ids[1:] == ids[:-1]).sum()),
    )


def _rule(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def _share(part: str, whole: str, good: float, bad: float) -> Column:
    """Votes good up to one share and bad from another, and abstains between them."""
    x = F.try_divide(F.col(part), F.col(whole))
    return _rule(x, x <= good, x >= bad)


def _word_length(mean: Column) -> Column:
    return _rule(mean, mean.between(3.5, 6.5), ~mean.between(3, 7))


def _variety(share: Column) -> Column:
    return _rule(share, share >= 0.5, share < 0.3)


#: The rules, by name. Division by zero gives null, on which a rule abstains.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _rule(F.col("n_words"), F.col("n_words") >= 40, F.col("n_words") < LEAST_WORDS),
    "word_length": lambda: _word_length(F.try_divide(F.col("word_chars"), F.col("n_words"))),
    "symbols": lambda: _share("n_symbols", "n_words", 0.02, 0.1),
    "repetition": lambda: _share("n_repeat_words", "n_words", 0.05, 0.15),
    "copied_lines": lambda: _share("n_dup_lines", "n_lines", 0.05, 0.2),
    "shouting": lambda: _share("n_upper", "word_chars", 0.05, 0.15),
    "exclamations": lambda: _share("n_exclaims", "n_words", 0.02, 0.05),
    "stutter": lambda: _share("n_same_next", "n_words", 0.02, 0.05),
    "variety": lambda: _variety(F.try_divide(F.col("n_distinct"), F.col("n_words"))),
}
#: Rules that look for one kind of bad quality: their votes go together, so each kind is a class of its own.
KINDS = [("repetition", "copied_lines", "shouting", "exclamations", "stutter", "variety"), ("symbols", "word_length"), ("length",)]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, and ``votes``: a string with a digit for each rule (0 bad, 1 abstains, 2 good)."""
    with_stats = map_texts(docs, SCHEMA, lambda: lambda text: statistics(text))
    votes = F.concat(*((rule() + 1).cast("string") for rule in RULES.values()))
    return stored(with_stats.withColumn("votes", votes), "quality")


def label_model(patterns: dict[str, int], kinds: list[tuple[int, ...]], rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes, and P(vote | class) by class, rule and vote (bad, none, good).

    Class 0 is good. Rules for one kind of bad quality agree with each other and not with the rest, so each kind (the
    numbers of its rules) has a class. All accuracies begin at ``FIRST_ACCURACY``: on documents of its own kind a rule
    votes bad that often, on all others it votes good that often. From there they are free, and agreement decides.
    Pseudo-counts only hold what the corpus has no documents for.
    """
    votes = np.array([[int(c) for c in p] for p in patterns])
    counts = np.array(list(patterns.values()), float)
    rules, classes = votes.shape[1], len(kinds) + 1
    silent = np.array([(counts[votes[:, k] == 1].sum() + 1) / (counts.sum() + 3) for k in range(rules)])
    first = np.full((classes, rules), 1 - FIRST_ACCURACY)  # P(bad | the rule votes)
    for c, kind in enumerate(kinds, 1):
        first[c, list(kind)] = FIRST_ACCURACY
    bad, none, shares = first, np.tile(silent, (classes, 1)), np.full(classes, 1 / classes)
    table = np.stack([bad * (1 - none), none, (1 - bad) * (1 - none)], axis=2)
    for _ in range(rounds):
        weight = posteriors(votes, shares, table) * counts[:, None]
        found = np.stack([[np.bincount(votes[:, k], weight[:, c], 3) for k in range(rules)] for c in range(classes)])
        bad = (found[..., 0] + PRIOR * first) / (found[..., 0] + found[..., 2] + PRIOR)
        none = (found[..., 1] + ABSTENTIONS * silent) / (found.sum(axis=2) + ABSTENTIONS)
        new = np.stack([bad * (1 - none), none, (1 - bad) * (1 - none)], axis=2)
        shares = (weight.sum(axis=0) + 1) / (counts.sum() + classes)
        moved, table = np.abs(new - table).max(), new
        if moved < 1e-10:
            break
    return shares, table


def posteriors(votes: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The probability of each class, by vote pattern and class."""
    logs = np.log(table)
    each = np.log(shares) + sum(logs[:, k, votes[:, k]].T for k in range(votes.shape[1]))
    weight = np.exp(each - each.max(axis=1, keepdims=True))
    return weight / weight.sum(axis=1, keepdims=True)


def kind_numbers() -> list[tuple[int, ...]]:
    names = list(RULES)
    return [tuple(map(names.index, kind)) for kind in KINDS]


def judged(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    stats = measured(docs)
    patterns = {r["votes"]: r["count"] for r in stats.groupBy("votes").count().collect()}  # 3 ** len(RULES) rows at most
    quality = F.lit(None).cast("double")
    if patterns:
        shares, table = label_model(patterns, kind_numbers())
        logs = [math.log(x) + sum(F.get(F.array(*map(F.lit, np.log(rule).tolist())), F.substring("votes", k + 1, 1).cast("int")) for k, rule in enumerate(of)) for x, of in zip(shares.tolist(), table, strict=True)]
        quality = 1 / sum(F.exp(x - logs[0]) for x in logs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= LEAST_POSTERIOR)).alias("kept"), quality.alias("quality"))
