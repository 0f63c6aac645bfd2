"""Token alignment, Merkle manifest and SentencePiece codec against plain forms and the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cladeflow.llm import merkle, piece_codec, token_alignment

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, pairs string, digest string, place string"
ODD = [None, "", " ", "  ", "\n", "<|endoftext|> x <|endoftext|>", "<s> </s> <0x41> <unk>", "a▁b", "it's we'll  don't \n x", "a" * 3000, "word " * 5000, " a  b ", "\x00 \x1c x \x85y", "漢字 😀é"]


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "w", "x", "y", "z") for i, t, lang in rows], DOCS)


def odd_texts(seed, count):
    rng = random.Random(seed)
    letters = "abcdeABCthe   \n\t.,'<>|0123456789éü漢😀▁ 　\x1c"
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(count))]


# SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())


@pytest.fixture(scope="module")
def encoder():
    return piece_codec.PieceEncoder(piece_codec.default_model())


def test_encoder_equals_library(library, encoder):
    texts = [*odd_texts(1, 4000), *(x for n in range(70) for x in (" " * n, "a" + " " * n + "b", "ab" * n, "\n" * n))]
    rng = random.Random(2)
    texts += ["".join(library.id_to_piece(rng.randrange(259, 32000)) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(encoder(text), "<i4").tolist() == library.encode(text or ""), text


def test_decoder_equals_library(library):
    decode, rng = piece_codec.PieceDecoder(piece_codec.default_model()), random.Random(3)
    for _ in range(8000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 12))]
        assert decode(ids) == library.decode(ids), ids


def test_pairs_are_compatible_where_merging_says_so(encoder):
    pieces, rng = encoder.pieces, random.Random(4)
    known = list(pieces.rank)
    words = ["▁" + "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    pairs = [(rng.choice(known), rng.choice(known)) for _ in range(3000)] + [p for w in words for i in [pieces.merged(w)] for p in zip(i, i[1:], strict=False)]
    pairs += [(pieces.id[w[:k]], pieces.id[w[k:]]) for w in list(pieces.id)[:4000] for k in range(1, len(w)) if w[:k] in pieces.id and w[k:] in pieces.id]
    for a, b in pairs:
        assert pieces.compatible(a, b) == (pieces.merged(pieces.text[a] + pieces.text[b]) == [a, b]), (pieces.text[a], pieces.text[b])


def test_long_texts_are_read_in_pieces(library, encoder, monkeypatch):
    monkeypatch.setattr(piece_codec, "PIECE_CHARS", 50)
    for text in odd_texts(5, 200) + ["lorem ipsum  dolor " * 200]:
        assert np.frombuffer(encoder(text), "<i4").tolist() == library.encode(text or "")


def test_round_trip_query(spark, library):
    texts = odd_texts(6, 100)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id", None), (3, texts[5], "en"), (3, texts[5], "en")]
    got = sorted(map(tuple, piece_codec.round_trip(frame(spark, rows)).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((library.decode(ids) if ids else "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piece_codec.round_trip(frame(spark, [])).count() == 0


# Merkle manifest


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(row, lower=False):
    low = str.maketrans(merkle.UPPER, merkle.LOWER)
    text = row["text"].translate(low) if lower and row["text"] is not None else row["text"]
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_steps(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 8
        out.append((level[start:at], level[at + 1 : start + 8]))
        at //= 8
    return out


def plain_proofs(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    ranked = {lang: sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r))) for lang in order}
    trees = {lang: plain_tree([plain_leaf(r) for r in ranked[lang]]) for lang in order}
    above, out = plain_tree([trees[lang][-1][0] for lang in order]), []
    for k, lang in enumerate(order):
        for at, row in enumerate(ranked[lang]):
            steps = plain_steps(trees[lang], at) + plain_steps(above, k)
            folded = plain_leaf(row, row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0)
            for left, right in steps:
                folded = digest(*left, folded, *right)
            root = above[-1][0]
            out.append((row["doc_id"], plain_leaf(row), trees[lang][-1][0], root, digest(*(x for s in steps for x in s[0] + s[1])), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [[1], [8, 1, 9], [513, 64, 65, 512, 2], [1] * 20])
def test_merkle_proofs_against_plain_trees(spark, sizes):
    names, rng = [None, "", *(f"l{k}é" for k in range(30))], random.Random(sum(sizes))
    rows = [(rng.randrange(10**6), rng.choice(["Upper", "lower", None, "", "ÄB"]), names[k]) for k, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:3] + [(None, "A null", names[0]), (None, "Another", names[0]), (rows[0][0], "same id", rows[0][2])]
    docs = frame(spark, rows)
    assert sorted(map(tuple, merkle.verified(docs).collect()), key=repr) == plain_proofs([r.asDict() for r in docs.collect()])


def test_only_every_third_level_is_stored(spark):
    docs = frame(spark, [(i, "t", "en") for i in range(600)])
    found = merkle.manifest(docs)
    assert [level.count() for level in found.levels] == [600, 2, 1]
    assert merkle.levels_left(600) == 4 and [merkle.levels_left(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]
    assert merkle.verified(frame(spark, [])).count() == 0


# Alignment


def plain_alignment(texts):
    aligner = token_alignment.Aligner(token_alignment.default_tokenizer(), token_alignment.default_model())
    each = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        left, right = [aligner.bytes_a[x] for x in a], [aligner.bytes_b[x] for x in b]
        if b"".join(left) != whole or b"".join(right) != whole:
            a = b = left = right = []
        ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
        links, groups = Counter(), []
        for i, e in enumerate(ends_a):
            for j, f in enumerate(ends_b):
                if max(e - len(left[i]), f - len(right[j])) < min(e, f):
                    links[a[i], b[j]] += 1
        low = 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append("|".join(",".join(str(x) for x, e in zip(ids, ends, strict=True) if low < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
            low = cut
        each.append((len(a), len(b), links, groups))
    held, most = Counter(k for x in each for k in x[2]), {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    return [(n_a, n_b, len(g), sum(x.values()), sum(m for k, m in x.items() if held[k] == most[k[0]]), sum(m * held[k] for k, m in x.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, x, g in each]


@pytest.mark.parametrize("run_records, fan_in", [(1 << 20, 64), (500, 3)])
def test_alignment_against_plain_counts(spark, run_records, fan_in):
    texts = [t for t in odd_texts(7, 300) if len(t or "") < 100] + ["the same text"] * 40
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    rows = sorted(map(tuple, token_alignment.alignments(docs, run_records=run_records, fan_in=fan_in).collect()))
    assert rows == [(i, *x) for i, x in enumerate(plain_alignment(texts))]


def test_alignment_joins_lists_that_are_too_large_to_broadcast(spark, monkeypatch):
    texts = odd_texts(8, 60)[10:]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "x y", None)])
    whole = sorted(map(tuple, token_alignment.alignments(docs).collect()), key=repr)
    monkeypatch.setattr(token_alignment, "MOST_BYTES", 0)
    assert sorted(map(tuple, token_alignment.alignments(docs, run_records=300).collect()), key=repr) == whole
    assert token_alignment.alignments(frame(spark, [])).count() == 0


def test_long_texts_are_cut_in_pieces(monkeypatch):
    aligner = token_alignment.Aligner(token_alignment.default_tokenizer(), token_alignment.default_model())
    for text in odd_texts(9, 300):
        if text and "▁" not in text:
            monkeypatch.setattr(token_alignment, "PIECE_CHARS", 1 << 20)
            once = token_alignment.aligned([text], aligner)
            monkeypatch.setattr(token_alignment, "PIECE_CHARS", 20)
            cut = token_alignment.aligned([text], aligner)
            assert (once.groups, once.n_links.tolist(), once.pair.tolist(), once.times.tolist()) == (cut.groups, cut.n_links.tolist(), cut.pair.tolist(), cut.times.tolist())


# Hot and odd cases of earlier operators


def test_offsets_are_linear():
    import time

    from cladeflow.llm import toxicity

    text = ("é bad " * 500_000).encode()
    began = time.time()
    spans = toxicity.offsets(text, np.ones(1_000_000, bool))
    assert time.time() - began < 10 and spans == [{"start": 0, "end": 6 * 500_000 - 1}]
    word = toxicity.offsets("é bad 漢 x".encode(), np.array([False, True, False, True]))
    assert word == [{"start": 2, "end": 5}, {"start": 8, "end": 9}]


def test_weights_above_one_are_scaled(spark):
    from cladeflow.llm import mixing

    docs = spark.createDataFrame([(i, "x" * 10, s) for i, s in enumerate("aabbcc")], "doc_id long, text string, source string")
    rate = lambda weights: {r["mix_source"]: round(r["mix_rate"], 9) for r in mixing.rates(docs, weights).collect()}
    assert rate({"a": 0.9, "b": 0.9}) == {"a": 1.5, "b": 1.5, "c": 0.0}
    assert rate({"a": 0.5, "b": 0.2, "not there": 0.9}) == {"a": 1.5, "b": 0.6, "c": 0.9}
    assert {r["source"] for r in mixing.mixed(docs, {"a": 0.9, "b": 0.9}).collect()} <= {"a", "b"}
    with pytest.raises(ValueError):
        mixing.rates(docs, {"a": -0.1})


def test_null_ids_are_dealt_out(spark):
    from cladeflow.llm import token_store

    docs = spark.createDataFrame([(None, f"text {i}") for i in range(3000)] + [(5, "five")], "doc_id long, text string").repartition(4)
    path = str(docs.sparkSession.conf.get("spark.checkpoint.dir")) + "/null-ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one part again
    schema = token_store.write_tokens(docs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = token_store.read_tokens(spark, path, schema)
    sizes = [r["count"] for r in spark.read.schema(schema).orc(path).groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1500
    found = sorted(rows.select("doc_id", "start", "n_tokens").collect(), key=lambda r: r["start"])
    assert found[-1]["doc_id"] == 5 and found[-1]["start"] == sum(r["n_tokens"] for r in found[:-1])
