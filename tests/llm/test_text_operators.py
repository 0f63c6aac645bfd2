"""Licence scans, decontamination, SimHash, quality rules, token ids and toxicity against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from cladeflow.llm import decontaminate, license_scan, quality, simhash, token_store, toxicity
from cladeflow.llm.spark_util import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score string, fingerprint string, spans string, n_words string, source string, lang string, n_chars long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", "src0", "en", None if t is None else len(t)) for i, t in rows], DOCS)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def random_texts(seed, count, alphabet="a b c d e f", longest=60):
    rng = random.Random(seed)
    return [" ".join(rng.choice(alphabet.split()) for _ in range(rng.randint(0, longest))) for _ in range(count)]


EDGES = [None, "", " \n\t ", "ÀB é-x_y Z9", "a" * 5000, "word " * 20000]


def test_words():
    for text in EDGES + random_texts(1, 20):
        assert [w.decode() for w in words(None if text is None else text.encode())] == plain_words(text)


def brute_contamination(text, items, window=10):
    found, hit, owners = plain_words(text), set(), set()
    for item_id, item in items:
        w = plain_words(item)
        size = min(len(w), window)
        for j in range(len(w) - size + 1) if w else ():
            for i in range(len(found) - size + 1):
                if found[i : i + size] == w[j : j + size]:
                    hit |= set(range(i, i + size))
                    owners.add(item_id)
    return len(found), len(hit), owners - {None}


@pytest.mark.parametrize("window", [3, 10])
def test_contamination_against_brute_force(spark, window):
    items = list(enumerate(random_texts(2, 12, "a b c", 14))) + [(90, None), (91, ""), (92, "a b"), (92, "c a"), (None, "b b b b")]
    texts = random_texts(3, 60, "a b c d", 80) + EDGES
    docs = frame(spark, [*enumerate(texts), (3, texts[3])])
    bench = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 20):
        rows = decontaminate.contamination(docs, bench, window, block).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            n, hit, owners = brute_contamination(texts[r["doc_id"]], items, window)
            listed = hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest()
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(owners), listed, hit > 0)


def test_decontaminated_cuts_passages_and_keeps_clean_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    clean = "Nothing here,  stays   as it is.\nOne two three four five six seven eight nine."
    rows = [(1, clean), (2, "Before it, " + item.upper() + "! and " + "plenty of other words " * 10), (3, item), (4, None), (5, "")]
    out = {r["doc_id"]: r for r in decontaminate.decontaminated(frame(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert sorted(out) == [1, 2, 4, 5]
    assert out[1]["text"] == clean and out[4]["text"] is None and out[5]["text"] == ""
    assert "three" not in out[2]["text"].lower() and out[2]["text"].startswith("Before it,") and out[2]["n_chars"] == len(out[2]["text"])


def test_empty_tables(spark):
    docs, bench = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert decontaminate.contamination(docs, bench).count() == 0
    assert decontaminate.contamination(frame(spark, [(1, "a")]), bench).first()["n_hit"] == 0
    assert license_scan.scan(docs).count() == 0
    assert quality.judged(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicated(docs).count() == 0
    assert token_store.token_index(docs).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    assert [r["score"] for r in toxicity.toxicity(frame(spark, [(1, "a"), (2, None)]), labels).collect()] == [0.0, 0.0]


def test_license_base_places(spark):
    rng, parts = random.Random(5), "gnu general public license apache cc by mit x".split()
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(80)] + EDGES
    texts += ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU General Public\nLicense", "CC-BY"]
    for r in license_scan.scan(frame(spark, list(enumerate(texts)))).collect():
        w = plain_words(texts[r["doc_id"]])
        places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        starts, labels = [i for i, _ in places], {label for _, label in places}
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_license_templates(spark):
    mit = license_scan.TEMPLATES[3][0]
    texts = ["intro words " + mit + " tail", " ".join(w for k, w in enumerate(mit.split()) if k % 17), "nothing of the kind here", "Licensed under CC BY-NC 4.0."]
    labels = [r["labels"] for r in license_scan.scan(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert labels == ["mit", "mit", "", "cc-by,cc-by-nc-4.0"]


def test_every_license_template_is_found_and_told_apart(spark):
    """Whole notices, and notices of 12 words or more with one word changed, get their own label; repeated rows are judged alike."""
    rng, rows, want = random.Random(31), [], {}
    for template, label in license_scan.TEMPLATES:
        w = template.split()
        for change in (False, True) if len(w) >= 12 else (False,):
            own = list(w)
            if change:
                own[rng.randrange(4, len(own) - 4)] = "otherwise"
            for _ in range(2):
                want[len(rows)] = label
                rows.append((len(rows), f"Some file.\n\n{' '.join(own).capitalize()}!\n\nmore text"))
    found = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    for k, label in want.items():
        assert label in found[k][0].split(",") and found[k][1] >= license_scan.COVERAGE, rows[k]
        assert found[k] == found[k ^ 1]


def brute_fingerprint(text):
    w = (text or "").translate(LOWER).encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=4):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(6)
    base = random_texts(7, 40, "a b c d e f g h i j k l m n", 300)
    texts = EDGES + base + [None, "", "Same one", "same  ONE"]
    for text in base[:20]:
        w = text.split()
        for _ in range(3):
            if w:
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = simhash.near_duplicates(frame(spark, [*enumerate(texts), (0, None)])).collect()
    assert len(rows) == len(texts) + 1
    prints = [brute_fingerprint(t) for t in texts]
    roots = brute_components(prints)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", roots[r["doc_id"]])


def wide_fingerprint(text):
    w = (text or "").translate(LOWER).encode().split()
    hashes = [xxhash.xxh3_128_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_sketch(text):
    w, least = (text or "").translate(LOWER).encode().split(), {}
    for i in range(max(1, len(w) - 4)) if w else ():
        h = xxhash.xxh3_128_intdigest(b" ".join(w[i : i + 5]), 42) >> 64
        least[h % 256] = min(least.get(h % 256, 1 << 64), h // 256)
    return {b: 1 + h % 255 for b, h in least.items()}


def brute_groups(texts):
    """Links within components at the budget, between texts whose sketches agree."""
    loose, sketches = brute_components([wide_fingerprint(t) for t in texts], simhash.WIDE_BITS), [plain_sketch(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sketches[i], sketches[j]
            if loose[i] == loose[j] and sum(b.get(k) == v for k, v in a.items()) >= simhash.SIMILAR * len(a.keys() | b.keys()):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("block", [None, 7])
def test_deduplicated_against_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(simhash, "LOOKED_AT", block)
    rng = random.Random(16)
    texts = EDGES + random_texts(17, 60, "a b c d e f g h i j k l m n", 300)
    for text in texts[10:50]:
        w = text.split()
        for _ in range(len(w) // 60):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for k in range(30):  # a component of more than one block
        w = texts[40].split()
        w[k % len(w)] = "again"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), (0, None), (3, texts[3]), (None, texts[20]), (None, "no other is like this"), (None, "no other is like this"), (7, "one id but another text")]
    roots, best = brute_groups([t for _, t in rows]), {}
    for k, (doc_id, text) in enumerate(rows):
        best.setdefault(roots[k], []).append((doc_id is None, doc_id or 0, text))
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(frame(spark, rows)).collect()), key=str)
    assert len(got) == len(best)
    assert sorted((i for i, _ in got), key=str) == sorted((None if min(x, key=lambda y: y[:2])[0] else min(x, key=lambda y: y[:2])[1] for x in best.values()), key=str)


def test_share_of_similar_pairs_that_is_dropped(spark):
    """By Jaccard similarity: from 0.8 up 9 in 10 at least, below 0.75 less than 1 in 10."""
    rng, rows, pairs = random.Random(19), [], []
    for k in range(4000):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        other = list(w)
        for at in rng.sample(range(5, len(w) - 5), max(1, round(len(w) * rng.uniform(0.003, 0.05)))):
            other[at] = "changed"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
        pairs.append((len(sets[0] & sets[1]) / len(sets[0] | sets[1]), 2 * k + 1))
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, rows)).collect()}
    assert all(2 * k in kept for k in range(4000))
    share = lambda low, high: [i not in kept for x, i in pairs if low <= x < high]
    found = {low: share(low, low + 0.05) for low in (0.8, 0.85, 0.9, 0.95)} | {0.7: share(0.7, 0.75), 0.6: share(0.6, 0.7)}
    shares = {low: sum(x) / len(x) for low, x in found.items()}
    assert min(map(len, found.values())) > 100, {k: len(x) for k, x in found.items()}
    assert min(shares[low] for low in (0.8, 0.85, 0.9, 0.95)) >= 0.9 and shares[0.7] < 0.1 and shares[0.6] < 0.02, shares
    print(shares)


def test_deduplicated_never_loses_a_text_with_a_repeated_id(spark):
    a, b = " ".join(f"word{k}" for k in range(50)), " ".join(f"other{k}" for k in range(50))
    for rows in ([(5, a), (5, b)], [(1, a), (2, a), (2, b)]):
        got = simhash.deduplicated(frame(spark, rows)).collect()
        assert sorted(r["text"] for r in got) == sorted([a, b])


def test_similar_texts_are_deduplicated(spark):
    """Of pairs of texts with a Jaccard similarity of their 5-word shingles from 0.8 to 0.95, most lose one; unlike texts stay."""
    rng, rows, alike = random.Random(18), [], []
    for k in range(400):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400))]
        other = list(w)
        for at in rng.sample(range(5, len(w) - 5), max(1, round(len(w) * rng.uniform(0.005, 0.02)))):
            other[at] = "changed"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if similarity >= 0.8:
            rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
            alike.append((similarity, 2 * k + 1))
    clean = [(10_000 + k, " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for k in range(300)]
    kept = {r["doc_id"] for r in simhash.deduplicated(frame(spark, [*rows, *clean])).collect()}
    assert {i for i, _ in clean} <= kept and {i for i, _ in rows if i % 2 == 0} <= kept
    for least, share in ((0.8, 0.9), (0.9, 0.98)):
        found = [i not in kept for x, i in alike if x >= least]
        assert len(found) > 50 and sum(found) >= share * len(found)


@pytest.mark.parametrize("words, most", [(1, 4), (2, 23)])
def test_trie_join_with_hot_blocks(spark, monkeypatch, tmp_path, words, most):
    """A dense group, and nodes next to it that are cold but have all of it as visitors: no task gets more than two blocks."""
    monkeypatch.setattr(simhash, "NODE_SIZE", 16)
    monkeypatch.setattr(simhash, "BLOCK_SIZE", 40)
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 2**63, (150, words), dtype=np.uint64)
    dense = np.tile(keys[0], (200, 1))
    for _ in range(3):
        dense[:, 0] ^= np.uint64(1) << rng.integers(0, 60, 200).astype(np.uint64)
    dense[::7, words - 1] ^= np.uint64(1) << np.uint64(62)  # in a neighbouring node
    prints = sorted({tuple(x) for x in np.concatenate([keys, dense]).tolist()})
    names = simhash.word_names(words)
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(prints)], ", ".join(f"{n} long" for n in ["key_id", *names]))
    log, whole = f"{tmp_path}/sizes", simhash.joined_node

    def counted(keys, *rest):
        with open(log, "a") as file:
            file.write(f"{len(keys)}\n")
        return whole(keys, *rest)

    monkeypatch.setattr(simhash, "joined_node", counted)
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, most, words)).collect()}
    with open(log) as file:
        sizes = [int(x) for x in file.read().split()]
    assert max(sizes) <= 3 * 40 < len(prints)  # blocks are dealt out by a hash, so they are about 40 keys each
    whole_prints = [sum(x << 64 * k for k, x in enumerate(p)) for p in prints]
    roots = brute_components(whole_prints, most)
    groups = lambda names: sorted(map(sorted, {r: [k for k, x in enumerate(names) if x == r] for r in names}.values()))
    assert groups([found.get(k, k) for k in range(len(prints))]) == groups(roots)


def brute_quality(text):
    w = (text or "").encode().split()
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics(spark):
    texts = EDGES + random_texts(9, 60, "a b c d", 60) + ["x y\nx y\n \nx y", "# a|b <c> $5 100%"]
    for r in quality.judged(frame(spark, [*enumerate(texts), (None, "a b")])).collect():
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]]
        want = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["kept"] and r["base_failed"])


def test_quality_model_agrees_with_labels(spark):
    data = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    bad = [r["kept"] for r in rows if r["quality"] is not None and r[-2] == 0]
    good = [r["kept"] for r in rows if not r["base_failed"] and r[-2] == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.97 * len(good)


def plain_label_model(patterns, kinds):
    """Expectation-maximisation with plain loops."""
    total, rules = sum(patterns.values()), len(next(iter(patterns)))
    silent = [(sum(n for p, n in patterns.items() if p[k] == "1") + 1) / (total + 3) for k in range(rules)]
    first = [[0.3] * rules, *([0.7 if k in kind else 0.3 for k in range(rules)] for kind in kinds)]
    chance = lambda bad, none: {"0": bad * (1 - none), "1": none, "2": (1 - bad) * (1 - none)}
    table = [[chance(row[k], silent[k]) for k in range(rules)] for row in first]
    shares = [1 / len(first)] * len(first)

    def weights(p):
        each = []
        for share, row in zip(shares, table, strict=True):
            for k in range(rules):
                share *= row[k][p[k]]
            each.append(share)
        return [x / sum(each) for x in each]

    for _ in range(2000):
        found = [[dict.fromkeys("012", 0.0) for _ in range(rules)] for _ in first]
        sizes = [0.0] * len(first)
        for p, n in patterns.items():
            for c, w in enumerate(weights(p)):
                sizes[c] += w * n
                for k in range(rules):
                    found[c][k][p[k]] += w * n
        before = table
        table = [[chance((x["0"] + first[c][k]) / (x["0"] + x["2"] + 1), (x["1"] + 20 * silent[k]) / (sum(x.values()) + 20)) for k, x in enumerate(row)] for c, row in enumerate(found)]
        shares = [(x + 1) / (total + len(first)) for x in sizes]
        if max(abs(a[v] - b[v]) for r, s in zip(table, before, strict=True) for a, b in zip(r, s, strict=True) for v in "012") < 1e-10:
            break
    return {p: weights(p)[0] for p in patterns}


def test_quality_verdict_against_a_plain_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stats = quality.measured(docs)
    patterns = {r["votes"]: r["count"] for r in stats.groupBy("votes").count().collect()}
    want = plain_label_model(patterns, quality.kind_numbers())
    votes = {r["doc_id"]: r["votes"] for r in stats.select("doc_id", "votes").collect()}
    loose = strict = 0
    for r in quality.judged(docs).collect():
        own = votes[r["doc_id"]]
        assert r["quality"] == pytest.approx(want[own], abs=1e-9) and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
        loose += r["kept"] and "0" in own
        strict += not r["kept"] and not r["base_failed"] and "0" not in own
    assert loose > 20 and strict > 10  # kept with a bad vote, and dropped without one: not a chain of must-pass rules


def test_tokens_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    rng = random.Random(11)
    letters = "aAZ  \t\n\x0b\x0c\r\x1c\x85\xa0 '’streΣσéÉ̀ 12½ªµºß<|endoftext|>İǅ한🙂_-.,\x00"
    texts = EDGES + ["<|endoftext|>", "don't, it's 42"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = token_store.token_index(frame(spark, [*enumerate(texts), (5, "again")])).orderBy("doc_id", "start").collect()
    start = 0
    for r, (k, text) in zip(rows, sorted([*enumerate(texts), (5, "again")], key=lambda x: (x[0], x[1] or "")), strict=True):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    """Pieces end before a space, so they give the ids of the whole text, however small they are."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_store.default_tokenizer())
    monkeypatch.setattr(token_store, "PIECE_CHARS", 7)
    encoder = token_store.BatchEncoder(token_store.default_tokenizer())
    rng = random.Random(21)
    letters = "abcZ  \t\n\r\x85\xa0 '’éÉß12½<|endoftext|>한🙂_-.,"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    ids, counts = encoder([t.encode() for t in texts], 1)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]
        at += n


def test_token_files_have_indexes_and_are_read_by_id(spark, tmp_path):
    docs = frame(spark, [(k, f"text {k}") for k in range(500)])
    schema = token_store.write_tokens(docs, f"{tmp_path}/ids")
    tokens = token_store.read_tokens(spark, f"{tmp_path}/ids", schema)
    assert tokens.filter("doc_id = 77").count() == 1
    assert "EqualTo(doc_id,77)" in tokens.filter("doc_id = 77")._jdf.queryExecution().toString()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeioumnst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for k in range(1200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(10, 60))]
        toxic = k % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "vrogla" + rng.choice(["ta", "no", "re", "mi"])]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = frame(spark, [*rows, (9001, None), (9002, ""), (None, "scumbag here"), (9003, "fine, you scumbag!"), (9004, "a mountain " * 100_000 + "scumbag"), (9005, rows[7][1]), (9006, rows[7][1])])
    known = spark.createDataFrame([(*x, "x", "y", "z") for x in [*labels, (None, 1), (3, None), (77_777, 1)]], "doc_id long, toxic int, text string, score string, spans string")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, known).collect()}
    held = [k for k in range(1200) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(out[k]["held_out"] == (k in held) for k in range(1200)) and out[None]["held_out"] is False
    right = [out[k]["predicted"] == labels[k][1] for k in held]
    assert sum(right) >= 0.98 * len(right)
    assert out[9001]["score"] == out[9002]["score"] < 0.3 <= out[None]["score"]
    assert [(s["start"], s["end"]) for s in out[9003]["spans"]] == [(10, 17)]
    assert [(s["start"], s["end"]) for s in out[9004]["spans"]] == [(1_100_000, 1_100_007)] and out[9004]["predicted"] == 1
    assert out[9005]["score"] == out[9006]["score"] == out[7]["score"]
    assert sorted(toxicity.accepted(docs, known).columns) == sorted(docs.columns)


def brute_spans(text, templates):
    """All longest common runs by comparing every place with every place, and the best chains of them."""
    out = []
    for k, (t, _) in enumerate(templates):
        t, runs = t.split(), []
        for i in range(1, len(text) + 1):
            for e in range(1, len(t) + 1):
                n = 0
                while n < min(i, e) and text[i - 1 - n] == t[e - 1 - n]:
                    n += 1
                if n >= license_scan.LEAST_MATCH and (i == len(text) or e == len(t) or text[i] != t[e]):
                    runs.append((i - n, i, e - n, e))
        best = []
        for a, b, c, d in runs:
            own = [(b - a, -a)]
            for m, (a2, b2, c2, d2) in enumerate(runs[: len(best)]):
                if b2 < b and d2 < d and a - b2 <= license_scan.MOST_GAP and c - d2 <= license_scan.MOST_GAP and a2 <= a and c2 <= c:
                    own.append((best[m][0] + min(b - a, b - b2, d - d2), -best[m][1]))
            covered, first = max(own)
            best.append((covered, -first, b))
        taken = []
        for covered, a, b in sorted(best, key=lambda x: (-x[0], x[1], x[2])):
            if covered >= license_scan.COVERAGE * len(t) and all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((a, b, k, covered / len(t)))
    return sorted(out)


def test_license_chains_against_brute_force():
    rng = random.Random(31)
    for _ in range(150):
        templates = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(4, 14))), f"l{k}") for k in range(4)]
        found = license_scan.Licences(templates=templates)
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [rng.choice("abcdx") for _ in range(rng.randint(0, 12))]
            notice = rng.choice(templates)[0].split()
            text += [w for w in notice if rng.random() > 0.1]
        assert found.spans([w.encode() for w in text]) == brute_spans(text, templates)


def test_license_templates_with_repeated_and_shared_passages():
    spans = lambda templates, text: {k for _, _, k, _ in license_scan.Licences(templates=[(t, t) for t in templates]).spans(text.encode().split())}
    assert spans(["p q r s t u v w p q r x y z l m n o"], "p q r NEW s t u v w p q r x y z l m n o") == {0}
    shared = ["a b c d e f g h x", "a b c d e f g h k l m"]
    assert spans(shared, "a b c d e f g h x k l m") == {0, 1}
    assert spans(shared, "a b c d e f g h y k l m") == {0, 1}
