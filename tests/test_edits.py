"""Vectors that follow edits, regrafts, rings, the pruned search and commits, against whole recomputations."""

import random

import numpy as np
import pytest

from cladeflow import queries as engine
from cladeflow.functions.model import Model
from cladeflow.operators import placement, pruned_search, rings, spr, vectors
from cladeflow.operators.likelihood import Block
from cladeflow.plans.tree import Tree
from cladeflow.sources import jplace, text
from cladeflow.streaming.placement import commit_stream

MODEL = Model(rates=(1, 2.5, 1, 1, 2.5, 1), freqs=(0.3, 0.4, 0.1, 0.2), alpha=0.5)


def random_tree(rng, count):
    tree = Tree()
    tree.root = tree.add()
    for k in range(2):
        tree.hang(tree.add(f"t{k}", rng.random() * 0.3 + 0.01), tree.root)
    for k in range(2, count):
        edge = rng.choice(tree.edges())
        tree.insert(f"t{k}", edge, tree.blen[edge] * rng.random(), rng.random() * 0.3 + 0.01)
    return tree


def evolved(rng, tree, model, sites, names):
    """Masks [site, taxon] of sequences that evolved along the tree; other names get the state of the first tip."""
    state, number = {tree.root: rng.choice(4, sites, p=model.freqs)}, {n: k for k, n in enumerate(names)}
    cats = rng.integers(model.ncat, size=sites)
    for node in tree.preorder():
        if node != tree.root:
            upto = model.transition(np.array([tree.blen[node]]))[0].cumsum(axis=2)[cats, state[tree.parent[node]]]
            state[node] = np.minimum((rng.random(sites)[:, None] > upto).sum(axis=1), 3)
    masks = np.full((sites, len(names)), 15, np.int32)
    for node in tree.tips():
        masks[:, number[tree.name[node]]] = 1 << state[node]
    return masks


def table(spark, masks):
    return spark.createDataFrame([(k, m, 1) for k, m in enumerate(masks.tolist())], "pattern_id int, pattern array<int>, weight long")


def hops_to_root(tree, node):
    return 0 if node is None else 1 + hops_to_root(tree, tree.parent[node])


def assert_as_made_anew(found, taxa, masks, transposed=False):
    whole = Block(found.tree, MODEL, taxa, masks, down=True, transposed=transposed)
    found.ask(found.tree.edges())
    for node in found.tree.preorder():
        assert np.allclose(found.up[node] * np.exp(found.scale[node] - whole.scale[node])[:, None, None], whole.up[node], rtol=1e-9, atol=1e-12)
    for edge in found.tree.edges():
        assert np.allclose(found.base[edge] * np.exp(found.base_scale[edge] - whole.base_scale[edge])[:, None, None], whole.base[edge], rtol=1e-9, atol=1e-12)
    assert np.allclose(found.loglik(), whole.loglik(), atol=1e-9)


@pytest.mark.parametrize("transposed", [False, True])
def test_vectors_follow_edits(transposed):
    rng = random.Random(1)
    for trial in range(12):
        count = rng.randint(4, 20)
        names = [f"t{k}" for k in range(count + 6)]
        taxa, masks = {n: k for k, n in enumerate(names)}, np.random.default_rng(trial).choice([1, 2, 4, 8, 15, 5], size=(17, count + 6))
        now = vectors.Vectors(random_tree(rng, count), MODEL, taxa, masks, transposed)
        assert_as_made_anew(now, taxa, masks, transposed)
        for k in range(count, count + 6):
            edge, before, version = rng.choice(now.tree.edges()), now.upward, now.version
            tip = now.insert(f"t{k}", edge, now.tree.blen[edge] * rng.random(), 0.1, masks[:, k])
            path = hops_to_root(now.tree, now.tree.parent[tip])
            assert now.upward - before == path and now.version == version + 1
            assert sum(v == now.version for v in now.made.values()) == path  # all others are of older versions
            assert_as_made_anew(now, taxa, masks, transposed)
            node, old = rng.choice(now.tree.edges()), now
            now = old.fork()
            above, before = now.tree.parent[now.tree.parent[node]], now.upward
            now.prune(node)
            assert now.upward - before == hops_to_root(now.tree, above)
            if not now.tree.edges():
                now = old
                continue
            assert_as_made_anew(now, taxa, masks, transposed)
            assert_as_made_anew(old, taxa, masks, transposed)  # the fork's edits don't reach it
            edge = rng.choice(now.tree.edges())
            score = now.joined(node, edge, now.tree.blen[edge] / 2, 0.07)
            now.graft(node, edge, now.tree.blen[edge] / 2, 0.07)
            assert transposed or np.allclose(score, now.loglik(), atol=1e-9)
            assert_as_made_anew(now, taxa, masks, transposed)


def test_downward_vectors_are_made_for_what_is_asked():
    rng = random.Random(2)
    tree = random_tree(rng, 60)
    masks = np.random.default_rng(0).choice([1, 2, 4, 8], size=(5, 60))
    found = vectors.Vectors(tree, MODEL, {f"t{k}": k for k in range(60)}, masks)
    edge = rng.choice(tree.tips())
    found.ask([edge])
    assert found.downward == hops_to_root(tree, edge) - 1 < len(tree.edges())
    found.ask([edge, tree.parent[edge]] if tree.parent[tree.parent[edge]] is not None else [edge])
    assert found.downward == hops_to_root(tree, edge) - 1  # known already


def test_matrices_are_made_for_changed_branches_only(monkeypatch):
    tree = random_tree(random.Random(3), 30)
    masks = np.random.default_rng(0).choice([1, 2, 4, 8], size=(5, 31))
    found, made, transition = vectors.Vectors(tree, MODEL, {f"t{k}": k for k in range(31)}, masks), [], Model.transition
    monkeypatch.setattr(Model, "transition", lambda self, lengths: made.append(len(lengths)) or transition(self, lengths))
    edge = tree.tips()[7]
    found.insert("t30", edge, found.tree.blen[edge] / 3, 0.1, masks[:, 30])
    assert sum(made) == 3  # both halves of the edge, and the pendant one


def test_regraft_scores_are_those_of_the_moved_trees(spark):
    rng = random.Random(4)
    tree, names = random_tree(rng, 12), [f"t{k}" for k in range(12)]
    patterns = table(spark, np.random.default_rng(1).choice([1, 2, 4, 8, 15], size=(40, 12)))
    nodes = [n for n in tree.edges() if tree.parent[n] != tree.root]
    work = []
    for node in nodes:
        rest = tree.copy()
        rest.prune(node)
        work.append((node, tree.blen[node], rest.edges()))
    got = {(r["node"], r["edge"]): r["loglik"] for r in vectors.regraft_scores(tree, patterns, MODEL, names, work).collect()}
    pairs = [(n, e) for n, _, edges in work for e in edges]
    whole = spr.tree_logliks([spr.moved(tree, *p) for p in pairs], patterns, MODEL, names)
    assert len(got) == len(pairs) and [got[p] for p in pairs] == pytest.approx(whole, abs=1e-9)
    assert vectors.regraft_scores(tree, patterns, MODEL, names, []).count() == 0


def plain_rings(tree, node, radius):
    """By distances in the tree without the subtree."""
    rest, sibling = tree.copy(), tree.sibling(node)
    rest.prune(node)
    centre = [sibling] + ([] if rest.parent[sibling] is None else [rest.parent[sibling]])
    far = rest.hops(centre)
    out = {e: min(far[e], far[rest.parent[e]]) for e in rest.edges()}
    return rest, sibling, {e: d for e, d in out.items() if d <= radius}


def test_rings_against_distances(spark):
    rng = random.Random(5)
    for count in (6, 25):
        tree = random_tree(rng, count)
        want = {}
        for node in tree.edges():
            if tree.parent[node] == tree.root:
                continue
            rest, sibling, found = plain_rings(tree, node, 3)
            known = rings.rings(rest, sibling, 3)
            assert {e: d for e, (d, _) in known.items()} == found
            want |= {(node, e): d for e, d in found.items()}
            inner = rings.rings(rest, sibling, 1)
            seeds = [e for e, (d, _) in inner.items() if d == 1]
            beyond = rings.outward(rest, inner, seeds, 3)
            assert beyond == {e for e, d in found.items() if d > 1}  # from all seeds, all outer rings
            if seeds:
                assert rings.outward(rest, inner, seeds[:1], 3) <= beyond
        if count == 25:
            assert {(r["prune_root"], r["edge"]): r["ring"] for r in rings.ring_edges(tree.nodes(spark), 3).collect()} == want


def test_ring_search_finds_the_best_edge_with_fewer_scores():
    """On data that evolved along a tree, one of whose tips was moved by up to three edges: of all edges, the best one."""
    rng, numbers, narrow, wide, same, pairs = random.Random(6), np.random.default_rng(6), 0, 0, 0, []
    for _ in range(50):
        true = random_tree(rng, 30)
        names = [f"t{k}" for k in range(30)]
        taxa, masks = {n: k for k, n in enumerate(names)}, evolved(numbers, true, MODEL, 400, names)
        node = rng.choice([n for n in true.tips() if true.parent[n] != true.root])
        _, sibling, near = plain_rings(true, node, 2)
        tree = spr.moved(true, node, rng.choice([e for e in near if e != sibling])).renumbered()
        name, whole = true.name[node], vectors.Vectors(tree, MODEL, taxa, masks)

        def score(work, whole=whole):
            out = {}
            for item, pendant, edges in work:
                v = whole.fork()
                v.prune(item)
                v.ask(edges)
                out |= {(item, e): float(v.joined(item, e, v.tree.blen[e] / 2, vectors.held(pendant)).sum()) for e in edges}
            pairs.extend(out)
            return out

        pairs.clear()
        own = [(gain, edge) for gain, _, n, edge in spr.ranked_moves(tree, score, [name], spr.SprOptions(radius=8)) if tree.name[n] == name]
        narrow += sum(tree.name[n] == name for n, _ in pairs)
        (tip,) = [n for n in tree.tips() if tree.name[n] == name]
        rest, sibling, _ = plain_rings(tree, tip, 0)
        every = score([(tip, tree.blen[tip], rest.edges())])
        wide += len(every)
        gain, edge = max((every[tip, e] - every[tip, sibling], e) for e in rest.edges())
        same += max(own) == (pytest.approx(gain, abs=1e-9), edge) if own else gain <= 0
    assert same == 50 and narrow < wide, (same, narrow, wide)


def test_jplace_of_null_and_empty_names(spark, tmp_path):
    tree = Tree.parse("((a:.1,b:.2):.1,c:.3);")
    edge = next(iter(jplace.exported(tree)[1]))
    rows = [(q, edge, 1, -1.0, 1.0, 0.1, 0.1) for q in (None, "", "x", "x\"y")]
    jplace.write_jplace(spark.createDataFrame(rows, "query string, edge int, rank int, loglik double, lwr double, distal double, pendant double"), tree, str(tmp_path / "out"))
    found = jplace.read_jplace("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()))
    assert sorted(p["n"][0] for p in found["placements"]) == ["", "", "x", 'x"y']
    empty = spark.createDataFrame([], "query string, edge int, rank int, loglik double, lwr double, distal double, pendant double")
    jplace.write_jplace(empty, tree, str(tmp_path / "none"))
    assert jplace.read_jplace("\n".join(r[0] for r in spark.read.text(str(tmp_path / "none")).collect()))["placements"] == []


def test_pruned_search(spark, sf_dir):
    every = {(r["query"], r["edge"]): r["loglik"] for r in engine.placement_baseline(spark, sf_dir).collect()}
    rows = lambda options: {(r["query"], r["edge"]): round(r["loglik"], 6) for r in engine._searched(spark, sf_dir, options).collect()}
    assert rows(pruned_search.PruneOptions(threshold=float("inf"))) == every
    found = rows(engine.PRUNED)
    assert len(found) < len(every) and all(every[k] == v for k, v in found.items())
    best = lambda of: {q: max(v for (p, _), v in of.items() if p == q) for q, _ in every}
    assert best(found) == best(every)
    assert rows(pruned_search.PruneOptions(small=100)) == every  # every frontier is smaller: all edges


def test_commits_that_screen_edges_are_those_that_optimise_all(spark, sf_dir):
    found, names, queries = engine._with_queries(spark, sf_dir)
    tree = engine.derived.tree(spark, sf_dir)
    some = queries[:4]
    whole, screened = (placement.committed(tree, found, engine.MODEL, names, some, options) for options in (engine.FULL, engine.COMMIT))
    assert whole.newick() == screened.newick()
    counts = [placement.edge_scores(tree, found, names.index(some[0]), engine.MODEL, names).collect()]
    span = sorted(r["loglik"] for r in counts[0])
    assert sum(x >= span[-1] - engine.COMMIT.keep * (span[-1] - span[0]) for x in span) < len(span) / 2


def test_selective_refinement_keeps_the_best_edge(spark, sf_dir, monkeypatch):
    found, tree, names = engine.stored_patterns(spark, sf_dir), engine.derived.tree(spark, sf_dir), engine.taxa(spark, sf_dir)
    counts = engine.counts(spark, sf_dir, engine.derived.query_cells(spark, sf_dir), found)
    whole = {(r["query"], r["rank"]): r for r in placement.placed(tree, found, counts, engine.MODEL, names, engine.FULL).collect()}
    entered, ambiguous = [], placement.ambiguous

    def watched(scores, before, options):
        out = ambiguous(scores, before, options)
        entered.append(sorted((r["query"], len(r["edges"])) for r in out.collect()))
        return out

    monkeypatch.setattr(placement, "ambiguous", watched)
    queries = {q for q, _ in whole}
    some = {(r["query"], r["rank"]): r for r in placement.selectively_placed(tree, found, counts, engine.MODEL, names, engine.FULL).collect()}
    assert set(some) == set(whole)
    for q in queries:
        least = 0.05 if q in dict(entered[0]) else 10.0  # the certain ones keep the lengths of the first pass
        assert some[q, 1]["edge"] == whole[q, 1]["edge"] and whole[q, 1]["loglik"] - least < some[q, 1]["loglik"] < whole[q, 1]["loglik"] + 0.05
    assert len(entered[0]) <= len(queries) and all(n <= placement.Options().refined for _, n in entered[0])
    open_ = placement.Options(candidates=None, gap_top2=float("inf"))
    every = placement.selectively_placed(tree, found, counts, engine.MODEL, names, open_).filter("rank = 1").collect()
    assert len(entered[1]) == len(queries)
    assert all(r["edge"] == whole[r["query"], 1]["edge"] and r["loglik"] == pytest.approx(whole[r["query"], 1]["loglik"], abs=1e-3) for r in every)


def test_tree_state_is_restored():
    tree = random_tree(random.Random(9), 12)
    node = next(n for n in tree.tips() if tree.parent[n] != tree.root)
    tree.prune(node)

    class Rows:
        def __init__(self, rows):
            self.rows = rows

        def collect(self):
            return self.rows

    class Session:
        def createDataFrame(self, rows, schema):  # noqa: N802
            names = [c.split()[0] for c in schema.split(", ")]
            return Rows([dict(zip(names, r, strict=True)) for r in rows])

    back = Tree.restored(tree.state(Session()))
    assert (back.parent, back.children, back.name, back.blen, back.root) == (tree.parent, tree.children, tree.name, tree.blen, tree.root)


def test_stream_with_a_replay_gives_the_tree_of_the_batch_run(spark, sf_dir, tmp_path):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").limit(6)
    keys = [r["s_suppkey"] for r in suppliers.collect()]
    for k in range(3):
        suppliers.filter(suppliers.s_suppkey.isin(keys[2 * k : 2 * k + 2])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start, fails, seen = engine.derived.tree(spark, sf_dir), [1], []
    stream = lambda: spark.readStream.schema(suppliers.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    places = str(tmp_path / "trees"), str(tmp_path / "checkpoint")

    def commit(tree, batch):
        seen.append(len(tree.tips()))
        return engine.committed_batch(spark, sf_dir, tree, batch)

    def failing(tree, batch):
        grown = commit(tree, batch)
        if len(seen) == 2 and fails.pop():
            grown.state(spark).write.parquet(places[0] + "/version=2")  # the version is written, but the batch isn't marked as done
            raise RuntimeError("lost")
        return grown

    with pytest.raises(Exception, match="lost"):
        commit_stream(stream(), start, failing, *places)
    tree = commit_stream(stream(), start, commit, *places)
    assert seen == [25, 27, 27, 29]  # the second batch twice, from the same version
    found, names, queries = engine._with_queries(spark, sf_dir, keys)
    whole = placement.committed(start, found, engine.MODEL, names, queries, engine.COMMIT)
    assert (tree.parent, tree.children, tree.name) == (whole.parent, whole.children, whole.name)
    assert tree.blen == pytest.approx(whole.blen, abs=1e-6)
    assert commit_stream(stream(), start, commit, *places).newick() == tree.newick() and len(seen) == 4  # nothing new


def test_alignments_have_equal_lengths(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x\nACGT\n>y\nAC\nGT\n")
    (tmp_path / "b.fasta").write_text(">x\nACGT\n>short\nACG\n")
    assert [r["seq"] for r in text.read_alignment(spark, str(tmp_path / "a.fasta")).orderBy("row_ix").collect()] == ["ACGT", "ACGT"]
    with pytest.raises(Exception, match="short"):
        text.read_alignment(spark, str(tmp_path / "b.fasta")).collect()
    assert text.read_fasta(spark, str(tmp_path / "b.fasta")).count() == 2
