"""Golden values, invariants, and the relational against the blocked form."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow import queries as engine
from cladeflow.functions.alphabet import MASKS
from cladeflow.functions.model import Model, gamma_p, gamma_rates, parse_best_model
from cladeflow.operators import alignment, likelihood, moves, parsimony, placement, spr, tree_relations
from cladeflow.plans.tree import Tree
from cladeflow.sources import jplace, text

MODEL = Model(rates=(1, 2.5, 1, 1, 2.5, 1), freqs=(0.3, 0.4, 0.1, 0.2), alpha=0.5)
ROWS = {"0": "WAC-CTA-ATCT", "1": "CCC-TTA-ATGT", "2": "A-C-TAG-CTCT", "3": "CTCTTAA-A-CG", "4": "CAC-TCA-A-TG"}
ROOTED = "((3:.5,4:.5)7:.3,((0:.5,1:.5)5:.5,2:.5)6:.2)8;"
UNROOTED = "(((0:.2,1:.2)5:.1,2:.2)6:.1,(3:.2,4:.2)7:0);"


def block(newick, rows=ROWS, model=MODEL, **more):
    names = list(rows)
    masks = np.array([[MASKS[rows[n][i]] for n in names] for i in range(len(rows[names[0]]))])
    return likelihood.Block(Tree.parse(newick), model, {n: i for i, n in enumerate(names)}, masks, **more)


@pytest.mark.parametrize("newick, total, first", [(ROOTED, -56.794804, -5.4918656), (UNROOTED, -58.887310, -6.1622140)])
def test_golden_logliks(newick, total, first):
    sites = block(newick).loglik()
    assert sites.sum() == pytest.approx(total, abs=1e-5) and sites[0] == pytest.approx(first, abs=1e-5)


def test_gamma_rates():
    assert gamma_rates(0.5, 4) == pytest.approx([0.033388, 0.251916, 0.820268, 2.894428], abs=1e-6)
    assert gamma_rates(0.5, 4, True) == pytest.approx([0.029078, 0.280715, 0.924773, 2.765435], abs=1e-6)
    assert gamma_rates(1.0, 1) == [1.0] and gamma_p(1.0, 2.0) == pytest.approx(1 - np.exp(-2))
    with pytest.raises(ValueError):
        gamma_rates(0.01, 4)


def test_transition_matrices():
    p = MODEL.transition(np.array([0.1, 0.3, 0.4, 0.0]))
    assert np.allclose(p.sum(axis=-1), 1) and np.allclose(p[3], np.eye(4))
    assert np.allclose(np.einsum("cij,cjk->cik", p[0], p[1]), p[2])
    assert p[0, 0, 0] == pytest.approx([0.9973, 0.0013, 0.0008, 0.0006], abs=1e-4)


def test_tip_without_data_changes_nothing_unless_transposed():
    whole = block(ROOTED, down=True)
    for edge in whole.tree.edges():
        assert whole.insertion(edge, whole.tree.blen[edge] / 3, 0.2)[:, 15].sum() == pytest.approx(-56.794804, abs=1e-5)
    seen = sorted({round(float(b.insertion(e, b.tree.blen[e] / 2, 0.1)[:, 15].sum()), 4) for b in [block(ROOTED, down=True, transposed=True)] for e in b.tree.edges()})
    assert -56.0936 in seen and -55.6684 in seen


def test_derivatives_against_goldens():
    rows = dict(zip("01234", ["WAACTCGCTA--ATTCTAAT", "CACCATGCTA--ATTGTCTT", "AG-C-TGCAG--CTTCTACT", "CGTCTTGCAA--AT-C-AAG", "CGACTTGCCA--AT-T-AAG"], strict=True))
    model = Model(rates=MODEL.rates, freqs=MODEL.freqs, alpha=1.0, ncat=1)
    b = block("(((0:.2,1:.2)5:.1,2:.2)6:.05,(3:.2,4:.2)7:.05);", rows, model, down=True)
    tree = b.tree
    six, seven = tree.children[tree.root]
    one = placement.Insertion(b, six, np.arange(20), np.full(20, 15), np.ones(20))
    at = one.derivatives(b.up[six], b.up[seven])
    for length, d1, d2 in ((0.1, -2.8899, 84.140), (0.2, 1.5432, 23.010), (0.5, 3.9588, 1.4564)):
        assert at(length) == (pytest.approx(d1, rel=1e-4), pytest.approx(d2, rel=1e-3))


def test_optimised_lengths_never_score_worse():
    rows = ROWS | {"q": "CAC-TCA-ATTG"}
    b = block(ROOTED, rows, down=True)
    mask = np.array([MASKS[c] for c in rows["q"]])
    for edge in b.tree.edges():
        one = placement.Insertion(b, edge, np.arange(12), mask, np.ones(12))
        start = one.loglik(placement.start_distal(b.tree.blen[edge]), placement.PENDANT)
        best, distal, pendant = one.optimised(4)
        assert best >= start and one.loglik(distal, pendant) == pytest.approx(best) and 0 <= distal <= b.tree.blen[edge]


def test_all_edges_at_once_are_as_edge_by_edge():
    rng = random.Random(9)
    for blen in ("", ":0"):
        rows = {n: "".join(rng.choice("ACGT-RN") for _ in range(60)) for n in [*"abcdefg", "q"]}
        tree = f"((a:.2,(b:.01,c:.3):.1):.2,((d{blen or ':.4'},e:1.5):.05,(f:.2,g:.00005){blen or ':.3'}):.1);"
        b = block(tree, rows, down=True)
        mask, edges = np.array([MASKS[c] for c in rows["q"]]), b.tree.edges()
        for weight in (np.ones(60), np.arange(60) % 3 + 0.0):
            many = placement.Insertions(b, edges, np.arange(60), mask, weight).optimised(4)
            one = [placement.Insertion(b, e, np.arange(60), mask, weight).optimised(4) for e in edges]
            assert np.allclose(np.array(many).T, one, atol=1e-6)


def test_newick():
    tree = Tree.parse("('a b':1,b:2e-1,(c[note]:1,'it''s'):3)r;")
    assert sorted(tree.name[n] for n in tree.tips()) == ["a b", "b", "c", "it's"]
    assert all(len(tree.children[n]) in (0, 2) for n in tree.preorder())
    again = Tree.parse(tree.newick())
    assert again.newick() == tree.newick() and [r[6:] for r in again.rows()] == [r[6:] for r in tree.rows()]
    assert tree.newick(collapse=1e-6).count("(") == 2
    for bad in ("(a,b)", "(a,(b);", "a,b;", "(a,);", "(a,b));"):
        with pytest.raises(ValueError):
            Tree.parse(bad)


def random_tree(names, rng):
    tree = Tree.parse(f"({names[0]}:0.1,{names[1]}:0.2);")
    for n in names[2:]:
        edge = rng.choice(tree.edges())
        tree.insert(n, edge, tree.blen[edge] * rng.random(), rng.random())
    return tree


def test_tree_edits():
    rng = random.Random(1)
    tree = random_tree([f"t{k}" for k in range(12)], rng)
    assert len(tree.tips()) == 12 and len(list(tree.preorder())) == 23
    for node in [n for n in tree.edges() if tree.parent[n] != tree.root]:
        new, before = tree.copy(), tree.newick()
        other, below, pendant = new.prune(node)
        new.graft(node, other, below, pendant)
        assert sorted(x[5] for x in new.rows() if x[4]) == sorted(x[5] for x in tree.rows() if x[4])
        a, b = (sorted((t.name[m], round(sum(t.blen[x] for x in t.path(t.root, m)[1:]), 9)) for m in t.tips()) for t in (new, tree))
        assert a == b and tree.newick() == before
    small = tree.without({"t3", "t7"})
    assert len(small.tips()) == 10 and all(len(small.children[n]) in (0, 2) for n in small.preorder())
    assert tree.hops([tree.tips()[0]])[tree.tips()[0]] == 0


def test_relational_and_blocked_forms_agree(spark, sf_dir):
    exact = engine.tree_loglik(spark, sf_dir).first()
    assert exact == engine.tree_loglik_blocked(spark, sf_dir).first()
    edges = engine.edge_logliks(spark, sf_dir).collect()
    assert {r["loglik"] for r in edges} == {exact["loglik"]} and len(edges) == 48


def test_compression_golden(spark):
    rows = ["WWAC-CTA-ATACTT", "CCCC-TTA-ATAGTT", "AA-C-TAG-CTGCTT", "CCTCTTAA-A-ACGG", "CCAC-TCA-A-ATGG"]
    msa = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "row_ix int, seq string")
    cells = alignment.encoded(alignment.wide_to_cells(msa, ["row_ix"]))
    found = alignment.site_patterns(cells, value="mask").collect()
    assert len(found) == 12 and sorted(r["weight"] for r in found) == sorted([1, 2, 1, 1, 1, 1, 1, 2, 1, 2, 1, 1])
    sites = {r["site"]: r["pattern_id"] for r in alignment.site_map(cells, alignment.site_patterns(cells, value="mask"), "mask").collect()}
    same = [9, 9, 2, 3, 10, 5, 6, 1, 11, 0, 8, 1, 4, 7, 7]
    assert all((sites[a] == sites[b]) == (same[a] == same[b]) for a in range(15) for b in range(15))


def test_placement_pipeline(spark, sf_dir, tmp_path):
    rows = engine.placements(spark, sf_dir).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query"], []).append(r)
    for group in by_query.values():
        group.sort(key=lambda r: r["rank"])
        assert sum(r["lwr"] for r in group) == pytest.approx(1) and [r["rank"] for r in group] == list(range(1, len(group) + 1))
        assert all(a["loglik"] >= b["loglik"] for a, b in zip(group, group[1:], strict=False))
    base = {(r["query"], r["edge"]): r["loglik"] for r in engine.placement_baseline(spark, sf_dir).collect()}
    assert all(r["loglik"] >= base[r["query"], r["edge"]] - 1e-9 for r in rows)
    tree = engine.derived.tree(spark, sf_dir)
    jplace.write_jplace(spark.createDataFrame(rows), tree, f"{tmp_path}/out")
    (part,) = tmp_path.glob("out/part-*")
    document = json.loads(part.read_text())
    assert all(set(x) == {"p", "n"} for x in document["placements"]) and set(document) == {"version", "tree", "fields", "metadata", "placements"}
    assert document["fields"][0] == "edge_num" and len(document["placements"]) == len(by_query)
    assert max(p[0] for x in document["placements"] for p in x["p"]) < document["tree"].count("{")


def test_queries_go_back_to_their_own_tips(spark, sf_dir):
    best = engine.placement_tip_edges(spark, sf_dir).groupBy("query").agg(F.max_by("tip", "loglik").alias("tip"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = best.join(supplier, F.col("query") == F.col("s_suppkey")).select("tip", "n_name").collect()
    assert sum(r["tip"] == r["n_name"] for r in joined) >= 0.8 * len(joined)


def test_commit_and_refinement(spark, sf_dir):
    found, names, queries = engine._with_queries(spark, sf_dir)
    tree = engine.derived.tree(spark, sf_dir)
    grown = placement.committed(tree, found, engine.MODEL, names, queries, placement.Options(candidates=2, passes=1))
    assert len(grown.tips()) == len(tree.tips()) + len(queries)
    (before,) = spr.tree_logliks([grown], found, engine.MODEL, names)
    refined, after = spr.refined(grown, found, engine.MODEL, names, queries, spr.SprOptions(radius=1))
    assert after >= before and sorted(filter(None, refined.name)) == sorted(filter(None, grown.name))


def symbol(nation, part, size):
    mix = ((nation + 3) * (part % 97 + 1) * (size + 5) + nation * nation) % 1009
    return "-" if mix % 41 == 0 else "R" if mix % 53 == 0 else "N" if mix % 61 == 0 else "ACGT"[mix % 4]


def test_commits_take_all_queries_in_their_own_columns(spark, sf_dir):
    found, names, queries = engine._with_queries(spark, sf_dir)
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").collect()
    parts = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    assert queries == [f"query_{r['s_suppkey']}" for r in suppliers] and len(names) == 25 + len(suppliers)
    for r in found.collect():
        part = r["first_site"]
        want = [symbol(n, part, parts[part]) for n in range(25)]
        want += ["ACGT"[(s["s_suppkey"] + part) % 4] if (s["s_suppkey"] * 31 + part) % 17 == 0 else symbol(s["s_nationkey"], part, parts[part]) for s in suppliers]
        assert r["pattern"] == [MASKS[x] for x in want]


def test_committed_and_refined_trees_hold_all_queries(spark, sf_dir):
    queries = {f"query_{r['s_suppkey']}" for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    for query in (engine.committed_tree, engine.refined_tree):
        tips = {r["name"] for r in query(spark, sf_dir).filter("is_tip").collect()}
        assert queries < tips and len(tips) == 25 + len(queries)


def test_placements_and_commits_search_every_edge(spark, sf_dir):
    names, tree = engine.taxa(spark, sf_dir), engine.derived.tree(spark, sf_dir)
    found = engine.stored_patterns(spark, sf_dir)
    entries = engine.counts(spark, sf_dir, engine.derived.query_cells(spark, sf_dir), found).collect()
    rows = sorted(found.select("pattern_id", "pattern").collect())
    b = likelihood.Block(tree, engine.MODEL, {n: k for k, n in enumerate(names)}, np.array([r[1] for r in rows]), down=True)
    want = {}
    for query in {r["query"] for r in entries}:
        own = [r for r in entries if r["query"] == query]
        p, m, w = (np.array([r[k] for r in own]) for k in ("pattern_id", "mask", "weight"))
        scores = {e: placement.Insertion(b, e, p, m, w.astype(float)).optimised(4) for e in tree.edges()}
        want[query] = sorted(((-x[0], e) for e, x in scores.items()))[:5]
    got = {}
    for r in engine.placements(spark, sf_dir).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["edge"], r["loglik"])
    assert got.keys() == want.keys()
    for query, best in want.items():
        assert [x[1] for _, x in sorted(got[query].items())] == pytest.approx([-x for x, _ in best], abs=1e-6)
        assert got[query][1][0] == best[0][1]
    first = min(want)
    grown, joined = engine.derived.tree(spark, sf_dir), engine._with_queries(spark, sf_dir)
    grown = placement.committed(grown, joined[0], engine.MODEL, joined[1], joined[2][:1], engine.FULL)
    tip = next(n for n in grown.tips() if grown.name[n] == f"query_{first}")
    assert grown.sibling(tip) == want[first][0][1]


def test_whole_forms_of_the_queries_with_narrow_sql(spark, sf_dir):
    base = {}
    for r in engine.placement_baseline(spark, sf_dir).collect():
        base.setdefault(r["query"], {})[r["edge"]] = round(r["loglik"], 6)
    rows = engine.placement_edge_ranking(spark, sf_dir).collect()
    assert len(rows) == 5 * len(base) and all(len(x) == 48 for x in base.values())
    for r in rows:
        order = sorted(base[r["query"]].items(), key=lambda x: (-x[1], x[0]))
        best = order[0][1]
        assert (r["edge"], r["loglik"]) == order[r["rank"] - 1]
        assert r["lwr"] == pytest.approx(np.exp(r["loglik"] - best) / sum(np.exp(x - best) for _, x in order[:5]), abs=1e-5)
        assert r["gap_top2"] == pytest.approx(best - order[1][1], abs=1e-4) and r["gap_top5"] == pytest.approx(best - order[4][1], abs=1e-4)
    columns = {}
    for r in engine.alignment_encode(spark, sf_dir).collect():
        columns.setdefault(r["site"], []).append(r["mask"])
    common = {site: int(np.bitwise_and.reduce(masks)) for site, masks in columns.items()}
    assert {r["site"]: r["state"] for r in engine.invariant_sites_all(spark, sf_dir).collect()} == {s: m.bit_length() - 1 for s, m in common.items() if m.bit_count() == 1}
    clades = {(r["region"], r["site"]): r["state"] for r in engine.invariant_sites(spark, sf_dir).collect()}
    regions = {r["n_name"]: r["n_regionkey"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    parts = {}
    for r in engine.alignment_encode(spark, sf_dir).collect():
        parts.setdefault((regions[r["taxon"]], r["site"]), []).append(r["mask"])
    common = {key: int(np.bitwise_and.reduce(masks)) for key, masks in parts.items()}
    assert clades == {key: m.bit_length() - 1 for key, m in common.items() if m.bit_count() == 1}
    nations = {r["n_nationkey"]: r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    used = {nations[r["s_nationkey"]] for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()}
    assert {(r["name"], r["missing_in"]) for r in engine.name_mismatches_all(spark, sf_dir).collect()} == {(n, "alignment") for n in nations.values() if n not in used}


def brute_fitch(tree, masks):
    score, sets = 0, {}
    for n in tree.postorder():
        if tree.children[n]:
            a, b = (sets[c] for c in tree.children[n])
            sets[n], score = (a & b, score) if a & b else (a | b, score + 1)
        else:
            sets[n] = masks[tree.name[n]]
    return score


def test_parsimony(spark):
    rng = random.Random(3)
    names = [f"t{k}" for k in range(9)]
    tree = random_tree(names, rng).renumbered()
    columns = [[rng.choice([1, 2, 4, 8, 15, 5]) for _ in names] for _ in range(40)]
    df = spark.createDataFrame([(k, 1, c) for k, c in enumerate(columns)], "pattern_id int, weight int, pattern array<int>")
    want = [brute_fitch(tree, dict(zip(names, c, strict=True))) for c in columns]
    assert [r["score"] for r in parsimony.fitch(tree, df, names).orderBy("pattern_id").collect()] == want
    unit = [[int(a != b) for b in range(4)] for a in range(4)]
    assert [r["score"] for r in parsimony.sankoff(tree, df, names, unit).orderBy("pattern_id").collect()] == want
    small = df.filter("pattern_id < 10")
    built = parsimony.stepwise_tree(small, names[:5], lambda trees: parsimony.fitch_scores(trees, small, names))
    assert sorted(built.name[n] for n in built.tips()) == names[:5]


def test_interchanges_and_repeats(spark):
    rng = random.Random(4)
    names = [f"t{k}" for k in range(7)]
    tree = random_tree(names, rng).renumbered()
    for pair in moves.interchanges(tree):
        before = tree.newick()
        moves.interchange(tree, *pair)
        assert tree.newick() != before
        moves.interchange(tree, *pair)
        assert tree.newick() == before
    columns = [[rng.choice([1, 2]) for _ in names] for _ in range(30)]
    df = spark.createDataFrame([(k, 1, c) for k, c in enumerate(columns)], "pattern_id int, weight int, pattern array<int>")
    _, score = moves.best_interchange(tree, lambda trees: [-x for x in parsimony.fitch_scores(trees, df, names)])
    assert -score <= min(sum(brute_fitch(t, dict(zip(names, c, strict=True))) for c in columns) for t in [tree.copy()] for _ in [moves.interchange(t, *moves.interchanges(t)[0])])
    below = {n: [names.index(tree.name[x]) for x in tree.preorder(n) if not tree.children[x]] for n in tree.preorder()}
    for r in moves.site_repeats(tree, df, names).collect():
        first = min(k for k, c in enumerate(columns) if all(c[x] == columns[r["pattern_id"]][x] for x in below[r["node_id"]]))
        assert r["class"] == first


def test_constant_columns():
    tree = Tree.parse(ROOTED)
    some = likelihood.constant_likelihoods(tree, MODEL)
    assert 0 < sum(some) < 1 and likelihood.felsenstein_correction(-5.0, 2.0, some) < -5 and likelihood.stamatakis_correction(-5.0, [1, 0, 0, 0], some) == pytest.approx(-5 + np.log(some[0]))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "g.fasta").write_text("\n>a b\nAC GT\nAC\n>c\r\nACGTA-\n")
    assert [(r["name"], r["seq"]) for r in text.read_alignment(spark, f"{tmp_path}/g.fasta").orderBy("row_ix").collect()] == [("a b", "ACGTAC"), ("c", "ACGTA-")]
    (tmp_path / "i.phy").write_text("2 8\na ACGT\nb AC-T\n\nGGGG\nCC CC\n")
    assert [(r["name"], r["seq"]) for r in text.read_alignment(spark, f"{tmp_path}/i.phy").orderBy("row_ix").collect()] == [("a", "ACGTGGGG"), ("b", "AC-TCCCC")]
    (tmp_path / "bad.phy").write_text("1 5\na ACGT\n")
    with pytest.raises(Exception, match="wrong number of sites"):
        text.read_phylip(spark, f"{tmp_path}/bad.phy").collect()
    (tmp_path / "t.nwk").write_text("(a:1,b:2);")
    assert len(text.read_tree(spark, f"{tmp_path}/t.nwk").tips()) == 2
    model = parse_best_model("GTR{1/2/3/4/5/6}+FU{0.1/0.2/0.3/0.4}+G8m{0.7}, part1 = 1-100\nother")
    assert (model.rates, model.ncat, model.alpha) == ((1, 2, 3, 4, 5, 6), 8, 0.7) and model.freqs == pytest.approx((0.1, 0.2, 0.3, 0.4))
    assert parse_best_model("GTR+FC").ncat == 1 and parse_best_model("GTR+FC").empirical
    with pytest.raises(ValueError):
        parse_best_model("HKY+G")
    assert text.check_output(f"{tmp_path}/x") and pytest.raises(ValueError, text.check_output, f"{tmp_path}/no/x")


def test_checks(spark):
    msa = spark.createDataFrame([("g", "a", "ACGZ"), ("g", "a", "AC"), ("g", "", "acgt")], "gene_id string, name string, seq string")
    assert {r["name"]: r["n"] for r in alignment.bad_names(msa).collect()} == {"a": 2, "": 1}
    assert [(r["site"], r["sym"]) for r in alignment.bad_symbols(alignment.wide_to_cells(msa, ["name"])).collect()] == [(4, "Z")]
    assert alignment.unequal_lengths(msa).count() == 1
    cells = alignment.wide_to_cells(msa.filter("name = 'a'"), ["name"])
    assert alignment.empirical_frequencies(cells.filter("sym <> 'Z'")) == pytest.approx([0.4, 0.4, 0.2, 0.0], abs=1e-6)
    assert alignment.shared_names(msa.select("name"), msa.select("name")).count() == 2
    for wrong in ({"rates": (1, 2)}, {"freqs": (0.5, 0.5)}, {"ncat": 9}, {"pinv": 1.0}):
        with pytest.raises(ValueError):
            Model(**wrong)


def test_tree_relations(spark):
    tree = random_tree([f"t{k}" for k in range(8)], random.Random(5)).renumbered()
    nodes = tree.nodes(spark)
    for r in tree_relations.tip_distances(nodes, tree_relations.ancestors(nodes)).collect():
        a, b = (next(n for n in tree.tips() if tree.name[n] == r[k]) for k in ("tip_a", "tip_b"))
        path = tree.path(a, b)
        top = min(path, key=lambda n: len(tree.path(tree.root, n)))
        assert r["hops"] == len(path) - 1 and r["lca"] == top
        assert r["length"] == pytest.approx(sum(tree.blen[n] for n in path if n != top))


def test_invariant_share_and_ascertainment(spark):
    df = spark.createDataFrame([([1, 1, 5], -2.0), ([1, 2, 4], -3.0)], "pattern array<int>, ln_lk double")
    model = Model(freqs=(0.4, 0.3, 0.2, 0.1), pinv=0.25)
    got = [r["ln_lk_inv"] for r in likelihood.with_invariant(df, model).orderBy(F.desc("ln_lk")).collect()]
    assert got == pytest.approx([np.log(0.75 * np.exp(-2) + 0.25 * 0.4), np.log(0.75 * np.exp(-3))])
    deep = spark.createDataFrame([([1, 1, 5], -2000.0), ([1, 2, 4], -2000.0)], "pattern array<int>, ln_lk double")
    got = {tuple(r["pattern"]): r["ln_lk_inv"] for r in likelihood.with_invariant(deep, model).collect()}
    assert got[1, 1, 5] == pytest.approx(np.log(0.25 * 0.4)) and got[1, 2, 4] == pytest.approx(np.log(0.75) - 2000)
    assert likelihood.lewis_correction(-10.0, 5.0, [0.1, 0.1]) == pytest.approx(-10 - 5 * np.log(0.8))


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and json.dumps(sorted(entry.queries()))
