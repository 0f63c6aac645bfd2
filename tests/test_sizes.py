"""What the registered queries are, and steps whose work must not grow with all pairs of rows."""

import inspect

import numpy as np
import pytest

import __spark_entry__ as entry
from cladeflow import queries as engine
from cladeflow.operators import likelihood, placement
from cladeflow.plans import derived
from cladeflow.plans.tree import Tree


def test_registered_queries_take_a_session_and_a_folder():
    for name, query in entry.queries().items():
        assert list(inspect.signature(query).parameters) == ["spark", "sf_dir"], name


def odd_tables(spark, folder, sf_dir):
    """Keys that repeat, are null or far apart, or have no nation."""
    suppliers = [(k * step, n) for step in (1, 68, 34) for k in range(1, 9) for n in (3, 7)] + [(None, 3), (None, 4), (5, None), (5 + 68, None), (6, 99), (0, 3)]
    parts = [(p, p * 7 % 50 + 1) for p in range(40)] + [(p + 6596 * 3, p * 7 % 50 + 1) for p in range(30)] + [(7, 7 * 7 % 50 + 1), (None, 3), (100_000, None)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(p, "gene", s) for p, s in parts], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("below", [0, -9])
def test_counts_are_those_of_all_pairs_of_suppliers_and_parts(spark, sf_dir, tmp_path, below):
    folder = odd_tables(spark, tmp_path, sf_dir)
    if below:  # a negative key: no key may be taken modulo the period
        spark.createDataFrame([(below, 3), (below - 68, 3)], "s_suppkey bigint, s_nationkey int").write.mode("append").parquet(f"{folder}/supplier.parquet")
    found = engine.stored_patterns(spark, folder)
    rows = lambda of: sorted((tuple(r) for r in of.select("query", "pattern_id", "mask", "weight").collect()), key=str)
    want = rows(engine.counts(spark, folder, derived.query_cells(spark, folder), found))
    own = engine.Queries(spark, folder, found)
    assert rows(own.all(own.counts)) == want and len(want) > 1000


def test_equal_queries_are_counted_once(spark, sf_dir, tmp_path):
    folder = odd_tables(spark, tmp_path, sf_dir)
    more = spark.createDataFrame([(1000 * 68 + k, 3) for k in range(680)], "s_suppkey bigint, s_nationkey int")
    more.write.mode("append").parquet(f"{folder}/supplier.parquet")
    own = engine.Queries(spark, folder, engine.stored_patterns(spark, folder))
    assert own.members.count() > 680 and own.counts.select("query").distinct().count() < 150


def test_cells_are_grouped_where_they_are_made(spark, sf_dir):
    """A part's cells aren't shuffled, and no task makes those of a whole file."""
    for query in (engine.invariant_sites, engine.invariant_sites_all):
        found = query(spark, sf_dir)
        assert found.collect() is not None and found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in plan


def test_sequences_come_from_ranges_of_sites(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "RANGE", 2)
    folder = odd_tables(spark, tmp_path, sf_dir)
    cells = derived.cells(spark, folder).filter("site is not null").collect()
    want = {t: "".join(s for _, s in sorted((c["site"], c["sym"] or "") for c in cells if c["taxon"] == t)) for t in {c["taxon"] for c in cells}}
    monkeypatch.setattr(derived, "cells", lambda spark, folder, of=derived.cells: of(spark, folder).filter("site is not null"))
    msa = engine._msa(spark, folder)
    assert {r["name"]: r["seq"] for r in msa.collect()} == want
    assert "range" in msa._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("share", [0.1, 0.8, 1.0])
def test_terms_by_state_are_those_by_entry(share):
    """Queries with many states a pattern take terms by (state, pattern); absent states and those of several bases count as before."""
    rng = np.random.default_rng(5)
    tree = Tree.parse("(((a:.1,b:.2):.05,c:.3):.1,(d:0,e:.4):.2,f:.01);")
    block = likelihood.Block(tree, engine.MODEL, {n: k for k, n in enumerate("abcdef")}, 1 << rng.integers(0, 4, (50, 6)), down=True)
    every = np.array([(p, m) for p in range(50) for m in (1, 2, 4, 8, 5, 15)])
    own = every[rng.random(len(every)) < share]
    weight = rng.integers(1, 9, len(own)).astype(float)
    for passes in (1, 4):
        want = np.array([placement.Insertion(block, e, *own.T, weight).optimised(passes) for e in tree.edges()]).T
        got = np.array(placement.StateInsertions(block, tree.edges(), *own.T, weight).optimised(passes))
        assert np.isfinite(got).all() and got[0] == pytest.approx(want[0], abs=1e-6) and got[1:] == pytest.approx(want[1:], abs=1e-5)


def test_entries_of_a_query_are_sent_for_many_edges_at_once(spark, sf_dir):
    tree = derived.tree(spark, sf_dir)
    found = engine.stored_patterns(spark, sf_dir)
    own = engine.Queries(spark, sf_dir, found).counts
    names = engine.taxa(spark, sf_dir)
    out = placement.optimised_scores(tree, placement.sent_alignment(found, names), own, placement.every_edge(own, tree), engine.MODEL, names, placement.Options(passes=1))
    assert out.count() == own.select("query").distinct().count() * len(tree.edges())
    assert placement.EDGES * 2 >= len(tree.edges()) and placement.TOGETHER < placement.EDGES


def test_joint_patterns_have_a_column_for_each_sequence(spark, sf_dir, tmp_path):
    """Patterns of taxa and queries are those of all their cells, and suppliers with equal sequences share a column."""
    suppliers = [(k, k % 3 + (30 if k % 5 == 0 else 0)) for k in range(1, 13)] + [(k + 68 * 3 * 5, k % 3 + (30 if k % 5 == 0 else 0)) for k in range(1, 8)] + [(100, None)]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    parts = [(p, p * 7 % 50 + 1) for p in range(60)] + [(p + 6596 * 3, p * 7 % 50 + 1) for p in range(30)] + [(9000, None)]
    spark.createDataFrame([(p, "gene", s) for p, s in parts], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    found, names, queries = engine._with_queries(spark, str(tmp_path))
    assert queries == [f"query_{k}" for k, _ in sorted(suppliers)] and len(names) == 25 + 20
    cells = derived.query_cells(spark, str(tmp_path)).select("site", derived.F.concat(derived.F.lit("query_"), "query").alias("name"), derived.mask_of(derived.F.col("sym")).alias("mask"))
    cells = cells.unionByName(derived.cells(spark, str(tmp_path)).select("site", derived.F.col("taxon").alias("name"), derived.mask_of(derived.F.col("sym")).alias("mask"))).collect()
    columns = {}
    for c in cells:
        columns.setdefault(c["site"], {})[c["name"]] = c["mask"]
    want = {}
    for site, column in columns.items():
        want.setdefault(tuple(column[n] for n in names), []).append(site)
    rows = found.orderBy("pattern_id").collect()
    assert {tuple(r["pattern"][names.index(n)] for n in names): (r["first_site"], r["weight"]) for r in rows} == {p: (min(s), len(s)) for p, s in want.items()}
    assert [r["pattern_id"] for r in rows] == list(range(len(want))) and [r["first_site"] for r in rows] == sorted(min(s) for s in want.values())
    assert {len(r["pattern"]) for r in rows} == {25 + 13}  # 7 of 20 are copies


def test_patterns_at_once_shrink_as_trees_grow():
    tree = Tree.parse("((a:.1,b:.2):.1,c:.3);")
    assert likelihood.at_once(tree, 512) == 512
    for k in range(6000):
        tree.insert(f"q{k}", 1, tree.blen[1] / 2, 0.01)
    assert likelihood.at_once(tree, 512) * len(tree.parent) <= likelihood.HELD and likelihood.at_once(tree, 4096) < 512


def test_rankings_of_equal_queries_come_from_one_of_them(spark, sf_dir, tmp_path, monkeypatch):
    folder, scored = str(tmp_path), []
    spark.createDataFrame([(k * step, n) for step in (1, 69) for k, n in ((1, 3), (2, 7), (3, 3))], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    for name in ("nation", "region", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")

    def scores(tree, patterns, counts, *rest, of=placement.baseline_scores):
        scored.append({r[0] for r in counts.select("query").distinct().collect()})
        return of(tree, patterns, counts, *rest)

    monkeypatch.setattr(placement, "baseline_scores", scores)
    like = {r["query"]: r["like"] for r in derived.members(spark, folder, derived.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")).collect()}
    rows = {}
    for r in engine.placement_ranking(spark, folder).collect():
        rows.setdefault(r["query"], []).append(tuple(r)[1:])
    assert rows.keys() == like.keys() and all(sorted(rows[q]) == sorted(rows[first]) and len(rows[q]) == 5 for q, first in like.items())
    assert scored == [set(like.values())] and len(scored[0]) < len(like)


def test_counts_are_made_where_they_are_scored(spark, sf_dir):
    """What is dealt out by block and chunk are counts of sites; those of the queries, many times as many, aren't shuffled."""
    found, tree, names = engine.stored_patterns(spark, sf_dir), derived.tree(spark, sf_dir), engine.taxa(spark, sf_dir)
    own = engine.Queries(spark, sf_dir, found)
    scores = placement.baseline_scores(tree, found, own.dealt, derived.MODEL, names)
    plan = scores._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(block" in line]
    assert len(dealt) == 2 and sum("REPARTITION_BY_NUM" in line for line in dealt) == 1  # the other one deals out patterns
    rows = lambda of: {(r["query"], r["edge"]): r["loglik"] for r in of.collect()}
    want, got = rows(placement.baseline_scores(tree, found, own.counts, derived.MODEL, names)), rows(scores)
    assert got.keys() == want.keys() and len(got) > 100 and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-12)


def test_counts_of_factors_and_nations_below_zero(spark, sf_dir, tmp_path):
    """Remainders of negative numbers depend on more than the factor's remainder."""
    for at, (nations, sizes) in enumerate([((3, -2000, -4), (1, 50)), ((3, 24), (1, -40, -30_000)), ((3, -2), (7, None))]):
        folder = str(tmp_path / str(at))
        spark.createDataFrame([(k, nations[k % len(nations)]) for k in range(1, 60)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
        spark.createDataFrame([(p, "gene", sizes[p % len(sizes)]) for p in range(300)], "p_partkey bigint, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
        for name in ("nation", "region"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        found = engine.stored_patterns(spark, folder)
        rows = lambda of: sorted(tuple(r) for r in of.select("query", "pattern_id", "mask", "weight").collect())
        own = engine.Queries(spark, folder, found)
        assert rows(own.all(own.counts)) == rows(engine.counts(spark, folder, derived.query_cells(spark, folder), found))


def few_sequences(spark, folder, sf_dir):
    """Six suppliers of three sequences; like: the first supplier with the same one."""
    spark.createDataFrame([(k * step, n) for step in (1, 69) for k, n in ((1, 3), (2, 7), (3, 3))], "s_suppkey bigint, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    for name in ("nation", "region", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return {r["query"]: r["like"] for r in derived.members(spark, folder, derived.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")).collect()}


def test_equal_queries_are_ranked_once(spark, sf_dir, tmp_path, monkeypatch):
    like, ranked = few_sequences(spark, str(tmp_path), sf_dir), []
    want = {tuple(r) for r in placement.ranked(engine.placement_baseline(spark, str(tmp_path)), 5).select("query", "edge", "rank", "loglik").collect()}

    def ranks(scores, *rest, of=placement.ranked):
        ranked.append({r[0] for r in scores.select("query").distinct().collect()})
        return of(scores, *rest)

    monkeypatch.setattr(placement, "ranked", ranks)
    got = {tuple(r)[:4] for r in engine.placement_edge_ranking(spark, str(tmp_path)).select("query", "edge", "rank", "loglik").collect()}
    assert got == want and len(got) == 5 * len(like) and ranked == [set(like.values())] and len(ranked[0]) < len(like)


def test_ranking_deals_out_counts_of_sites_only(spark, sf_dir):
    plan = engine.placement_ranking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(block" in line]
    assert len(dealt) == 2 and sum("REPARTITION_BY_NUM" in line for line in dealt) == 1
    assert sum("Exchange hashpartitioning(part" in line and "REPARTITION_BY_NUM" in line for line in plan) == 2  # not joined into one task


def test_tip_edges_are_all_that_is_scored_for_tips(spark, sf_dir, tmp_path, monkeypatch):
    like, asked, score = few_sequences(spark, str(tmp_path), sf_dir), [], placement.baseline_scores

    def scores(*args):
        asked.append(args[6] if len(args) > 6 else args[0].edges())
        return score(*args)

    monkeypatch.setattr(placement, "baseline_scores", scores)
    tree = derived.tree(spark, str(tmp_path))
    got = {(r["query"], r["tip"]): r["loglik"] for r in engine.placement_tip_edges(spark, str(tmp_path)).collect()}
    assert asked == [tree.tips()] and len(asked[0]) < len(tree.edges())
    want = {(r["query"], tree.name[r["edge"]]): r["loglik"] for r in engine.placement_baseline(spark, str(tmp_path)).collect() if r["edge"] in tree.tips()}
    assert got.keys() == want.keys() and len(got) == 25 * len(like) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
