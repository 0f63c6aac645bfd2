"""The same results as DuckDB SQL, written from the definitions and not from the Spark plans.

In the derived tree, polytomies are resolved with branches of length 0, over which nothing changes; so SQL takes the
products over all nations of a region, and over all regions.
"""

from __future__ import annotations

from ..functions.alphabet import ALL, MASKS, MISSING, STATES
from .derived import COSTS, MODEL
from .tree import PENDANT


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


def _symbol(nation: str, part: str, size: str) -> str:
    mix = f"((({nation}::BIGINT + 3) * ({part} % 97 + 1) * ({size} + 5) + {nation} * {nation}) % 1009)"
    return f"CASE WHEN {mix} % 41 = 0 THEN '-' WHEN {mix} % 53 = 0 THEN 'R' WHEN {mix} % 61 = 0 THEN 'N' ELSE substr('ACGT', (1 + {mix} % 4)::INTEGER, 1) END"


def _mask(sym: str) -> str:
    return f"CASE upper({sym}) " + " ".join(f"WHEN '{s}' THEN {m}" for s, m in MASKS.items()) + f" ELSE {ALL} END"


CELLS = f"""
cells AS (
  SELECT p_brand AS gene_id, p_partkey AS site, n_name AS taxon, n_nationkey AS row_ix, n_regionkey AS region, {_symbol("n_nationkey", "p_partkey", "p_size")} AS sym
  FROM part, nation
), masks AS (SELECT *, {_mask("sym")} AS mask FROM cells)
"""

QUERY_CELLS = f"""
query_cells AS (
  SELECT query, site, {_mask("sym")} AS mask FROM (
    SELECT s_suppkey AS query, p_partkey AS site,
      CASE WHEN (s_suppkey * 31 + p_partkey) % 17 = 0 THEN substr('ACGT', (1 + (s_suppkey + p_partkey) % 4)::INTEGER, 1) ELSE {_symbol("s_nationkey", "p_partkey", "p_size")} END AS sym
    FROM supplier, part
  )
)
"""


def _patterns(value: str, keys: str = "") -> str:
    own = f"{keys}, " if keys else ""
    column = f"string_agg({value}::VARCHAR, '{'' if value == 'sym' else ','}' ORDER BY row_ix)"
    return f"""
cols AS (SELECT {own}site, {column} AS pattern FROM masks GROUP BY {own}site),
pats AS (
  SELECT {own}pattern, min(site) AS first_site, count(*) AS weight, (row_number() OVER ({f"PARTITION BY {keys} " if keys else ""}ORDER BY min(site)) - 1)::INTEGER AS pattern_id
  FROM cols GROUP BY {own}pattern
)
"""


def _model() -> str:
    values, v, inverse = MODEL.eigen()
    basis = [(i, j, float(values[k]), float(v[i, k] * inverse[k, j])) for i in range(4) for j in range(4) for k in range(4)]
    cats = [(c, r, w) for c, (r, w) in enumerate(zip(MODEL.site_rates, MODEL.weights, strict=True))]
    return f"""
basis(i, j, lam, vv) AS (VALUES {_values(basis)}),
cats(cat, rate, cat_weight) AS (VALUES {_values(cats)}),
states(state, pi) AS (VALUES {_values(list(enumerate(MODEL.freqs)))}),
lengths AS (
  SELECT 'n' || n_nationkey AS node, (1 + (n_nationkey * 7) % 13) / 100.0::DOUBLE AS blen FROM nation
  UNION ALL SELECT 'r' || r_regionkey, (1 + (r_regionkey * 7) % 13) / 100.0::DOUBLE FROM region
),
trans AS (
  SELECT node, cat, i, j, sum(vv * (exp(lam * rate * blen) - 1)) + CASE WHEN i = j THEN 1 ELSE 0 END AS p
  FROM lengths, cats, basis GROUP BY node, cat, i, j
)
"""


def _vectors(keys: str = "") -> str:
    """tip_sent, region_up and region_sent for the patterns; root."""
    own = f"{keys}, " if keys else ""
    on = "".join(f" AND m.{k} = p.{k}" for k in keys.split(", ") if k)
    mown = "".join(f"m.{k}, " for k in keys.split(", ") if k)
    return f"""
pm AS (SELECT {"".join(f"p.{k}, " for k in keys.split(", ") if k)}p.pattern_id, m.row_ix, m.region, m.mask FROM pats p JOIN masks m ON m.site = p.first_site{on}),
tip_sent AS (
  SELECT {mown}m.pattern_id, m.region, m.row_ix, t.cat, t.i AS state, sum(t.p * (m.mask >> t.j & 1)) AS value
  FROM pm m JOIN trans t ON t.node = 'n' || m.row_ix GROUP BY ALL
),
region_up AS (SELECT {own}pattern_id, region, cat, state, product(value) AS value FROM tip_sent GROUP BY ALL),
region_sent AS (
  SELECT {mown}m.pattern_id, m.region, m.cat, t.i AS state, sum(t.p * m.value) AS value
  FROM region_up m JOIN trans t ON t.node = 'r' || m.region AND t.cat = m.cat AND t.j = m.state GROUP BY ALL
),
root AS (SELECT {own}pattern_id, cat, state, product(value) AS value FROM region_sent GROUP BY ALL),
lk AS (SELECT {own}pattern_id, sum(cat_weight * pi * value) AS lk FROM root JOIN cats USING (cat) JOIN states USING (state) GROUP BY ALL)
"""


COUNTS = """
site_pattern AS (SELECT site, pattern_id FROM cols JOIN pats USING (pattern)),
counts AS (SELECT query, pattern_id, mask, count(*) AS weight FROM query_cells JOIN site_pattern USING (site) GROUP BY ALL)
"""

TIP_SCORES = f"""
moved AS (
  SELECT kind, row_ix, cat, i, j, sum(vv * (exp(lam * rate * len) - 1)) + CASE WHEN i = j THEN 1 ELSE 0 END AS p
  FROM (
    SELECT 'half' AS kind, n_nationkey AS row_ix, (1 + (n_nationkey * 7) % 13) / 200.0::DOUBLE AS len FROM nation
    UNION ALL SELECT 'pendant', NULL, {PENDANT!r}
  ), cats, basis GROUP BY kind, row_ix, cat, i, j
),
region_base AS (SELECT a.pattern_id, a.region, a.cat, a.state, r.value / a.value AS value FROM region_sent a JOIN root r USING (pattern_id, cat, state)),
region_down AS (
  SELECT b.pattern_id, b.region, b.cat, t.i AS state, sum(t.p * b.value) AS value
  FROM region_base b JOIN trans t ON t.node = 'r' || b.region AND t.cat = b.cat AND t.j = b.state GROUP BY ALL
),
tip_base AS (
  SELECT s.pattern_id, s.row_ix, s.cat, s.state, d.value * u.value / s.value AS value
  FROM tip_sent s JOIN region_up u USING (pattern_id, region, cat, state) JOIN region_down d USING (pattern_id, region, cat, state)
),
upper_half AS (SELECT b.pattern_id, b.row_ix, b.cat, m.i AS state, sum(m.p * b.value) AS value FROM tip_base b JOIN moved m ON m.kind = 'half' AND m.row_ix = b.row_ix AND m.cat = b.cat AND m.j = b.state GROUP BY ALL),
lower_half AS (SELECT t.pattern_id, t.row_ix, m.cat, m.i AS state, sum(m.p * (t.mask >> m.j & 1)) AS value FROM pm t JOIN moved m ON m.kind = 'half' AND m.row_ix = t.row_ix GROUP BY ALL),
edge_state AS (
  SELECT a.pattern_id, a.row_ix, q.j AS tip_state, sum(cat_weight * pi * a.value * b.value * q.p) AS lk
  FROM upper_half a JOIN lower_half b USING (pattern_id, row_ix, cat, state) JOIN cats USING (cat) JOIN states USING (state)
  JOIN moved q ON q.kind = 'pendant' AND q.cat = a.cat AND q.i = a.state GROUP BY ALL
),
edge_mask AS (SELECT pattern_id, row_ix, mask, ln(sum(lk)) AS ln_lk FROM edge_state JOIN (SELECT unnest(range(1, 16)) AS mask) ON mask >> tip_state & 1 = 1 GROUP BY ALL),
scores AS (
  SELECT c.query, n.n_name AS tip, round(sum(c.weight * e.ln_lk), 6) AS loglik
  FROM counts c JOIN edge_mask e USING (pattern_id, mask) JOIN nation n ON n.n_nationkey = e.row_ix GROUP BY ALL
)
"""


#: The derived tree in pre-order: the root's pairs of regions are nodes 1 to 3, and each region has a block of nine nodes:
#: itself, its pairs of nations, and its nations. ``nation_at`` and ``region_at`` number the nations and the regions in the tree's order.
TREE = """
ranks AS (
  SELECT n_nationkey AS row_ix, n_regionkey AS region, dense_rank() OVER (ORDER BY n_regionkey) AS region_at, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS nation_at FROM nation
),
tree_nodes AS (
  SELECT 0 AS node, NULL::INTEGER AS parent, 0.0::DOUBLE AS len, false AS is_tip
  UNION ALL SELECT k, k - 1, 0.0, false FROM range(1, 4) AS t(k)
  UNION ALL SELECT 4 + 9 * (region_at - 1), CASE WHEN region_at = 1 THEN 3 ELSE 5 - region_at END, (1 + (region * 7) % 13) / 100.0::DOUBLE, false FROM (SELECT DISTINCT region, region_at FROM ranks)
  UNION ALL SELECT 4 + 9 * (region_at - 1) + k, 3 + 9 * (region_at - 1) + k, 0.0, false FROM (SELECT DISTINCT region_at FROM ranks), range(1, 4) AS t(k)
  UNION ALL SELECT 7 + 9 * (region_at - 1) + nation_at, 4 + 9 * (region_at - 1) + least(5 - nation_at, 3), (1 + (row_ix * 7) % 13) / 100.0::DOUBLE, true FROM ranks
),
below AS (
  WITH RECURSIVE up(tip, node) AS (SELECT node, node FROM tree_nodes WHERE is_tip UNION ALL SELECT u.tip, n.parent FROM up u JOIN tree_nodes n USING (node) WHERE n.parent IS NOT NULL)
  SELECT u.node, r.row_ix FROM up u JOIN ranks r ON u.tip = 7 + 9 * (r.region_at - 1) + r.nation_at
)
"""

#: Of every edge, named by the node below it: the vector of what is below, and that of the rest as it arrives at its upper end.
EDGE_VECTORS = """
region_base AS (SELECT a.pattern_id, a.region, a.cat, a.state, r.value / a.value AS value FROM region_sent a JOIN root r USING (pattern_id, cat, state)),
region_down AS (
  SELECT b.pattern_id, b.region, b.cat, t.i AS state, sum(t.p * b.value) AS value
  FROM region_base b JOIN trans t ON t.node = 'r' || b.region AND t.cat = b.cat AND t.j = b.state GROUP BY ALL
),
edge_vec AS (
  SELECT s.pattern_id, (7 + 9 * (region_at - 1) + nation_at)::INTEGER AS edge, cat, state, (p.mask >> state & 1)::DOUBLE AS low, d.value * u.value / s.value AS high
  FROM tip_sent s JOIN ranks USING (row_ix, region) JOIN pm p USING (pattern_id, row_ix, region) JOIN region_up u USING (pattern_id, region, cat, state) JOIN region_down d USING (pattern_id, region, cat, state)
  UNION ALL
  SELECT pattern_id, (4 + 9 * (region_at - 1) + k)::INTEGER, cat, state, product(CASE WHEN nation_at <= 5 - k THEN s.value ELSE 1 END), any_value(d.value) * product(CASE WHEN nation_at <= 5 - k THEN 1 ELSE s.value END)
  FROM tip_sent s JOIN ranks USING (row_ix, region) JOIN region_down d USING (pattern_id, region, cat, state), range(1, 4) AS t(k) GROUP BY pattern_id, region_at, k, cat, state
  UNION ALL
  SELECT pattern_id, (4 + 9 * (region_at - 1))::INTEGER, cat, state, u.value, b.value FROM region_up u JOIN region_base b USING (pattern_id, region, cat, state) JOIN (SELECT DISTINCT region, region_at FROM ranks) USING (region)
  UNION ALL
  SELECT pattern_id, k::INTEGER, cat, state, product(CASE WHEN region_at <= 5 - k THEN s.value ELSE 1 END), product(CASE WHEN region_at <= 5 - k THEN 1 ELSE s.value END)
  FROM region_sent s JOIN (SELECT DISTINCT region, region_at FROM ranks) USING (region), range(1, 4) AS t(k) GROUP BY pattern_id, k, cat, state
)
"""

ALL_SCORES = f"""
moved AS (
  SELECT edge, cat, i, j, sum(vv * (exp(lam * rate * len) - 1)) + CASE WHEN i = j THEN 1 ELSE 0 END AS p
  FROM (SELECT node AS edge, len / 2 AS len FROM tree_nodes WHERE node > 0 UNION ALL SELECT -1, {PENDANT!r}), cats, basis GROUP BY edge, cat, i, j
),
halves AS (
  SELECT v.pattern_id, v.edge, v.cat, m.i AS state, sum(m.p * v.low) AS low, sum(m.p * v.high) AS high
  FROM edge_vec v JOIN moved m ON m.edge = v.edge AND m.cat = v.cat AND m.j = v.state GROUP BY ALL
),
edge_state AS (
  SELECT h.pattern_id, h.edge, q.j AS tip_state, sum(cat_weight * pi * h.low * h.high * q.p) AS lk
  FROM halves h JOIN cats USING (cat) JOIN states USING (state) JOIN moved q ON q.edge = -1 AND q.cat = h.cat AND q.i = h.state GROUP BY ALL
),
edge_mask AS (SELECT pattern_id, edge, mask, ln(sum(lk)) AS ln_lk FROM edge_state JOIN (SELECT unnest(range(1, 16)) AS mask) ON mask >> tip_state & 1 = 1 GROUP BY ALL),
scores AS (SELECT c.query, e.edge, round(sum(c.weight * e.ln_lk), 6) AS loglik FROM counts c JOIN edge_mask e USING (pattern_id, mask) GROUP BY ALL)
"""

#: The five best of ``scores``, with weight ratios and gaps.
RANKED = """
order_of AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY loglik DESC, edge) AS rank FROM scores),
kept AS (SELECT *, max(loglik) OVER w AS best, max(CASE WHEN rank = 2 THEN loglik END) OVER w AS second, max(CASE WHEN rank = 5 THEN loglik END) OVER w AS fifth FROM order_of WHERE rank <= 5 WINDOW w AS (PARTITION BY query))
"""

PLACES = f"""
places AS (SELECT n_nationkey, dense_rank() OVER (ORDER BY n_regionkey) AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation),
wide AS (
  SELECT pattern_id, {", ".join(f"max(CASE WHEN r = {r} AND n = {n} THEN mask END) AS m{r}_{n}" for r in range(1, 6) for n in range(1, 6))}
  FROM pats JOIN masks ON site = first_site JOIN places ON n_nationkey = row_ix GROUP BY pattern_id
)
"""


def _merges() -> list[tuple[str, str, str]]:
    """(left, right, new): regions' and nations' ranks give the left-deep order."""
    out = []
    for r in range(1, 6):
        at = f"m{r}_1"
        for n in range(2, 6):
            out.append((at, f"m{r}_{n}", f"u{r}_{n}"))
            at = f"u{r}_{n}"
    at = "u1_5"
    for r in range(2, 6):
        out.append((at, f"u{r}_5", f"t{r}"))
        at = f"t{r}"
    return out


def _sankoff() -> str:
    tips = ", ".join(f"CASE WHEN m{r}_{n} >> {s} & 1 = 1 THEN 0.0::DOUBLE ELSE 1e9 END AS m{r}_{n}_{s}" for r in range(1, 6) for n in range(1, 6) for s in range(4))
    steps, last = [f"s0 AS (SELECT pattern_id, {tips} FROM wide)"], "s0"
    for k, (a, b, new) in enumerate(_merges(), 1):
        side = lambda x, s: "least(" + ", ".join(f"{x}_{t} + {COSTS[s][t]}" for t in range(4)) + ")"
        steps.append(f"s{k} AS (SELECT *, {', '.join(f'{side(a, s)} + {side(b, s)} AS {new}_{s}' for s in range(4))} FROM {last})")
        last = f"s{k}"
    return f"{PLACES}, {', '.join(steps)} SELECT pattern_id, weight, least(t5_0, t5_1, t5_2, t5_3) AS score FROM {last} JOIN pats USING (pattern_id)"


def _fitch() -> str:
    steps, last = [], "wide"
    for k, (a, b, out) in enumerate(_merges(), 1):
        steps.append(f"s{k} AS (SELECT *, CASE WHEN {a} & {b} <> 0 THEN {a} & {b} ELSE {a} | {b} END AS {out}, ({a} & {b} = 0)::INTEGER AS x{k} FROM {last})")
        last = f"s{k}"
    total = " + ".join(f"x{i}" for i in range(1, k + 1))
    return f"""
{PLACES},
{", ".join(steps)}
SELECT pattern_id, weight, {total} AS score FROM {last} JOIN pats USING (pattern_id)
"""


RINGS = """
centres AS (SELECT n.node AS prune_root, n.parent AS up, p.parent AS grandparent, s.node AS sibling FROM tree_nodes n JOIN tree_nodes p ON p.node = n.parent JOIN tree_nodes s ON s.parent = n.parent AND s.node <> n.node WHERE p.parent IS NOT NULL),
links AS (SELECT parent AS near, node AS far, node AS edge FROM tree_nodes WHERE parent IS NOT NULL UNION ALL SELECT node, parent, node FROM tree_nodes WHERE parent IS NOT NULL),
walk(prune_root, edge, ring, far) AS (
  SELECT c.prune_root, l.edge, 0, l.far FROM centres c JOIN links l ON l.near IN (c.sibling, c.grandparent) AND l.far <> c.up
  UNION ALL SELECT w.prune_root, l.edge, w.ring + 1, l.far FROM walk w JOIN links l ON l.near = w.far AND l.edge <> w.edge WHERE w.ring < 4
)
"""

#: A tip moved to the middle of another one's branch, whose vector is then that of both behind the branch's upper half.
REGRAFTS = """
halves AS (
  SELECT n_nationkey AS row_ix, cat, i, j, sum(vv * (exp(lam * rate * (1 + (n_nationkey * 7) % 13) / 200.0::DOUBLE) - 1)) + CASE WHEN i = j THEN 1 ELSE 0 END AS p
  FROM nation, cats, basis GROUP BY n_nationkey, cat, i, j
),
low AS (SELECT m.pattern_id, m.region, m.row_ix, h.cat, h.i AS state, sum(h.p * (m.mask >> h.j & 1)) AS value FROM pm m JOIN halves h USING (row_ix) GROUP BY ALL),
both_below AS (
  SELECT u.pattern_id, u.region AS region_u, u.row_ix AS target, t.region AS region_t, t.row_ix AS moved, u.cat, u.state, u.value * t.value AS value
  FROM low u JOIN tip_sent t ON t.pattern_id = u.pattern_id AND t.cat = u.cat AND t.state = u.state AND t.row_ix <> u.row_ix
),
both_sent AS (SELECT b.pattern_id, region_u, target, region_t, moved, b.cat, h.i AS state, sum(h.p * b.value) AS value FROM both_below b JOIN halves h ON h.row_ix = target AND h.cat = b.cat AND h.j = b.state GROUP BY ALL),
region_new AS (
  SELECT b.pattern_id, region_u, target, region_t, moved, b.cat, b.state, r.value / u.value / CASE WHEN region_u = region_t THEN t.value ELSE 1 END * b.value AS value
  FROM both_sent b JOIN region_up r ON r.pattern_id = b.pattern_id AND r.region = region_u AND r.cat = b.cat AND r.state = b.state
  JOIN tip_sent u ON u.pattern_id = b.pattern_id AND u.row_ix = target AND u.cat = b.cat AND u.state = b.state
  JOIN tip_sent t ON t.pattern_id = b.pattern_id AND t.row_ix = moved AND t.cat = b.cat AND t.state = b.state
),
region_new_sent AS (SELECT n.pattern_id, region_u, target, region_t, moved, n.cat, p.i AS state, sum(p.p * n.value) AS value FROM region_new n JOIN trans p ON p.node = 'r' || region_u AND p.cat = n.cat AND p.j = n.state GROUP BY ALL),
left_sent AS (
  SELECT t.pattern_id, t.region, t.row_ix, t.cat, p.i AS state, sum(p.p * r.value / t.value) AS value
  FROM tip_sent t JOIN region_up r USING (pattern_id, region, cat, state) JOIN trans p ON p.node = 'r' || t.region AND p.cat = t.cat AND p.j = t.state GROUP BY ALL
),
regraft_lk AS (
  SELECT n.moved, n.target, n.pattern_id, sum(cat_weight * pi * root.value / a.value * n.value * CASE WHEN region_u = region_t THEN 1 ELSE l.value / b.value END) AS lk
  FROM region_new_sent n JOIN root USING (pattern_id, cat, state) JOIN cats USING (cat) JOIN states USING (state)
  JOIN region_sent a ON a.pattern_id = n.pattern_id AND a.region = region_u AND a.cat = n.cat AND a.state = n.state
  JOIN region_sent b ON b.pattern_id = n.pattern_id AND b.region = region_t AND b.cat = n.cat AND b.state = n.state
  JOIN left_sent l ON l.pattern_id = n.pattern_id AND l.row_ix = n.moved AND l.cat = n.cat AND l.state = n.state GROUP BY ALL
),
regrafts AS (SELECT moved, target, round(sum(weight * ln(lk)), 6) AS loglik FROM regraft_lk JOIN pats USING (pattern_id) GROUP BY ALL)
"""


def _pruned(threshold: float = 2.0, drops: int = 2, depth: int = 10) -> str:
    """The search from the root downwards over ``scores``, a level at a time."""
    steps = ["exact AS (SELECT c.query, e.edge, sum(c.weight * e.ln_lk) AS loglik FROM counts c JOIN edge_mask e USING (pattern_id, mask) GROUP BY ALL)"]
    steps.append("v0 AS (SELECT e.*, 0 AS streak FROM exact e JOIN tree_nodes n ON n.node = e.edge WHERE n.parent = 0)")
    for k in range(depth):
        seen = " UNION ALL ".join(f"SELECT query, loglik FROM v{i}" for i in range(k + 1))
        steps.append(f"""v{k + 1} AS (
  SELECT e.query, e.edge, e.loglik, CASE WHEN e.loglik < v.loglik - 1e-5 THEN v.streak + 1 ELSE 0 END AS streak
  FROM v{k} v JOIN (SELECT query, max(loglik) AS best FROM ({seen}) GROUP BY query) b USING (query) JOIN tree_nodes n ON n.parent = v.edge JOIN exact e ON e.query = v.query AND e.edge = n.node
  WHERE NOT (v.streak >= {drops} AND v.loglik < b.best - {threshold}))""")
    every = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(depth + 1))
    return ", ".join(steps) + f" SELECT query, edge::INTEGER AS edge, round(loglik, 6) AS loglik FROM ({every})"


def sql() -> dict[str, str]:
    shares = [(s, x, 1 / len(of)) for s, of in STATES.items() if s not in MISSING and len(of) < 4 for x in of]
    base, lk = f"WITH {CELLS}, {_patterns('mask')}", f"WITH {CELLS}, {_patterns('mask')}, {_model()}, {_vectors()}"
    total = "SELECT round(sum(weight * ln(lk)), 6) AS loglik, sum(weight)::BIGINT AS n_sites FROM lk JOIN pats USING (pattern_id)"
    scored = f"WITH {CELLS}, {QUERY_CELLS}, {_patterns('mask')}, {COUNTS}, {_model()}, {_vectors()}, {TIP_SCORES}"
    every = f"WITH {CELLS}, {QUERY_CELLS}, {_patterns('mask')}, {COUNTS}, {_model()}, {_vectors()}, {TREE}, {EDGE_VECTORS}, {ALL_SCORES}"
    ranking = "rank::INTEGER AS rank, round(exp(loglik - best) / sum(exp(loglik - best)) OVER (PARTITION BY query), 6) AS lwr, round(best - second, 5) AS gap_top2, round(best - fifth, 5) AS gap_top5 FROM kept"
    mismatches = """WITH tree AS (SELECT DISTINCT n_name AS name FROM nation), msa AS (SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT coalesce(tree.name, msa.name) AS name, CASE WHEN tree.name IS NULL THEN 'tree' ELSE 'alignment' END AS missing_in FROM tree FULL JOIN msa ON tree.name = msa.name WHERE tree.name IS NULL OR msa.name IS NULL"""
    msa = lambda name: f"WITH {CELLS} SELECT {name} AS name, string_agg(sym, '' ORDER BY site) AS seq FROM cells GROUP BY taxon"
    counts = f"WITH {CELLS}, {QUERY_CELLS}, {_patterns('mask')}, {COUNTS} SELECT query, pattern_id, mask, weight FROM counts"
    return {
        "tree_loglik": f"{lk} {total}",
        "tree_loglik_blocked": f"{lk} {total}",
        "gene_logliks": f"WITH {CELLS}, {_patterns('mask', 'gene_id')}, {_model()}, {_vectors('gene_id')} SELECT gene_id, round(sum(weight * ln(lk)), 6) AS loglik, sum(weight)::BIGINT AS n_sites FROM lk JOIN pats USING (gene_id, pattern_id) GROUP BY gene_id",
        "alignment_encode": f"WITH {CELLS} SELECT gene_id, site, taxon, sym, mask FROM masks",
        "site_patterns": f"WITH {CELLS}, {_patterns('sym')} SELECT pattern_id, first_site, weight, pattern FROM pats",
        "site_pattern_map": f"WITH {CELLS}, {_patterns('sym')} SELECT site, pattern_id FROM cols JOIN pats USING (pattern)",
        "base_frequencies": f"WITH {CELLS}, share(sym, state, share) AS (VALUES {_values(shares)}), n AS (SELECT state, sum(share) AS n FROM cells JOIN share USING (sym) GROUP BY state) SELECT state, round(n / sum(n) OVER (), 9) AS freq FROM n",
        "invariant_sites": f"WITH {CELLS}, common AS (SELECT region, site, bit_and(mask) AS common FROM masks GROUP BY region, site) SELECT region, site, log2(common)::INTEGER AS state FROM common WHERE bit_count(common) = 1",
        "invariant_sites_all": f"WITH {CELLS}, common AS (SELECT site, bit_and(mask) AS common FROM masks GROUP BY site) SELECT site, log2(common)::INTEGER AS state FROM common WHERE bit_count(common) = 1",
        "transition_matrices": f"WITH {_model()} SELECT n_name AS name, cat, i, j, round(p, 9) AS p FROM trans JOIN nation ON node = 'n' || n_nationkey",
        "pattern_likelihoods": f"{lk} SELECT pattern_id, round(ln(lk), 6) AS ln_lk FROM lk",
        "edge_logliks": f"{lk}, total AS ({total}) SELECT unnest(range(1, 49))::INTEGER AS edge, loglik FROM total",
        "root_states": f"{lk}, joint AS (SELECT pattern_id, state, sum(cat_weight * pi * value) AS x FROM root JOIN cats USING (cat) JOIN states USING (state) GROUP BY ALL) SELECT pattern_id, state, round(x / sum(x) OVER (PARTITION BY pattern_id), 6) AS probability FROM joint",
        "fitch_parsimony": f"{base}, {_fitch()}",
        "sankoff_parsimony": f"{base}, {_sankoff()}",
        "query_counts": counts,
        "stream_query_counts": counts,
        "placement_tip_edges": f"{scored} SELECT query, tip, loglik FROM scores",
        "placement_ranking": f"{every}, {RANKED} SELECT query, edge, {ranking}",
        "placement_edge_ranking": f"{every}, {RANKED} SELECT query, edge, loglik, {ranking}",
        "placement_baseline": f"{every} SELECT query, edge, loglik FROM scores",
        "ancestral_states": f"""{lk}, {TREE}, {EDGE_VECTORS},
            full_trans AS (SELECT node AS edge, cat, i, j, sum(vv * (exp(lam * rate * len) - 1)) + CASE WHEN i = j THEN 1 ELSE 0 END AS p FROM tree_nodes, cats, basis WHERE node > 0 AND NOT is_tip GROUP BY node, cat, i, j),
            outer_vec AS (SELECT v.pattern_id, v.edge, v.cat, t.i AS state, sum(t.p * v.high) AS high FROM edge_vec v JOIN full_trans t ON t.edge = v.edge AND t.cat = v.cat AND t.j = v.state GROUP BY ALL),
            joint AS (
              SELECT pattern_id, edge AS node_id, state, sum(cat_weight * pi * low * o.high) AS x FROM edge_vec JOIN outer_vec o USING (pattern_id, edge, cat, state) JOIN cats USING (cat) JOIN states USING (state) GROUP BY pattern_id, edge, state
              UNION ALL SELECT pattern_id, 0, state, sum(cat_weight * pi * value) FROM root JOIN cats USING (cat) JOIN states USING (state) GROUP BY pattern_id, state)
            SELECT pattern_id, node_id, state, round(x / sum(x) OVER (PARTITION BY pattern_id, node_id), 6) AS probability FROM joint""",
        "site_repeats": f"""{base}, {TREE},
            part AS (SELECT b.node, p.pattern_id, string_agg(m.mask::VARCHAR, ',' ORDER BY m.row_ix) AS seen FROM pats p JOIN masks m ON m.site = p.first_site JOIN below b USING (row_ix) JOIN tree_nodes n USING (node) WHERE NOT n.is_tip GROUP BY ALL)
            SELECT node AS node_id, count(DISTINCT seen) AS n_classes FROM part GROUP BY node""",
        "subtree_sizes": f"""WITH {TREE}, closure AS (
              WITH RECURSIVE up(start, node) AS (SELECT node, node FROM tree_nodes UNION ALL SELECT u.start, n.parent FROM up u JOIN tree_nodes n USING (node) WHERE n.parent IS NOT NULL) SELECT * FROM up)
            SELECT c.node AS node_id, count(*) FILTER (WHERE n.is_tip) AS n_tips, round(sum(CASE WHEN c.start <> c.node THEN n.len ELSE 0 END), 6) AS length FROM closure c JOIN tree_nodes n ON n.node = c.start GROUP BY c.node""",
        "tip_distances": """WITH tips AS (SELECT n_name AS name, n_regionkey AS region, (1 + (n_nationkey * 7) % 13) / 100.0::DOUBLE AS t, (1 + (n_regionkey * 7) % 13) / 100.0::DOUBLE AS r FROM nation)
            SELECT a.name AS tip_a, b.name AS tip_b, round(a.t + b.t + CASE WHEN a.region = b.region THEN 0 ELSE a.r + b.r END, 6) AS length FROM tips a JOIN tips b ON a.name < b.name""",
        "name_mismatches": mismatches,
        "name_mismatches_all": mismatches,
        "mixed_name_mismatches": """SELECT n_name AS name, 'alignment' AS missing_in FROM nation WHERE n_regionkey >= 3 AND n_name NOT IN (SELECT r_name FROM region)
            UNION ALL SELECT r_name, 'tree' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)""",
        "streamed_tree": "SELECT n_name AS name FROM nation UNION ALL SELECT 'query_' || s_suppkey FROM supplier",
        "ring_edges": f"WITH RECURSIVE {TREE}, {RINGS} SELECT prune_root::INTEGER AS prune_root, edge::INTEGER AS edge, ring FROM walk UNION SELECT prune_root::INTEGER, sibling::INTEGER, 0 FROM centres",
        "regraft_logliks": f"{lk}, {REGRAFTS} SELECT a.n_name AS tip, b.n_name AS target, loglik FROM regrafts JOIN nation a ON a.n_nationkey = moved JOIN nation b ON b.n_nationkey = target",
        "pruned_placement": f"{every}, {_pruned()}",
        "bad_symbols": "SELECT p_partkey, i AS site, substr(p_name, i::INTEGER, 1) AS sym FROM part, unnest(range(1, length(p_name) + 1)) AS t(i) WHERE instr('ACGTURYSWKMBDHVN-?.', upper(substr(p_name, i::INTEGER, 1))) = 0",
        "bad_names": "SELECT p_type AS name, count(*) AS n FROM part GROUP BY p_type HAVING count(*) > 1 OR trim(p_type) = '' OR p_type IS NULL",
        "unequal_lengths": "SELECT p_brand AS gene_id, p_type AS name, length(p_name) AS n FROM (SELECT *, max(length(p_name)) OVER (PARTITION BY p_brand) AS sites FROM part) WHERE length(p_name) <> sites OR sites = 0",
        "fasta_round_trip": msa("taxon"),
        "phylip_round_trip": msa("replace(taxon, ' ', '_')"),
    }
