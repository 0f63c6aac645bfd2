"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, license_scan, merkle, mixing, piece_codec, quality, simhash, token_alignment, token_store, toxicity, url_filter, warc

#: The production mixture. The largest source is held to a share, the others keep their proportions.
WEIGHTS = {"src0": 0.15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), WEIGHTS)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_index(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignments(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of the licence scan, which SQL can say."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base part of the quality rules, which SQL can say."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {f.__name__: f for f in (license_places, quality_statistics)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_source_mixing": OP2, "op5_warc": OP5, "op9_decontamination": OP9, "op12_merkle_manifest": manifest_sql(), "license_places": PLACES, "quality_statistics": STATISTICS}


UPPER, LOWER = url_filter.UPPER, url_filter.LOWER

OP1 = f"""
WITH split AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split
), rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in url_filter.RULES)}),
fits AS (
  SELECT r.rule, r.verdict, substr(rule, 1, instr(rule, '/') - 1) AS rule_host, substr(rule, instr(rule, '/')) AS rule_path FROM rules r
), judged AS (
  SELECT p.page_id, p.host, p.path, max(struct_pack(n := length(f.rule), rule := f.rule, verdict := f.verdict)) AS best
  FROM parts p LEFT JOIN fits f ON (p.host = f.rule_host OR ends_with(p.host, '.' || f.rule_host)) AND starts_with(p.path, f.rule_path)
  GROUP BY p.page_id, p.host, p.path
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""

OP2 = f"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size,
    CASE {" ".join(f"WHEN source = '{s}' THEN {w}" for s, w in WEIGHTS.items())} END AS weight
  FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS total, sum(CASE WHEN weight IS NULL THEN size END) AS others, sum(weight) AS given FROM sizes
), rates AS (
  SELECT source, coalesce(weight, (1 - coalesce(given, 0)) * size / others) * total / size AS rate FROM sizes, totals
), drawn AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('{mixing.SEED}|' || d.doc_id || '|1'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)} AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 200) AS t(k)
), below AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms
), counts AS (
  SELECT d.doc_id, count(b.k) AS n FROM drawn d LEFT JOIN below b ON b.source = d.source AND b.cdf <= d.u AND b.k < 60 GROUP BY d.doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, unnest(range(1, c.n + 1))::INTEGER AS replica
FROM documents d JOIN counts c USING (doc_id) WHERE c.n > 0
"""

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM d, (SELECT DISTINCT size FROM item_windows) s, unnest(range(1, len(w) - size + 2)) AS t(i)
), found AS (
  SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN item_windows v ON p.win = v.win AND p.size = v.size
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM found, unnest(range(i, i + size)) AS t(pos) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP5 = """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), copies AS (
  SELECT payload_digest, max(page_id) AS first FROM own WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT o.page_id, o.payload_bytes::BIGINT AS payload_bytes, o.payload_digest,
  CASE WHEN c.first <> o.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN c.first <> o.page_id THEN c.first END AS refers_to
FROM own o LEFT JOIN copies c ON o.payload_digest = c.payload_digest AND o.payload_bytes >= 1000
"""

PLACES = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents
), phrases(phrase, label, size) AS (VALUES {", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_scan.PHRASES)}),
places AS (
  SELECT doc_id, i - 1 AS word_at, label FROM d, phrases, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE array_to_string(w[i:i + size - 1], ' ') = phrase
), base AS (
  SELECT doc_id, count(*) AS n, min(word_at) AS first_word, max(word_at) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN base USING (doc_id)
"""

SPACED = r"[^\x20\x09-\x0D]+"
STATISTICS = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents
), wins AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ')) AS n FROM d, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS t(i)
), repeats AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM wins, unnest(range(i, i + {quality.WINDOW})) AS t(pos) WHERE wins.n > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACED}') GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  len(w) < {quality.LEAST_WORDS} OR 100 * coalesce(r.n, 0) > {quality.MOST_REPEATED} * len(w) AS base_failed
FROM d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
"""


#: Levels of a tree that the SQL below unrolls: enough for 8 ** 8 rows.
SQL_LEVELS = 8


def manifest_sql() -> str:
    """Trees, proofs and their folding, a level at a time; the CRC-32 goes over the bits of the decimal id."""
    coded = lambda text: "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')" for c in (*(f"{f}::VARCHAR" for f in merkle.FIELDS[:-1]), text)) + "))"
    bits = "list_transform(range(8 * length(id)), lambda j: ((ascii(substr(id, j // 8 + 1, 1)) >> (j % 8)) & 1)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    out = [
        f"""leaves AS (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size,
    {coded("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {coded(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {coded("text")} END AS shown
  FROM (SELECT *, doc_id::VARCHAR AS id FROM documents)
), a0 AS (SELECT lang, place, size, leaf AS digest FROM leaves)"""
    ]
    up = "SELECT {key}place // 8 AS place, (size + 7) // 8 AS size, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {of} WHERE size > 1 GROUP BY ALL"
    out += [f"a{k + 1} AS ({up.format(key='lang, ', of=f'(SELECT lang, place, size, digest FROM a{k})').replace('GROUP BY ALL', 'GROUP BY lang, place // 8, size')})" for k in range(SQL_LEVELS)]
    roots = " UNION ALL ".join(f"SELECT lang, digest FROM a{k} WHERE size = 1" for k in range(SQL_LEVELS + 1))
    out.append(f"subroots AS (SELECT lang, digest, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM ({roots}))")
    out.append("b0 AS (SELECT place, size, digest FROM subroots)")
    out += [f"b{k + 1} AS ({up.format(key='', of=f'b{k}').replace('GROUP BY ALL', 'GROUP BY place // 8, size')})" for k in range(SQL_LEVELS)]
    out.append("root AS (" + " UNION ALL ".join(f"SELECT digest FROM b{k} WHERE size = 1" for k in range(SQL_LEVELS + 1)) + ")")
    out.append("f0 AS (SELECT doc_id, lang, place, leaf, shown AS folded, '' AS proof FROM leaves)")
    for k in range(SQL_LEVELS):
        out.append(f"""f{k + 1} AS (
  SELECT f.doc_id, f.lang, f.place // 8 AS place, f.leaf, coalesce(sha256(string_agg(CASE WHEN n.place = f.place THEN f.folded ELSE n.digest END, '' ORDER BY n.place) FILTER (n.size > 1)), f.folded) AS folded,
    f.proof || coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.size > 1 AND n.place <> f.place), '') AS proof
  FROM f{k} f LEFT JOIN a{k} n ON n.lang IS NOT DISTINCT FROM f.lang AND n.place // 8 = f.place // 8 GROUP BY f.doc_id, f.lang, f.place, f.leaf, f.folded, f.proof)""")
    out.append(f"g0 AS (SELECT f.doc_id, f.lang, s.place, f.leaf, s.digest AS subroot, f.folded, f.proof FROM f{SQL_LEVELS} f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang)")
    for k in range(SQL_LEVELS):
        out.append(f"""g{k + 1} AS (
  SELECT g.doc_id, g.lang, g.place // 8 AS place, g.leaf, g.subroot, coalesce(sha256(string_agg(CASE WHEN n.place = g.place THEN g.folded ELSE n.digest END, '' ORDER BY n.place) FILTER (n.size > 1)), g.folded) AS folded,
    g.proof || coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.size > 1 AND n.place <> g.place), '') AS proof
  FROM g{k} g LEFT JOIN b{k} n ON n.place // 8 = g.place // 8 GROUP BY g.doc_id, g.lang, g.place, g.leaf, g.subroot, g.folded, g.proof)""")
    last = f"SELECT g.doc_id, g.leaf, g.subroot, r.digest AS root, sha256(g.proof) AS proof_sha256, g.folded AS folded_root, g.folded = r.digest AS verified FROM g{SQL_LEVELS} g, root r"
    return "WITH " + ",\n".join(out) + "\n" + last
