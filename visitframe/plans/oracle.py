"""ANSI SQL building blocks for the DuckDB side of the checks."""

from __future__ import annotations

import re

from visitframe.plans.proxy import AGE_EDGES, MIN_CODE_COUNT, SPLIT_OF, TRIM_RATIO
from visitframe.schema import HOURS_EDGES, SPECIAL_TOKENS

VARS = ["click", "error", "purchase", "signup", "view"]


def edge_list(edges) -> str:
    return "[" + ", ".join(f"{float(e)!r}::DOUBLE" for e in edges) + "]"


def bin_of(value: str, edges: str) -> str:
    return (
        f"least(len(list_filter(({edges})[2:len({edges})-1], lambda x: x < {value})), len({edges})-2)"
    )


def _unpivot(source: str, value: str = "{v}") -> str:
    return " UNION ALL ".join(
        f"SELECT '{v}' AS var, {value.format(v=v)} AS value FROM {source}" for v in VARS
    )


def _moments(source: str, suffix: str = "") -> str:
    return f"""SELECT var, avg(value) AS mean{suffix}, stddev_samp(value) AS std{suffix},
      min(value) AS min{suffix}, max(value) AS max{suffix},
      quantile_cont(value, 0.025) AS q025{suffix}, quantile_cont(value, 0.5) AS median{suffix},
      quantile_cont(value, 0.975) AS q975{suffix} FROM {source} WHERE value IS NOT NULL GROUP BY var"""


_split = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPLIT_OF.items()) + " END"
_specials = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS))
_bins = " ".join(
    f"WHEN var = '{v}' THEN {i + 1}" for i, v in enumerate(VARS)
)


def _grams(n: int) -> str:
    cols = ", ".join(
        f"lead(token_id, {i}) OVER (PARTITION BY seq ORDER BY pos) AS t{i + 1}" for i in range(1, n)
    )
    return f"SELECT seq, split, token_id AS t1{', ' + cols if cols else ''} FROM split_tokens"


CTES: dict[str, str] = {
    "subj": f"""SELECT c_custkey AS sid, {_split} AS split, c_acctbal AS age,
      CASE WHEN c_nationkey < 13 THEN 1 ELSE 0 END AS gender FROM customer""",
    "stays": """SELECT o_custkey AS sid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS stay_idx,
      o_orderkey AS hadm_id, split, age, gender, (o_orderstatus = 'F')::INT AS l0,
      (o_orderpriority = '1-URGENT')::INT AS l1, (o_totalprice > 200000)::INT AS l2,
      (o_orderstatus = 'P')::INT AS label_ihm FROM orders JOIN subj ON sid = o_custkey""",
    "allcodes": """SELECT l_orderkey AS hadm_id, CASE WHEN l_returnflag = 'N' THEN 'proc' ELSE 'icd' END AS sys,
      l_linenumber AS seq_num,
      CASE WHEN l_returnflag = 'N' THEN 'proc_' ELSE 'icd_' END || l_partkey AS code FROM lineitem""",
    "kept": f"SELECT code FROM allcodes GROUP BY code HAVING count(*) > {MIN_CODE_COUNT}",
    "codes": """SELECT hadm_id, sys, seq_num, code, row_number() OVER (PARTITION BY hadm_id
      ORDER BY (sys = 'proc')::INT, seq_num, code) - 1 AS code_pos
      FROM allcodes WHERE code IN (SELECT code FROM kept)""",
    "stay_codes": """SELECT sid, stay_idx, split, code_pos, sys, code FROM stays JOIN codes USING (hadm_id)""",
    "hours_raw": """SELECT user_id AS sid, least(2, (day(ts) - 1) // 10) AS stay_idx,
      date_trunc('hour', ts) AS h, event_id, event_type, value,
      CAST(props ->> '$.k' AS INT) AS k FROM events""",
    "hours_wide": "SELECT sid, stay_idx, h, "
    + ", ".join(f"max(value) FILTER (WHERE event_type = '{v}') AS \"{v}\"" for v in VARS)
    + ", CAST(arg_max(k, event_id) % 4 AS VARCHAR) AS k_band FROM hours_raw GROUP BY ALL",
    "series": """SELECT sid, stay_idx, row_number() OVER w - 1 AS row_idx,
      epoch(h - first_value(h) OVER w) / 3600.0::DOUBLE AS hours, k_band, click, error, purchase, signup, "view"
      FROM hours_wide WINDOW w AS (PARTITION BY sid, stay_idx ORDER BY h)""",
    "cohorts": """SELECT sid AS id, CASE stay_idx WHEN 0 THEN 'real' WHEN 1 THEN 'test' ELSE 'synthetic' END AS cohort,
      row_idx, hours, k_band, click, error, purchase, signup, "view" FROM series""",
    "train_series": "SELECT s.* FROM series s JOIN stays USING (sid, stay_idx) WHERE split = 'train'",
    "svals": _unpivot("train_series", '"{v}"'),
    "prof": f"""SELECT * FROM (SELECT var, avg((value IS NULL)::INT) AS missing_rate, count(DISTINCT value) AS n_unique
      FROM svals GROUP BY var) JOIN ({_moments("svals")}) USING (var)""",
    "trimmed": f"""SELECT var, value FROM svals JOIN prof USING (var) WHERE value IS NOT NULL
      AND NOT (max - q975 > {TRIM_RATIO} * (q975 - median) AND value > q975)
      AND NOT (q025 - min > {TRIM_RATIO} * (median - q025) AND value < q025)""",
    "stats": f"""SELECT *, least(10, n_unique // 5) AS n_bins FROM prof JOIN ({_moments("trimmed", "_2")}) USING (var)""",
    "edges": """SELECT var, list_transform(range(0, n_bins + 1), lambda i: CASE WHEN i = n_bins THEN max_2
      WHEN i = 0 THEN min_2 - 0.001 * (max_2 - min_2) ELSE min_2 + i * ((max_2 - min_2) / n_bins) END) AS e FROM stats""",
    "qedges": """SELECT var, list_sort(list_distinct(list_transform(range(0, n_bins + 1),
      lambda i: l[floor(i / n_bins * (len(l) - 1))::INT + 1] + (l[ceil(i / n_bins * (len(l) - 1))::INT + 1]
        - l[floor(i / n_bins * (len(l) - 1))::INT + 1]) * (i / n_bins * (len(l) - 1) - floor(i / n_bins * (len(l) - 1)))))) AS e
      FROM stats JOIN (SELECT var, list_sort(list(value)) AS l FROM trimmed GROUP BY var) USING (var)""",
    "code_vocab": """SELECT row_number() OVER (ORDER BY (sys = 'proc')::INT, n DESC, code) - 1 AS code_id, sys, code, n
      FROM (SELECT sys, code, count(*) AS n FROM codes GROUP BY sys, code)""",
    "sect": f"""SELECT ord, kind, var_id, n, name, (SELECT count(*) FROM code_vocab) + coalesce(sum(n) OVER (ORDER BY ord
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
      SELECT 0 AS ord, 'ts' AS kind, 0 AS var_id, 3 AS n, 'k_band' AS name
      UNION ALL SELECT CASE {_bins} END, 'ts', CASE {_bins} END, n_bins, var FROM stats
      UNION ALL SELECT 6, 'covar', 6, {len(AGE_EDGES) - 1}, 'Age' UNION ALL SELECT 7, 'covar', 7, 2, 'Gender'
      UNION ALL SELECT 8, 'timestamp', 8, {len(HOURS_EDGES) - 1}, 'Hours'
      UNION ALL SELECT 9, 'phe', -1, 3, 'phe' UNION ALL SELECT 10, 'ihm', -1, 2, 'ihm'
      UNION ALL SELECT 11, 'special', -1, {len(SPECIAL_TOKENS)}, 'special')""",
    "special": f"""SELECT literal, i + (SELECT start FROM sect WHERE kind = 'special') AS token_id, i
      FROM (VALUES {_specials}) AS t(literal, i)""",
    "vocab": """SELECT code_id AS token_id, 'code' AS kind, -1 AS var_id, code_id AS value, code AS literal FROM code_vocab
      UNION ALL SELECT start + i, kind, var_id, i, name || '_' || i FROM (SELECT *, unnest(range(0, n)) AS i FROM sect WHERE kind <> 'special')
      UNION ALL SELECT token_id, 'special', -1, i, literal FROM special""",
    "stay_series": "SELECT s.* FROM series s JOIN stays USING (sid, stay_idx)",
    "gaps": f"""SELECT sid, stay_idx, row_idx, {bin_of("g", edge_list(HOURS_EDGES))} AS gap FROM (
      SELECT *, hours - lag(hours, 1, 0.0) OVER (PARTITION BY sid, stay_idx ORDER BY row_idx) AS g FROM stay_series)""",
    "cells": "SELECT sid, stay_idx, row_idx, 0 AS var_id, CAST(k_band AS INT) AS value FROM stay_series WHERE k_band IS NOT NULL AND k_band <> '3' "
    + " ".join(
        f"""UNION ALL SELECT sid, stay_idx, row_idx, {i + 1}, {bin_of(f'"{v}"', "e")}
      FROM stay_series, (SELECT e FROM edges WHERE var = '{v}') WHERE "{v}" IS NOT NULL"""
        for i, v in enumerate(VARS)
    ),
    "good_rows": """SELECT sid, stay_idx, row_idx, gap FROM gaps JOIN stay_series USING (sid, stay_idx, row_idx)
      WHERE k_band IS NULL OR k_band <> '3'""",
    "disc": f"""SELECT sid, stay_idx, 1 AS section, 0 AS a, 0 AS b, 'covar' AS kind, 6 AS var_id,
      {bin_of("age", edge_list(AGE_EDGES))} AS value FROM stays
      UNION ALL SELECT sid, stay_idx, 1, 0, 1, 'covar', 7, gender FROM stays
      UNION ALL SELECT sid, stay_idx, 3, 0, 0, 'ihm', -1, label_ihm FROM stays
      UNION ALL SELECT sid, stay_idx, 3, 0, 1, 'phe', -1, 0 FROM stays WHERE l0 = 1
      UNION ALL SELECT sid, stay_idx, 3, 0, 2, 'phe', -1, 1 FROM stays WHERE l1 = 1
      UNION ALL SELECT sid, stay_idx, 3, 0, 3, 'phe', -1, 2 FROM stays WHERE l2 = 1
      UNION ALL SELECT sid, stay_idx, 5, code_pos, 0, 'code', -1, code_id FROM stay_codes JOIN code_vocab USING (code)
      UNION ALL SELECT c.sid, c.stay_idx, 7, c.row_idx, row_number() OVER (PARTITION BY c.sid, c.stay_idx, c.row_idx ORDER BY c.var_id) - 1, 'ts', c.var_id, c.value FROM cells c JOIN good_rows USING (sid, stay_idx, row_idx)
      UNION ALL SELECT sid, stay_idx, 7, row_idx, 1000000, 'timestamp', 8, gap FROM good_rows""",
    "marks": """SELECT sid, stay_idx, section, token_id FROM stays, (SELECT unnest([2, 4, 6, 8, 9]) AS section,
      unnest(['</covar>', '</label>', '</code>', '</ts>', '</adm>']) AS literal) JOIN special USING (literal)
      UNION ALL SELECT DISTINCT sid, -1, 0, token_id FROM stays, special WHERE literal = '<s>'
      UNION ALL SELECT DISTINCT sid, 2147483647, 0, token_id FROM stays, special WHERE literal = '</s>'""",
    "token_rows": """SELECT sid AS seq, stay_idx, section, a, b, CASE WHEN kind = 'timestamp' THEN a END AS row_idx,
      CASE WHEN kind = 'code' THEN value ELSE start + value END AS token_id
      FROM disc LEFT JOIN sect USING (kind, var_id)
      UNION ALL SELECT sid, stay_idx, section, 0, 0, NULL, token_id FROM marks""",
    "tokens": """SELECT seq, stay_idx, row_idx, token_id,
      row_number() OVER (PARTITION BY seq ORDER BY stay_idx, section, a, b) - 1 AS pos FROM token_rows""",
    "split_tokens": "SELECT t.seq, t.pos, t.token_id, split FROM tokens t JOIN subj ON seq = sid",
    "horizons": """SELECT sid, stay_idx, horizon, coalesce(min(row_idx) FILTER (WHERE hours = mh), -1) AS row_idx FROM (
      SELECT s.*, horizon, max(hours) FILTER (WHERE hours < horizon) OVER (PARTITION BY sid, stay_idx, horizon) AS mh
      FROM stay_series s, (SELECT unnest([12.0, 24.0, 36.0, 48.0]) AS horizon)) GROUP BY sid, stay_idx, horizon""",
    "token_hor": """SELECT h.sid AS seq, horizon, coalesce(pos + 1, -1) AS position FROM horizons h LEFT JOIN (
      SELECT seq, pos, row_number() OVER (PARTITION BY seq ORDER BY row_idx) - 1 AS want FROM tokens
      WHERE stay_idx = 0 AND row_idx IS NOT NULL) ON seq = sid AND want = row_idx WHERE stay_idx = 0""",
    "visits": "SELECT sid AS seq, stay_idx AS visit_idx, split FROM stays",
    "vcodes": "SELECT sid AS seq, stay_idx AS visit_idx, code_pos AS pos, code, split FROM stay_codes",
    "totals": """SELECT split, count(*) AS nv, count(DISTINCT seq) AS nr FROM visits GROUP BY split""",
    "pairs": """SELECT a.split, a.seq, a.code AS first, b.code AS second FROM vcodes a JOIN vcodes b
      ON a.seq = b.seq AND a.visit_idx = b.visit_idx AND a.pos < b.pos""",
    "triples": """SELECT a.split, a.seq, a.code AS first, b.code AS second, c.code AS third FROM vcodes a JOIN vcodes b
      ON a.seq = b.seq AND a.visit_idx = b.visit_idx AND a.pos < b.pos JOIN vcodes c
      ON a.seq = c.seq AND a.visit_idx = c.visit_idx AND b.pos < c.pos""",
    "seqpairs": """SELECT a.split, a.seq, a.code AS first, b.code AS second FROM vcodes a JOIN vcodes b
      ON a.seq = b.seq AND a.visit_idx + 1 = b.visit_idx""",
    "fam": """SELECT split, 'visit_code' AS family, code AS k1, '' AS k2, '' AS k3, count(*) / any_value(nv) AS p
        FROM vcodes JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'record_code', code, '', '', count(DISTINCT seq) / any_value(nr)
        FROM vcodes JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'visit_pair', first, second, '', count(*) / any_value(nv) FROM pairs JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'record_pair', first, second, '', count(DISTINCT seq) / any_value(nr) FROM pairs JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'visit_triple', first, second, third, count(*) / any_value(nv) FROM triples JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'visit_seq_pair', first, second, '', count(*) / any_value(nv - nr) FROM seqpairs JOIN totals USING (split) GROUP BY ALL
      UNION ALL SELECT split, 'record_seq_pair', first, second, '', count(DISTINCT seq) / any_value(nr) FROM seqpairs JOIN totals USING (split) GROUP BY ALL""",
    "fill": "SELECT id, cohort, row_idx, hours, "
    + ", ".join(
        f"last_value(\"{v}\" IGNORE NULLS) OVER (PARTITION BY id, cohort ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS \"{v}\""
        for v in VARS
    )
    + " FROM cohorts",
}


def corr_sql(source: str, group: str, min_pairs: int) -> str:
    """Lower triangle of the pairwise correlations by ``group``."""
    parts = []
    for i, a in enumerate(VARS):
        for b in VARS[i + 1 :]:
            parts.append(
                f"""SELECT {group}, '{b}' AS var_a, '{a}' AS var_b, count(*) AS n_pairs,
        CASE WHEN count(*) >= {min_pairs} AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN
        covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS corr FROM (SELECT {group}, "{a}" AS x, "{b}" AS y FROM {source}
        WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL) GROUP BY {group}"""
            )
    return " UNION ALL ".join(parts)


CTES["corr"] = corr_sql("cohorts", "cohort", 100)
CTES["corrf"] = corr_sql("fill", "cohort", 100)
CTES["corr_id_raw"] = corr_sql("fill", "cohort, id", 1)
CTES["pair_names"] = " UNION ALL ".join(
    f"SELECT '{b}' AS var_a, '{a}' AS var_b" for i, a in enumerate(VARS) for b in VARS[i + 1 :]
)
CTES["corr_id"] = """SELECT cohort, var_a, var_b, sum(coalesce(corr, 0.0)) / any_value(n) AS corr, sum(n_pairs) AS n_pairs
  FROM corr_id_raw JOIN (SELECT cohort, count(DISTINCT id) AS n FROM fill GROUP BY cohort) USING (cohort) GROUP BY cohort, var_a, var_b"""
_band = """CASE WHEN corr >= 0.5 THEN 'high-pos' WHEN corr >= 0.2 THEN 'medium-pos' WHEN corr >= -0.2 THEN 'low'
  WHEN corr >= -0.5 THEN 'medium-neg' WHEN corr IS NOT NULL THEN 'high-neg' ELSE 'null' END"""
CTES["corr_all"] = """SELECT cohort, var_a, var_b, corr FROM (SELECT DISTINCT cohort FROM cohorts) CROSS JOIN pair_names
  LEFT JOIN corrf USING (cohort, var_a, var_b)"""
CTES["bands"] = f"SELECT cohort, var_a, var_b, corr, {_band} AS band FROM corr_all"
CTES["band_pairs"] = """SELECT a.var_a, a.var_b, a.corr AS ca, b.corr AS cb, a.band AS band_a, b.band AS band_b, b.cohort AS against
  FROM bands a JOIN bands b USING (var_a, var_b) WHERE a.cohort = 'real' AND b.cohort <> 'real'"""
CTES["feat_base"] = "SELECT " + ", ".join(
    f'avg("{v}") AS m_{v}, stddev_samp("{v}") AS s_{v}' for v in VARS
) + " FROM cohorts WHERE cohort = 'real'"
CTES["feat_own"] = "SELECT cohort, " + ", ".join(f'avg("{v}") AS o_{v}' for v in VARS) + " FROM cohorts GROUP BY cohort"
CTES["scaled"] = "SELECT id, c.cohort, " + ", ".join(
    f'(coalesce("{v}", o_{v}) - m_{v}) / s_{v} AS "{v}"' for v in VARS
) + " FROM cohorts c JOIN feat_own USING (cohort), feat_base"
CTES["features"] = "SELECT cohort, id, " + ", ".join(
    f'{f}("{v}") AS {v}_{n}'
    for v in VARS
    for n, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))
) + " FROM scaled GROUP BY cohort, id"
CTES["grams2"] = """SELECT seq, split, pos, token_id AS next, lag(token_id, 1) OVER w AS c1,
  coalesce(lag(token_id, 2) OVER w, -1) AS c2 FROM split_tokens WINDOW w AS (PARTITION BY seq ORDER BY pos)"""
CTES["fit_grams"] = "SELECT c1, c2, next FROM grams2 WHERE pos > 0 AND split = 'train'"
CTES["seq_model"] = """SELECT 0 AS "order", -1 AS c1, -1 AS c2, next, count(*) AS n FROM fit_grams GROUP BY next
  UNION ALL SELECT 1, c1, -1, next, count(*) FROM fit_grams GROUP BY c1, next
  UNION ALL SELECT 2, c1, c2, next, count(*) FROM fit_grams WHERE c2 <> -1 GROUP BY c1, c2, next"""
CTES["model_totals"] = 'SELECT "order", c1, c2, sum(n) AS total FROM seq_model GROUP BY ALL'
CTES["test_grams"] = "SELECT split, c1, c2, next, count(*) AS m FROM grams2 WHERE pos > 0 AND split <> 'train' GROUP BY ALL"
CTES["soft"] = """SELECT token_id, target_id, w / sum(w) OVER (PARTITION BY token_id) AS weight FROM (
  SELECT a.token_id, b.token_id AS target_id, exp(-0.5 * (b.value - a.value) * (b.value - a.value)) AS w
  FROM vocab a JOIN vocab b USING (kind, var_id) WHERE kind = 'ts' AND var_id > 0 AND abs(a.value - b.value) <= 3)
  UNION ALL SELECT token_id, token_id, 1.0 FROM vocab WHERE NOT (kind = 'ts' AND var_id > 0)"""
for _n in (1, 2, 3, 4):
    CTES[f"gram{_n}"] = _grams(_n)
CTES["vec"] = """SELECT vec_id AS id, CASE WHEN label <= 3 THEN 'real' WHEN label <= 6 THEN 'synthetic' ELSE 'test' END AS cohort,
  embedding::DOUBLE[] AS v FROM embeddings"""
CTES["dist"] = """SELECT a.cohort AS ca, a.id AS ia, b.cohort AS cb, b.id AS ib,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d2
  FROM vec a JOIN vec b ON a.id <> b.id"""
CTES["nn"] = "SELECT ca, ia, cb, min(d2) AS d2, sqrt(min(d2)) AS d FROM dist GROUP BY ca, ia, cb"
CTES["vshare"] = """SELECT o.ca, o.cb, avg((o.d2 > s.d2)::INT) AS share, count(*) AS n FROM nn o JOIN nn s
  ON o.ca = s.ca AND o.ia = s.ia AND s.cb = s.ca WHERE o.cb <> o.ca GROUP BY o.ca, o.cb"""
CTES["vn"] = "SELECT cohort, count(*) AS n FROM vec GROUP BY cohort"
CTES["kth"] = """SELECT ca AS cohort, ia AS id, sqrt(d2) AS r FROM (SELECT *, row_number() OVER (PARTITION BY ia ORDER BY d2, ib) AS rn
  FROM dist WHERE ca = cb) WHERE rn = 5"""
CTES["mia_d"] = "SELECT ca, d FROM nn WHERE cb = 'synthetic' AND ca IN ('real', 'test')"
CTES["kde"] = """SELECT g.ca, i, sum(exp(-0.5 * power((top * i / 99 - d) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS y
  FROM (SELECT ca, count(*) AS n, power(count(*), -0.2) * stddev_samp(d) AS h FROM mia_d GROUP BY ca) g JOIN mia_d USING (ca),
  (SELECT max(d) AS top FROM mia_d), (SELECT unnest(range(0, 100)) AS i) GROUP BY g.ca, i"""
CTES["rec"] = """SELECT sid AS rid, any_value(split) AS split, count(*) AS nv, max(l0) AS l0, max(l1) AS l1, max(l2) AS l2
  FROM stays GROUP BY sid"""
CTES["rset"] = "SELECT *, CASE split WHEN 'train' THEN 't' WHEN 'synthetic' THEN 's' ELSE 'e' END AS part FROM rec"
CTES["vsize"] = """SELECT s.sid AS rid, s.stay_idx, count(c.code) AS n FROM stays s LEFT JOIN codes c USING (hadm_id) GROUP BY ALL"""
CTES["prefix"] = """SELECT rid, stay_idx + 1 AS k, sum(n) OVER (PARTITION BY rid ORDER BY stay_idx) AS pre FROM vsize"""
CTES["rfeat"] = "SELECT DISTINCT sid AS rid, stay_idx, code FROM stay_codes"
CTES["rcommon"] = """SELECT a.rid AS ra, b.rid AS rb, count(*) AS common FROM rfeat a JOIN rfeat b USING (stay_idx, code) GROUP BY ALL"""
CTES["rdist"] = """SELECT a.rid AS ra, b.rid AS rb, a.part AS pa, b.part AS pb, CASE WHEN a.rid = b.rid THEN 100 ELSE
  (a.nv <> b.nv)::INT + abs(a.l0 - b.l0) + abs(a.l1 - b.l1) + abs(a.l2 - b.l2) + pa.pre + pb.pre - 2 * coalesce(common, 0) END AS d
  FROM rset a JOIN rset b ON TRUE JOIN prefix pa ON pa.rid = a.rid AND pa.k = a.nv
  JOIN prefix pb ON pb.rid = b.rid AND pb.k = least(a.nv, b.nv) LEFT JOIN rcommon ON ra = a.rid AND rb = b.rid"""
CTES["rnn"] = "SELECT pa, ra, pb, min(d) AS d FROM rdist GROUP BY ALL"
CTES["rset_picked"] = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY
  ('0x' || substr(md5(concat_ws('|', '0', rid)), 1, 13))::BIGINT / 4503599627370496.0, rid) AS rn FROM rset) WHERE rn <= 1000"""
CTES["rnn_picked"] = """SELECT pa, ra, pb, min(d) AS d FROM rdist WHERE ra IN (SELECT rid FROM rset_picked)
  AND rb IN (SELECT rid FROM rset_picked) GROUP BY ALL"""
CTES["turns"] = """SELECT conv_id * 1000 + a.turn AS pair_id, b.text AS pred, a.text AS ref FROM conversations a
  JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1"""
CTES["doc_score"] = """SELECT doc_id, n_chars AS score, quality, toxic, (n_chars > 1000)::INT AS pred FROM documents JOIN labels USING (doc_id)"""
CTES["doc_long"] = """SELECT doc_id, 'quality' AS label, score, pred, quality AS truth FROM doc_score
  UNION ALL SELECT doc_id, 'toxic', score, pred, toxic FROM doc_score"""


def uniform(seed: int, *keys: str) -> str:
    """The SQL of ``columns.hash_uniform``."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::BIGINT / 4503599627370496.0)"


def build(final: str) -> str:
    """Final SELECT with the blocks it needs in front."""
    names = list(CTES)
    used: list[str] = []
    text = final
    for name in reversed(names):
        if re.search(rf"\b{name}\b", text):
            used.append(name)
            text += "\n" + CTES[name]
    if not used:
        return final
    ordered = [n for n in names if n in used]
    blocks = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    return f"WITH {blocks}\n{final}"
