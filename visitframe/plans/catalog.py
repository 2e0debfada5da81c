"""Every registered query: the Spark plan, its columns, and the SQL to check it.

``columns`` is ``"name:type"`` with types i (long), f (double, 6 places) and
s (string); both sides are cast to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.functions.columns import (
    attention_mask,
    encode_flag,
    label_columns,
    pad_array,
    parse_stay,
)
from visitframe.functions.ordered import position_in, union_all
from visitframe.operators import (
    clean,
    codestats,
    discretize,
    ngrams,
    privacy,
    records,
    restructure,
    sampling,
    scores,
    seqmodel,
    series,
    textsim,
    tokens,
    utility,
    vocab,
)
from visitframe.plans import oracle, proxy, report
from visitframe.plans.proxy import CONTINUOUS, Records, cohort_series, table
from visitframe.schema import HORIZON_HOURS
from visitframe.session import durable, stage_folder
from visitframe.sources import io

N_CTX = 64
#: Longest context of a generated or prompted sequence.
CONTEXT_TOKENS = 1024


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def plan(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        casts = {
            "i": lambda c: F.col(c).cast("long"),
            "s": lambda c: F.col(c).cast("string"),
            "f": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
        }
        return df.select(*[casts[t](n).alias(n) for n, t in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = {
            "i": 'CAST("{0}" AS BIGINT) AS "{0}"',
            "s": 'CAST("{0}" AS VARCHAR) AS "{0}"',
            "f": 'round(CAST("{0}" AS DOUBLE), 6) + 0.0 AS "{0}"',
        }
        cells = ", ".join(casts[t].format(n) for n, t in self.fields())
        return oracle.build(f"SELECT {cells} FROM ({self.sql}) AS answer")


CATALOG: dict[str, Query] = {}


def query(columns: str, sql: str | None = None):
    """Register a query under its function's name."""

    def add(run):
        CATALOG[run.__name__] = Query(run, columns, sql)
        return run

    return add


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the written stages."""
    folder = stage_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return f"{folder}/scratch-{uuid.uuid4().hex}"


def visit_tables(r: Records, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(codes, visits) in the layout of the code statistics."""
    codes = r.visit_codes.select(
        F.col("sid").alias("seq"), F.col("stay_idx").alias("visit_idx"),
        F.col("code_pos").alias("pos"), "code", "split",
    )
    visits = r.stays.select(F.col("sid").alias("seq"), F.col("stay_idx").alias("visit_idx"), "split")
    if split:
        codes, visits = codes.where(F.col("split") == split), visits.where(F.col("split") == split)
    return codes, visits


def split_tokens(r: Records) -> DataFrame:
    return r.split_tokens


# --- flagship and code statistics ------------------------------------------------

FLAGSHIP = ("visit_code", "record_code", "visit_pair", "visit_seq_pair")
_R2 = """SELECT family, count(*) AS n_keys, 1 - sum((x - y) * (x - y)) / nullif(var_pop(x) * count(x), 0) AS r2,
  1 - sum((x - y) * (x - y)) FILTER (WHERE x < 0.005) / nullif((var_pop(x) FILTER (WHERE x < 0.005)) * (count(x) FILTER (WHERE x < 0.005)), 0) AS r2_rare
  FROM (SELECT family, coalesce(a.p, 0) AS x, coalesce(b.p, 0) AS y
  FROM (SELECT * FROM fam WHERE split = 'train') a FULL JOIN (SELECT * FROM fam WHERE split = 'synthetic') b
  USING (family, k1, k2, k3)) {where} GROUP BY family"""


def _code_r2(spark, d, families):
    r = Records(spark, d)
    sides = [
        codestats.code_statistics(*visit_tables(r, split), families) for split in ("train", "synthetic")
    ]
    return codestats.compare_code_stats(*sides, families=families)


@query(
    "family:s n_keys:i r2:f",
    _R2.format(where="WHERE family IN ('visit_code', 'record_code', 'visit_pair', 'visit_seq_pair')"),
)
def code_prob_r2(spark, d):
    """How close are the code distributions of two cohorts?"""
    return _code_r2(spark, d, FLAGSHIP)


@query("family:s n_keys:i r2:f r2_rare:f", _R2.format(where=""))
def code_statistics_r2(spark, d):
    return _code_r2(spark, d, codestats.FAMILIES)


def _by_split(r: Records, make) -> DataFrame:
    parts = []
    for split in ("train", "val", "test", "synthetic"):
        codes, visits = visit_tables(r, split)
        parts.append(make(codes, visits).withColumn("split", F.lit(split)))
    return union_all(parts)


@query("split:s code:s p:f", "SELECT split, k1 AS code, p FROM fam WHERE family = 'visit_code'")
def code_probs_visit(spark, d):
    return _by_split(Records(spark, d), lambda c, v: codestats.code_probs(c, v, "visit"))


@query("split:s code:s p:f", "SELECT split, k1 AS code, p FROM fam WHERE family = 'record_code'")
def code_probs_record(spark, d):
    return _by_split(Records(spark, d), lambda c, v: codestats.code_probs(c, v, "record"))


@query(
    "first:s second:s n:i records:i",
    "SELECT first, second, count(*) AS n, count(DISTINCT seq) AS records FROM pairs GROUP BY ALL",
)
def code_pairs(spark, d):
    codes, _ = visit_tables(Records(spark, d))
    return codestats.counted(codestats.code_pairs(codes), codestats.PAIR)


@query(
    "first:s second:s n:i",
    "SELECT least(first, second) AS first, greatest(first, second) AS second, count(*) AS n FROM pairs GROUP BY ALL",
)
def pairs_sorted(spark, d):
    codes, _ = visit_tables(Records(spark, d))
    return codestats.code_pairs(codes, sort=True).groupBy(*codestats.PAIR).agg(F.sum("n").alias("n"))


@query(
    "first:s second:s third:s n:i",
    "SELECT first, second, third, count(*) AS n FROM triples GROUP BY ALL",
)
def code_triples(spark, d):
    codes, _ = visit_tables(Records(spark, d))
    return codestats.code_triples(codes).groupBy(*codestats.TRIPLE).agg(F.sum("n").alias("n"))


@query(
    "first:s second:s n:i records:i",
    "SELECT first, second, count(*) AS n, count(DISTINCT seq) AS records FROM seqpairs GROUP BY ALL",
)
def sequential_pairs(spark, d):
    codes, _ = visit_tables(Records(spark, d))
    return codestats.counted(codestats.sequential_pairs(codes), codestats.PAIR)


@query(
    "record_len_mean:f record_len_std:f visit_len_mean:f visit_len_std:f",
    """SELECT (SELECT avg(n) FROM (SELECT count(*) AS n FROM visits GROUP BY seq)) AS record_len_mean,
    (SELECT stddev_pop(n) FROM (SELECT count(*) AS n FROM visits GROUP BY seq)) AS record_len_std,
    avg(n) AS visit_len_mean, stddev_pop(n) AS visit_len_std FROM vsize""",
)
def length_stats(spark, d):
    return codestats.length_stats(*visit_tables(Records(spark, d)))


@query(
    "label:s n:i p:f",
    """SELECT 'L_0' AS label, sum(l0) AS n, avg(l0) AS p FROM rec UNION ALL SELECT 'L_1', sum(l1), avg(l1) FROM rec
    UNION ALL SELECT 'L_2', sum(l2), avg(l2) FROM rec UNION ALL SELECT 'Overall', count(*), 1.0 FROM rec""",
)
def label_probs(spark, d):
    return codestats.label_probs(codestats.record_labels(Records(spark, d).stays))


@query(
    "gap_mean:f gap_std:f",
    "SELECT avg(gap) AS gap_mean, stddev_pop(gap) AS gap_std FROM gaps",
)
def gap_statistics(spark, d):
    return codestats.gap_stats(discretize.gap_bin(Records(spark, d).stay_series, proxy.FIXED_HOURS))


_one_split = "split = 'train'"
_report_rows = f"""SELECT family, k1, k2, k3, p FROM fam WHERE {_one_split} AND family NOT IN ('visit_pair', 'record_pair', 'visit_triple')
    UNION ALL SELECT 'visit_pair', least(first, second), greatest(first, second), '', count(*) / any_value(nv) FROM pairs JOIN totals USING (split) WHERE {_one_split} GROUP BY ALL
    UNION ALL SELECT 'record_pair', least(first, second), greatest(first, second), '', count(DISTINCT seq) / any_value(nr) FROM pairs JOIN totals USING (split) WHERE {_one_split} GROUP BY ALL
    UNION ALL (UNPIVOT (SELECT '' AS k1, '' AS k2, '' AS k3, (SELECT avg(n) FROM own_records) AS record_len_mean, (SELECT stddev_pop(n) FROM own_records) AS record_len_std,
      (SELECT avg(n) FROM own_visits) AS visit_len_mean, (SELECT stddev_pop(n) FROM own_visits) AS visit_len_std,
      (SELECT avg(gap) FROM own_gaps) AS gap_mean, (SELECT stddev_pop(gap) FROM own_gaps) AS gap_std)
      ON record_len_mean, record_len_std, visit_len_mean, visit_len_std, gap_mean, gap_std INTO NAME family VALUE p)"""


@query(
    "family:s k1:s k2:s k3:s p:f",
    f"""WITH own_records AS (SELECT seq, count(*) AS n FROM visits WHERE {_one_split} GROUP BY seq),
    own_visits AS (SELECT n FROM vsize JOIN subj ON sid = rid WHERE {_one_split}),
    own_gaps AS (SELECT gap FROM gaps JOIN stays USING (sid, stay_idx) WHERE {_one_split})
    SELECT family, k1, k2, k3, p FROM ({_report_rows.replace("(UNPIVOT", "SELECT family, k1, k2, k3, p FROM (UNPIVOT")})""",
)
def code_report_sorted(spark, d):
    """Name-ordered pairs, lengths and gaps of the training split in one report."""
    r = Records(spark, d)
    codes, visits = visit_tables(r, "train")
    stays = r.stays.where(F.col("split") == "train").select("sid", "stay_idx")
    gaps = discretize.gap_bin(r.stay_series, proxy.FIXED_HOURS).join(stays, ["sid", "stay_idx"], "left_semi")
    return codestats.code_report(codes, visits, gaps, [f for f in codestats.FAMILIES if f != "visit_triple"])


@query(
    "family:s k1:s k2:s n:i p:f",
    """SELECT 'visit_code' AS family, code AS k1, '' AS k2, count(*) AS n, count(*) / (SELECT count(*) FROM visits) AS p FROM vcodes GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'record_pair', first, second, count(DISTINCT seq), count(DISTINCT seq) / (SELECT count(DISTINCT seq) FROM visits) FROM pairs GROUP BY first, second HAVING count(DISTINCT seq) > 1
    UNION ALL SELECT 'visit_seq_pair', first, second, count(*), count(*) / (SELECT count(*) - count(DISTINCT seq) FROM visits) FROM seqpairs GROUP BY first, second HAVING count(*) > 1""",
)
def code_statistics_min_count(spark, d):
    """Keys seen once are left out."""
    codes, visits = visit_tables(Records(spark, d))
    return codestats.code_statistics(codes, visits, ["visit_code", "record_pair", "visit_seq_pair"], min_count=1)


# --- sources, filters, parsing -----------------------------------------------------

@query(
    "sid:i episode:i label_0:i label_1:i label_2:i split:s n_places:i",
    """SELECT o_custkey AS sid, o_orderkey % 7 AS episode, (o_orderstatus = 'F')::INT AS label_0, (o_orderpriority = '1-URGENT')::INT AS label_1,
    (o_totalprice > 200000)::INT AS label_2, 'train' AS split, (SELECT count(*) FROM orders) AS n_places FROM orders""",
)
def read_split_list(spark, d):
    """Listed stays written as CSV and read back with a dense place in the list."""
    path = scratch(spark)
    labels = proxy.listed_stays(spark, d).select(
        F.concat(F.col("sid"), F.lit("_episode"), F.col("hadm_id") % 7 + 1, F.lit("_timeseries.csv")).alias("stay"),
        F.lit(48).alias("period_length"), *label_columns("label_phe", 3, "y"),
    )
    labels.write.option("header", True).csv(path)
    listed = durable(io.read_split_list(spark, path, "train"))
    places = listed.where((F.col("list_pos") >= 0) & (F.col("list_pos") < listed.agg(F.count("*")).scalar())).agg(F.count_distinct("list_pos")).scalar()
    return listed.select("sid", "episode", *label_columns("label_phe", 3, "label_"), "split", places.alias("n_places"))


@query(
    "hours:f click:f view:f dense:i",
    'SELECT hours, click, "view", 1 AS dense FROM series',
)
def read_series(spark, d):
    """Series files read back: every row, numbered densely within its file."""
    path = scratch(spark)
    Records(spark, d).series.withColumnRenamed("hours", "Hours").write.option("header", True).csv(path)
    rows = durable(io.read_series(spark, path, ["click", "view"]))
    files = rows.groupBy("stay").agg(
        ((F.count("*") == F.count_distinct("row_idx")) & (F.max("row_idx") + 1 == F.count("*"))).cast("int").alias("dense")
    )
    return rows.join(files, "stay")


@query("token_id:i kind:s var_id:i value:i literal:s", "SELECT * FROM vocab")
def metadata_reload(spark, d):
    """The vocabulary of saved and loaded metadata."""
    path = scratch(spark)
    vocab.save_metadata(Records(spark, d).meta, path)
    return vocab.load_metadata(spark, path).vocab()


@query(
    "name:s token_id:i literal:s",
    """SELECT name, token_id, literal FROM (SELECT unnest(['start', 'end', 'pad', 'mask', 'history', 'forecast', 'forecast_end']) AS name,
    unnest(['<s>', '</s>', '<pad>', '<pad>', '<history>', '<forecast>', '</forecast>']) AS literal) JOIN special USING (literal)""",
)
def special_tokens(spark, d):
    """Special token ids, looked up in the learned vocabulary."""
    meta = Records(spark, d).meta
    ids = F.create_map(*[F.lit(x) for pair in meta.special_ids().items() for x in pair])
    named = spark.range(1).select(F.explode(ids).alias("name", "token_id"))
    return named.join(meta.vocab().select("token_id", "literal"), "token_id")


@query("sid:i stay_idx:i row_idx:i view:f click:f", 'SELECT sid, stay_idx, row_idx, "view", click FROM series')
def selected_variables(spark, d):
    return clean.select_vars(Records(spark, d).series, ["sid", "stay_idx", "row_idx"], ["view", "click"])


@query(
    "sys:s n:i n_codes:i last_seq:i",
    "SELECT sys, count(*) AS n, count(DISTINCT code) AS n_codes, max(seq_num) AS last_seq FROM allcodes GROUP BY sys",
)
def read_codes(spark, d):
    """Code tables written as CSV and read back by column name."""
    parts = []
    for kind, flag in (("icd", F.col("l_returnflag") != "N"), ("proc", F.col("l_returnflag") == "N")):
        path = scratch(spark)
        table(spark, d, "lineitem").where(flag).select(
            F.col("l_suppkey").alias("SUBJECT_ID"), F.col("l_orderkey").alias("HADM_ID"),
            F.col("l_linenumber").alias("SEQ_NUM"), F.col("l_partkey").alias("ICD9_CODE"),
        ).write.option("header", True).csv(path)
        parts.append(io.read_codes(spark, path, kind))
    return union_all(parts).groupBy("sys").agg(
        F.count("*").alias("n"), F.count_distinct("code").alias("n_codes"), F.max("seq_num").alias("last_seq")
    )


@query("task:s split:s n:i", "SELECT 'stays' AS task, split, count(*) AS n FROM stays GROUP BY split")
def split_sizes(spark, d):
    return io.split_sizes(proxy.stays(spark, d).withColumn("task", F.lit("stays")))


@query(
    "sid:i stay_idx:i age:f gender:i",
    "SELECT sid, stay_idx, age, gender FROM stays WHERE split = 'test'",
)
def load_split(spark, d):
    path = scratch(spark)
    io.save_split(proxy.stays(spark, d), path)
    return io.load_split(spark, path, "test")


BOUNDS = {v: (float(i + 1), 100.0 + i) for i, v in enumerate(CONTINUOUS)}
_clipped = ", ".join(
    f'CASE WHEN "{v}" IS NOT NULL THEN least({hi}, greatest({lo}, "{v}")) END AS "{v}"' for v, (lo, hi) in BOUNDS.items()
)


@query(
    "sid:i row_idx:i hours:f age:f gender:i label_ihm:i label_phe_0:i label_phe_1:i label_phe_2:i k_band:s "
    + " ".join(f"{v}:f" for v in CONTINUOUS),
    f"""SELECT s.sid, row_idx, hours, age, gender, label_ihm, l0 AS label_phe_0, l1 AS label_phe_1, l2 AS label_phe_2,
    k_band, {_clipped} FROM series s JOIN stays USING (sid, stay_idx) WHERE stay_idx = 0""",
)
def export_series(spark, d):
    """First stay series, every variable clipped, with covariates and labels, through CSV."""
    r = Records(spark, d)
    flat = io.flat_first_stay(r.series, r.stays, proxy.CATEGORICAL, CONTINUOUS, BOUNDS, 3)
    path = scratch(spark)
    io.export_series_csv(flat, path)
    return io.read_table(spark, path, {
        "sid": "long", "row_idx": "long", "hours": "double", "age": "double", "gender": "int", "label_ihm": "int",
        "label_phe_0": "int", "label_phe_1": "int", "label_phe_2": "int", "k_band": "string",
        **{v: "double" for v in CONTINUOUS},
    })


@query(
    "sid:i stay_order:i",
    """SELECT CAST(regexp_extract(s, '^(\\d+)_episode(\\d+)', 1) AS BIGINT) AS sid,
    CAST(regexp_extract(s, '^(\\d+)_episode(\\d+)', 2) AS BIGINT) - 1 AS stay_order FROM (
    SELECT o_custkey || '_episode' || o_orderkey || '_timeseries.csv' AS s FROM orders)""",
)
def parse_stays(spark, d):
    text = F.concat(F.col("o_custkey"), F.lit("_episode"), F.col("o_orderkey"), F.lit("_timeseries.csv"))
    sid, order = parse_stay(text)
    return table(spark, d, "orders").select(sid.alias("sid"), order.alias("stay_order"))


@query("sid:i gender:i split:s", "SELECT sid, gender, split FROM subj")
def encode_gender(spark, d):
    return proxy.subjects(spark, d).withColumn("gender", encode_flag("gender_text"))


@query("hadm_id:i code_pos:i code:s", "SELECT hadm_id, code_pos, code FROM codes")
def frequent_codes(spark, d):
    return proxy.codes(spark, d)


@query(
    "event_id:i value:f k:f event_type:s",
    """SELECT event_id, TRY_CAST(CASE WHEN value > 300 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
    TRY_CAST(event_type AS DOUBLE) AS k, nullif(event_type, 'view') AS event_type FROM events""",
)
def coerce_types(spark, d):
    text = F.when(F.col("value") > 300, "n/a").otherwise(F.col("value").cast("string"))
    raw = table(spark, d, "events").select(
        "event_id", text.alias("value"), F.col("event_type").alias("k"),
        F.when(F.col("event_type") == "view", "nan").otherwise(F.col("event_type")).alias("event_type"),
    )
    return clean.coerce_types(raw, ["event_type"], ["value", "k"])


@query(
    "sid:i stay_idx:i row_idx:i " + " ".join(f"{v}:f" for v in CONTINUOUS),
    "SELECT sid, stay_idx, row_idx, "
    + ", ".join(f"""CASE WHEN "{v}" IS NOT NULL THEN least({v}_b.max_2, greatest({v}_b.min_2, "{v}")) END AS "{v}\"""" for v in CONTINUOUS)
    + " FROM series, "
    + ", ".join(f"(SELECT min_2, max_2 FROM stats WHERE var = '{v}') {v}_b" for v in CONTINUOUS),
)
def clip_series(spark, d):
    r = Records(spark, d)
    stats = vocab.series_stats(vocab.series_ranks(r.train_series, CONTINUOUS), proxy.TRIM_RATIO)
    bounds = {x["var"]: (x["min_2"], x["max_2"]) for x in stats.select("var", "min_2", "max_2").collect()}
    return clean.clip_series(r.series, bounds)


@query(
    "var:s n_null:i n_inf:i",
    "SELECT var, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE value > 300) AS n_inf FROM ("
    + oracle._unpivot("series", '"{v}"') + ") GROUP BY var",
)
def audit_nulls(spark, d):
    """Values above 300 stand for overflows: they are made infinite first."""
    made = {v: F.when(F.col(v) > 300, F.lit(float("inf"))).otherwise(F.col(v)) for v in CONTINUOUS}
    return clean.audit_nulls(proxy.series(spark, d).withColumns(made), CONTINUOUS)


@query(
    "sid:i stay_idx:i row_idx:i click:f view:f",
    """SELECT sid, stay_idx, row_idx, coalesce(click, (SELECT avg(click) FROM series)) AS click,
    coalesce("view", (SELECT avg("view") FROM series)) AS "view" FROM series""",
)
def fill_mean(spark, d):
    return clean.fill_mean(Records(spark, d).series, CONTINUOUS)


@query(
    "id:s row_idx:i " + " ".join(f"{v}:f" for v in CONTINUOUS),
    "SELECT id, row_idx, "
    + ", ".join(
        f"""coalesce("{v}", 0) + 1e-5 * sqrt(-2 * ln(1 - {oracle.uniform(0, str(2 * i), "id")})) * cos(2 * pi() * {oracle.uniform(0, str(2 * i + 1), "id")}) AS "{v}\""""
        for i, v in enumerate(CONTINUOUS)
    )
    + " FROM (SELECT *, concat_ws('-', sid, stay_idx, row_idx) AS id FROM series)",
)
def jitter(spark, d):
    filled = clean.fill_zero(Records(spark, d).series, CONTINUOUS).withColumn(
        "id", F.concat_ws("-", *[F.col(c).cast("string") for c in ("sid", "stay_idx", "row_idx")])
    )
    return clean.jitter(filled, CONTINUOUS, "id")


@query(
    "code:s n:i",
    "SELECT code, count(*) AS n FROM allcodes GROUP BY code ORDER BY n DESC, code LIMIT 10",
)
def top_codes(spark, d):
    return clean.top_codes(proxy.raw_codes(spark, d), 10)


@query(
    "sid:i stay_idx:i",
    f"SELECT sid, stay_idx FROM stays ORDER BY {oracle.uniform(0, 'hadm_id')}, hadm_id LIMIT 1000",
)
def sample_stays(spark, d):
    return sampling.sample_n(Records(spark, d).stays, "hadm_id", 1000)


@query("sid:i stay_idx:i", f"SELECT sid, stay_idx FROM stays WHERE {oracle.uniform(42, 'sid')} < 0.2")
def sample_fraction(spark, d):
    return sampling.sample_frac(proxy.stays(spark, d), "sid", 0.2)


@query(
    "metric:s family:s value:f",
    """SELECT 'r2' AS metric, family, r2 AS value FROM ("""
    + _R2.format(where="WHERE family IN ('visit_code', 'record_code')")
    + ") UNION ALL SELECT 'n_keys', family, n_keys FROM (" + _R2.format(where="WHERE family IN ('visit_code', 'record_code')") + ")",
)
def metric_table(spark, d):
    return sampling.metric_table(
        _code_r2(spark, d, ("visit_code", "record_code")), ["family"], ["r2", "n_keys"]
    )


# --- vocabulary and bins -------------------------------------------------------------

@query("code_id:i sys:s code:s n:i", "SELECT code_id, sys, code, n FROM code_vocab")
def code_vocab(spark, d):
    return vocab.code_vocab(Records(spark, d).codes)


@query("token_id:i kind:s var_id:i value:i literal:s", "SELECT * FROM vocab")
def vocab_layout(spark, d):
    return Records(spark, d).meta.vocab()


@query(
    "part:s n:i",
    """SELECT * FROM (SELECT CASE WHEN kind = 'code' THEN 'codes' WHEN kind = 'ts' AND var_id = 0 THEN 'lab_cat'
    WHEN kind = 'ts' THEN 'lab_cont' WHEN kind = 'timestamp' THEN 'gap' WHEN kind = 'covar' THEN 'covars'
    WHEN kind = 'special' THEN 'special' ELSE 'labels' END AS part, count(*) AS n FROM vocab GROUP BY part)
    UNION ALL SELECT 'total', count(*) FROM vocab""",
)
def vocab_sizes(spark, d):
    return vocab.vocab_sizes(Records(spark, d).meta)


def _ranks(spark, d):
    return vocab.series_ranks(Records(spark, d).train_series, CONTINUOUS)


@query(
    "var:s missing_rate:f n_unique:i mean:f std:f min:f max:f q025:f median:f q975:f",
    "SELECT * FROM prof",
)
def profile(spark, d):
    return vocab.profile(_ranks(spark, d))


@query(
    "var:s n_bins:i mean_2:f std_2:f min_2:f max_2:f q025_2:f median_2:f q975_2:f", "SELECT * FROM stats"
)
def trim(spark, d):
    return vocab.series_stats(_ranks(spark, d), proxy.TRIM_RATIO)


@query(
    "var:s missing_rate:f min:f min_2:f q025:f median:f q975:f max:f max_2:f n_tokens:i",
    "SELECT *, n_bins AS n_tokens FROM stats",
)
def variable_report(spark, d):
    return vocab.variable_report(vocab.series_stats(_ranks(spark, d), proxy.TRIM_RATIO))


@query(
    "var:s i:i edge:f",
    "SELECT var, unnest(range(0, len(e))) AS i, unnest(e) AS edge FROM edges",
)
def uniform_edges(spark, d):
    stats = vocab.series_stats(_ranks(spark, d), proxy.TRIM_RATIO)
    return vocab.uniform_edges(stats).select("var", F.posexplode("edges").alias("i", "edge"))


@query(
    "var:s i:i edge:f",
    "SELECT var, unnest(range(0, len(e))) AS i, unnest(e) AS edge FROM qedges",
)
def quantile_edges(spark, d):
    ranks = _ranks(spark, d)
    stats = durable(vocab.series_stats(ranks, proxy.TRIM_RATIO))
    kept = vocab.trim_outliers(ranks, stats, proxy.TRIM_RATIO)
    return vocab.quantile_edges(kept, stats).select("var", F.posexplode("edges").alias("i", "edge"))


@query(
    "var:s bin:i n:i share:f center:f label:s",
    """SELECT g.var, g.bin, count(t.bin) AS n, count(t.bin) / any_value(total) AS share, any_value(center) AS center,
    g.var || '_' || g.bin AS label FROM (SELECT var, unnest(range(0, len(e) - 1)) AS bin,
    unnest(list_transform(range(0, len(e) - 1), lambda i: (e[i + 1] + e[i + 2]) / 2)) AS center FROM edges) g
    LEFT JOIN (SELECT var, len(list_filter(e[2:len(e)-1], lambda x: x <= value)) AS bin FROM trimmed JOIN edges USING (var)) t
    ON t.var = g.var AND t.bin = g.bin JOIN (SELECT var, count(*) AS total FROM trimmed GROUP BY var) n ON n.var = g.var
    GROUP BY g.var, g.bin""",
)
def histogram(spark, d):
    ranks = _ranks(spark, d)
    stats = durable(vocab.series_stats(ranks, proxy.TRIM_RATIO))
    kept = vocab.trim_outliers(ranks, stats, proxy.TRIM_RATIO)
    return vocab.bin_histogram(kept, vocab.uniform_edges(stats))


@query(
    "var:s text:s value:i",
    """SELECT 'k_band' AS var, k_band AS text, row_number() OVER (ORDER BY seen, k_band) - 1 AS value FROM (
    SELECT k_band, min(ROW(sid, stay_idx, row_idx)) AS seen FROM series WHERE k_band IS NOT NULL GROUP BY k_band)""",
)
def category_map(spark, d):
    return vocab.category_map(Records(spark, d).series, ["k_band"], ["sid", "stay_idx", "row_idx"])


@query("token_id:i target_id:i weight:f", "SELECT token_id, target_id, weight FROM soft")
def soft_labels(spark, d):
    return vocab.soft_labels(Records(spark, d).meta)


# --- restructuring --------------------------------------------------------------------

@query(
    "hadm_id:i sid:i episode:i gender:i",
    """SELECT o_orderkey AS hadm_id, o_custkey AS sid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS episode,
    gender FROM orders JOIN subj ON sid = o_custkey""",
)
def resolve_stays(spark, d):
    """Listed (sid, n) pairs to the n-th admission by date."""
    listed = proxy.stays(spark, d).select("sid", F.col("stay_idx").cast("long").alias("episode"), "list_pos")
    file = table(spark, d, "orders").select(
        F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderdate").alias("admitted")
    )
    month = F.year("admitted") * 12 + F.month("admitted")
    people = proxy.subjects(spark, d).select("sid", "age", F.col("gender_text").alias("gender"))
    return restructure.resolve_stays(listed, file.join(people, "sid"), month, ["admitted", "hadm_id"])


@query(
    "hadm_id:i sid:i stay_idx:i code_pos:i code:s",
    "SELECT hadm_id, sid, stay_idx, code_pos, code FROM stays LEFT JOIN codes USING (hadm_id)",
)
def stay_codes(spark, d):
    return restructure.attach_codes(proxy.stays(spark, d), proxy.codes(spark, d))


@query("sid:i stay_idx:i list_pos:i", "SELECT sid, stay_idx, hadm_id AS list_pos FROM stays")
def number_stays(spark, d):
    return restructure.number_stays(proxy.listed_stays(spark, d))


@query(
    "sid:i split:s n_stays:i first_list_pos:i",
    "SELECT sid, any_value(split) AS split, count(*) AS n_stays, min(hadm_id) AS first_list_pos FROM stays GROUP BY sid",
)
def patients(spark, d):
    return restructure.patients(proxy.stays(spark, d))


@query(
    "sid:i part:i visits:s",
    """SELECT sid, part, string_agg(stay_idx || '/' || hadm_id || '/' || l0 || l1 || l2 || label_ihm || '=' || codes, ';' ORDER BY stay_idx) AS visits FROM (
    SELECT sid, part, stay_idx, any_value(hadm_id) AS hadm_id, any_value(l0) AS l0, any_value(l1) AS l1, any_value(l2) AS l2, any_value(label_ihm) AS label_ihm,
      coalesce(string_agg(code, ',' ORDER BY code_pos), '') AS codes FROM (
      SELECT s.*, code_pos, code, (row_number() OVER (PARTITION BY s.sid ORDER BY s.stay_idx, code_pos) - 1) // 16 AS part FROM stays s LEFT JOIN codes USING (hadm_id))
    GROUP BY sid, part, stay_idx) GROUP BY sid, part""",
)
def patient_records(spark, d):
    """Nested patient records of at most 16 codes a row."""
    r = Records(spark, d)
    nested = restructure.nest_records(r.stays, r.codes, 16)
    def line(v):
        labels = F.array_join(v["label_phe"].cast("array<string>"), "")
        head = F.concat_ws("/", v["stay_idx"].cast("string"), v["hadm_id"].cast("string"), F.concat(labels, v["label_ihm"].cast("string")))
        return F.concat(head, F.lit("="), F.array_join(v["codes"], ","))
    return nested.select("sid", "part", F.array_join(F.transform("visits", line), ";").alias("visits"))


@query(
    "in_a:i in_b:i n:i",
    """SELECT (a.k IS NOT NULL)::INT AS in_a, (b.k IS NOT NULL)::INT AS in_b, count(*) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a
    FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b USING (k) GROUP BY ALL""",
)
def task_overlap(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("stay")).distinct()
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stay")).distinct()
    return restructure.task_overlap(a, b).groupBy("in_a", "in_b").agg(F.count("*").alias("n"))


@query(
    "sid:i stay_idx:i code_pos:i code_id:i",
    "SELECT sid, stay_idx, code_pos, code_id FROM stay_codes JOIN code_vocab USING (code)",
)
def lookup_tokens(spark, d):
    r = Records(spark, d)
    ids = durable(vocab.code_vocab(r.codes)).select("code", "code_id")
    return restructure.lookup_tokens(r.stay_codes, ids, ["code"])


@query(
    "side:s n:i",
    """SELECT 'a' AS side, count(*) AS n FROM orders WHERE o_custkey IN (SELECT user_id FROM events)
    UNION ALL SELECT 'b', count(*) FROM events WHERE user_id IN (SELECT o_custkey FROM orders)""",
)
def intersect_ids(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    b = table(spark, d, "events").select(F.col("user_id").alias("id"))
    left, right = restructure.intersect_ids(a, b)
    return union_all(
        [x.agg(F.count("*").alias("n")).withColumn("side", F.lit(s)) for s, x in (("a", left), ("b", right))]
    )


_grid_cells = ", ".join(
    f"CASE WHEN \"{v}\" IS NULL THEN 0.0 ELSE \"{v}\" * 2 - 1 END AS value_{v}, CASE WHEN \"{v}\" IS NULL THEN -1 ELSE 1 END AS mask_{v}"
    for v in CONTINUOUS
)


@query(
    "cohort:s id:i cell:i " + " ".join(f"value_{v}:f mask_{v}:i" for v in CONTINUOUS),
    f"""SELECT cohort, id, cell, {_grid_cells} FROM (SELECT *, row_number() OVER (PARTITION BY cohort, id ORDER BY hours, click, error, purchase, signup, "view") - 1 AS cell
    FROM (SELECT DISTINCT cohort, id, g * 3.0 AS hours FROM cohorts, (SELECT unnest(range(0, 16)) AS g))
    FULL JOIN cohorts USING (cohort, id, hours)) WHERE cell < 16""",
)
def to_grid(spark, d):
    """Three-hour grid of 16 rows; hourly rows in between push grid rows out."""
    series_ = Records(spark, d).series
    grids = [
        restructure.to_grid(cohort_series(series_, c), "id", "hours", CONTINUOUS, 3.0, 16).withColumn("cohort", F.lit(c))
        for c in proxy.COHORTS.values()
    ]
    return union_all(grids)


# --- discretize -----------------------------------------------------------------------

@query(
    "sid:i stay_idx:i section:i a:i b:i kind:s var_id:i value:i",
    "SELECT * FROM disc",
)
def discretized(spark, d):
    return Records(spark, d).events


@query("sid:i stay_idx:i section:i a:i b:i kind:s var_id:i value:i", "SELECT * FROM disc")
def discretized_cache(spark, d):
    """The discretized table written under its metadata's key, and read from there."""
    r = Records(spark, d)
    path = scratch(spark)
    io.cached(spark, lambda: r.events, path, r.meta.key())
    return io.cached(spark, lambda: r.events.limit(0), path, r.meta.key())


@query("sid:i stay_idx:i row_idx:i gap:i", "SELECT sid, stay_idx, row_idx, gap FROM gaps")
def gap_bins(spark, d):
    return discretize.gap_bin(Records(spark, d).stay_series, proxy.FIXED_HOURS)


@query("sid:i stay_idx:i horizon:f row_idx:i", "SELECT sid, stay_idx, horizon, row_idx FROM horizons")
def horizon_rows(spark, d):
    return discretize.horizon_rows(Records(spark, d).stay_series)


@query(
    "var:s n_bad:i",
    """SELECT 'props' AS var, count(*) AS n_bad FROM events WHERE TRY_CAST(props AS DOUBLE) IS NULL AND props IS NOT NULL
    UNION ALL SELECT 'value', count(*) FROM events WHERE FALSE
    UNION ALL SELECT 'event_type', count(*) FROM events WHERE event_type IS NOT NULL""",
)
def bad_values(spark, d):
    return discretize.bad_value_report(table(spark, d, "events"), ["props", "value", "event_type"])


# --- tokens ---------------------------------------------------------------------------

@query("seq:i pos:i token_id:i", "SELECT seq, pos, token_id FROM tokens")
def token_table(spark, d):
    return Records(spark, d).tokens


@query(
    "seq:i pos:i token_id:i",
    """SELECT seq, token_id, row_number() OVER (PARTITION BY seq ORDER BY stay_idx, section, a, b) - 1 AS pos
    FROM token_rows WHERE section NOT IN (7, 8)""",
)
def tokens_without_series(spark, d):
    r = Records(spark, d)
    return tokens.tokenize(r.events, r.stays, r.meta, ignore_ts=True)


@query(
    "seq:i pos:i token_id:i",
    f"""SELECT seq, token_id, row_number() OVER (PARTITION BY seq ORDER BY stay_idx, section, a, b, token_id) - 1 AS pos FROM (
    SELECT sid AS seq, stay_idx, section, a, CASE kind WHEN 'phe' THEN draw + 1 WHEN 'ts' THEN draw WHEN 'timestamp' THEN 1099511627776 + 1000000 ELSE b END AS b,
    CASE WHEN kind = 'code' THEN value ELSE start + value END AS token_id FROM (
      SELECT *, CAST(floor({oracle.uniform(7, "sid", "stay_idx", "a", "kind", "var_id", "value")} * 1099511627776.0) AS BIGINT) AS draw FROM disc) LEFT JOIN sect USING (kind, var_id)
    UNION ALL SELECT sid, stay_idx, section, 0, 0, token_id FROM marks)""",
)
def tokens_shuffled(spark, d):
    r = Records(spark, d)
    return tokens.tokenize(r.events, r.stays, r.meta, label_shuffle=True, ts_shuffle=True, seed=7)


@query("seq:i horizon:f position:i", "SELECT seq, horizon, position FROM token_hor")
def token_horizons(spark, d):
    r = Records(spark, d)
    return tokens.token_horizons(r.tokens, discretize.horizon_rows(r.stay_series))


@query(
    "n_records:i n_tokens:i n_truncated:i",
    f"""SELECT count(*) AS n_records, sum(least(n, {N_CTX})) AS n_tokens, sum(greatest(n - {N_CTX}, 0)) AS n_truncated
    FROM (SELECT count(*) AS n FROM tokens GROUP BY seq)""",
)
def token_report(spark, d):
    return tokens.token_report(Records(spark, d).tokens, N_CTX)


@query(
    "seq:i chunk:i tokens:s",
    f"""SELECT seq, pos // {N_CTX} AS chunk, string_agg(token_id::VARCHAR, ' ' ORDER BY pos) AS tokens FROM tokens GROUP BY seq, pos // {N_CTX}""",
)
def chunks(spark, d):
    out = tokens.sequences(tokens.chunk(Records(spark, d).tokens, N_CTX), N_CTX, ["seq", "chunk"])
    return out.withColumn("tokens", F.concat_ws(" ", "tokens"))


def _fill(cells: str) -> str:
    """A token list padded to the context, as text."""
    return f"array_to_string(list_concat({cells}, list_transform(range(len({cells}), {CONTEXT_TOKENS}), lambda x: pad)), ' ')"


def _real(cells: str) -> str:
    """1 for tokens that are no padding, as text."""
    return f"array_to_string(list_transform(range(0, {CONTEXT_TOKENS}), lambda x: CASE WHEN x < len({cells}) AND {cells}[x + 1] <> pad THEN 1 ELSE 0 END), ' ')"


_pad = "(SELECT token_id AS pad FROM special WHERE literal = '<pad>')"
_masked = f"""SELECT seq, pos, token_id, CASE WHEN {oracle.uniform(3, "'pick'", "seq", "pos")} < 0.15 AND {oracle.uniform(3, "'replace'", "seq", "pos")} < 0.8
    THEN pad ELSE token_id END AS masked FROM tokens, {_pad}"""


@query(
    "seq:i labels:s attention_mask:s",
    f"""SELECT seq, {_fill("t")} AS labels, {_real("t")} AS attention_mask
    FROM (SELECT seq, list(token_id ORDER BY pos) AS t FROM tokens WHERE pos < {CONTEXT_TOKENS} GROUP BY seq), {_pad}""",
)
def padded(spark, d):
    r = Records(spark, d)
    pad = r.meta.special("<pad>")
    out = tokens.sequences(r.tokens, CONTEXT_TOKENS).withColumn("labels", pad_array("tokens", CONTEXT_TOKENS, pad))
    return out.select(
        "seq", F.concat_ws(" ", "labels").alias("labels"),
        F.concat_ws(" ", attention_mask("labels", pad)).alias("attention_mask"),
    )


@query(
    "seq:i input_ids:s labels:s attention_mask:s",
    f"""SELECT seq, {_fill("m")} AS input_ids, {_fill("t")} AS labels, {_real("m")} AS attention_mask FROM (
    SELECT seq, list(token_id ORDER BY pos) AS t, list(masked ORDER BY pos) AS m FROM ({_masked}) WHERE pos < {CONTEXT_TOKENS} GROUP BY seq), {_pad}""",
)
def training_rows(spark, d):
    """Masked model rows of the whole context."""
    r = Records(spark, d)
    out = tokens.training_rows(r.dealt_tokens, CONTEXT_TOKENS, r.meta.special("<pad>"), 0.15, 3)
    return out.select("seq", *[F.concat_ws(" ", c).alias(c) for c in ("input_ids", "labels", "attention_mask")])


@query(
    "seq:i pos:i masked:i",
    f"SELECT seq, pos, masked FROM ({_masked})",
)
def masked_tokens(spark, d):
    r = Records(spark, d)
    return tokens.mask(r.tokens, r.meta.special("<pad>"), 0.15, 3)


@query(
    "seq:i chunk:i text:s",
    f"""SELECT seq, pos // {N_CTX} AS chunk, string_agg(CASE kind WHEN 'special' THEN literal WHEN 'code' THEN 'code ' || value
    WHEN 'phe' THEN 'label phe ' || value WHEN 'ihm' THEN 'label ihm ' || value ELSE kind || ' ' || var_id || ' ' || value END, ' ' ORDER BY pos) AS text
    FROM tokens JOIN vocab USING (token_id) GROUP BY seq, pos // {N_CTX}""",
)
def render_text(spark, d):
    r = Records(spark, d)
    return tokens.render_text(r.tokens, r.meta.vocab(), N_CTX)


@query(
    "seq:i stay_idx:i place:i kind:s var_id:i value:i",
    """SELECT sid AS seq, stay_idx, row_number() OVER (PARTITION BY sid, stay_idx ORDER BY section, a, b) - 1 AS place, kind, var_id, value FROM disc""",
)
def roundtrip(spark, d):
    """Detokenized sequences hold, in order, exactly what was tokenized."""
    r = Records(spark, d)
    stays, events = tokens.detokenize(r.dealt_tokens, r.meta, counted=r.token_owners)
    rows, _ = tokens.events_as_input(stays, events)
    blocked = rows.withColumnRenamed("sid", "seq").withColumn("_block", F.floor(F.col("a") / 4096))
    owners = r.events.select(F.col("sid").alias("seq"), "stay_idx")  # no stay has more rows than were tokenized
    return position_in(blocked, ["seq", "stay_idx"], ["section", "_block"], ["a", "b"], "place", counted=owners)


@query(
    "sid:i stay_idx:i kind:s n:i",
    "SELECT sid, stay_idx, kind, count(*) AS n FROM disc JOIN subj USING (sid) WHERE split = 'synthetic' GROUP BY ALL",
)
def saved_synthetic(spark, d):
    """One split, detokenized, saved as synthetic records and read again."""
    r = Records(spark, d)
    picked = r.dealt_split_tokens.where(F.col("split") == "synthetic").select("seq", "pos", "token_id", "stay_idx", "row_idx")
    stays, events = tokens.detokenize(durable(picked), r.meta)
    rows, _ = tokens.events_as_input(stays, events)
    path = scratch(spark)
    io.save_synthetic(rows, path, "synthetic")
    return spark.read.parquet(f"{path}/synthetic").groupBy("sid", "stay_idx", "kind").agg(F.count("*").alias("n"))


@query(
    "n_full:i n_truncated:i",
    f"""SELECT count(*) FILTER (WHERE n <= {N_CTX * 2}) AS n_full, count(*) FILTER (WHERE n > {N_CTX * 2}) AS n_truncated
    FROM (SELECT count(*) AS n FROM tokens GROUP BY seq)""",
)
def completion(spark, d):
    r = Records(spark, d)
    return tokens.completion_report(tokens.truncate(r.tokens, N_CTX * 2), r.meta)


@query(
    "horizon:f seq:i input_ids:s",
    """SELECT horizon, seq, array_to_string(list_concat(list_transform(range(len(t), m), lambda x: pad), t), ' ') AS input_ids FROM (
    SELECT *, max(len(t)) OVER (PARTITION BY horizon) AS m FROM (SELECT horizon, t.seq, list(token_id ORDER BY pos) AS t FROM tokens t JOIN token_hor h ON h.seq = t.seq
    WHERE pos < least(position, 1024) GROUP BY horizon, t.seq)), (SELECT token_id AS pad FROM special WHERE literal = '<pad>')""",
)
def history_prompts(spark, d):
    r = Records(spark, d)
    horizons = durable(tokens.token_horizons(r.tokens, discretize.horizon_rows(r.stay_series)))
    parts = [
        tokens.history_prompts(r.tokens, horizons, h, CONTEXT_TOKENS, r.meta.special("<pad>")).withColumn("horizon", F.lit(h))
        for h in HORIZON_HOURS
    ]
    return union_all(parts).withColumn("input_ids", F.concat_ws(" ", "input_ids"))


@query(
    "seq:i pos:i segment:i",
    """SELECT seq, pos, sum((token_id IN (SELECT token_id FROM special WHERE literal IN ('<s>', '</label>', '</adm>')))::INT)
    OVER (PARTITION BY seq ORDER BY pos) AS segment FROM tokens""",
)
def segments(spark, d):
    r = Records(spark, d)
    boundaries = [r.meta.special(t) for t in ("<s>", "</label>", "</adm>")]
    return tokens.segment_index(r.dealt_tokens, boundaries, counted=r.token_owners)


@query(
    "seq:i pos:i seen:i",
    "SELECT seq, pos, row_number() OVER (PARTITION BY seq, token_id ORDER BY pos) AS seen FROM tokens",
)
def running_counts(spark, d):
    return tokens.running_counts(Records(spark, d).tokens)


@query(
    "group_id:i n:i",
    """SELECT coalesce(group_id, 5) AS group_id, count(*) AS n FROM tokens LEFT JOIN (
    SELECT code_id AS token_id, p_size % 5 AS group_id FROM code_vocab JOIN part ON p_partkey = CAST(split_part(code, '_', 2) AS BIGINT)) USING (token_id) GROUP BY 1""",
)
def ancestor_groups(spark, d):
    """Codes to the size class of their part."""
    r = Records(spark, d)
    parts = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("_k"), (F.col("p_size") % 5).alias("group_id")
    )
    groups = r.meta.codes.withColumn("_k", F.split_part("code", F.lit("_"), F.lit(2))).join(parts, "_k")
    out = tokens.ancestor_groups(r.tokens, groups.select(F.col("code_id").alias("token_id"), "group_id"), 5)
    return out.groupBy("group_id").agg(F.count("*").alias("n"))


# --- sequence model ----------------------------------------------------------------------

def _model(r: Records) -> tuple[DataFrame, DataFrame]:
    rows = split_tokens(r)
    train = rows.where(F.col("split") == "train")
    return durable(seqmodel.fit_sequence_model(train)), rows


#: Splits that a model of the training split is scored on.
SCORED = ["val", "test", "synthetic"]


def _scored_model(r: Records) -> tuple[DataFrame, DataFrame]:
    """The model of the training split and the counted tokens of those it is scored on: the tokens are counted once."""
    counts = seqmodel.context_counts(r.dealt_split_tokens, 2, ["split"])
    model = durable(seqmodel.fit_sequence_model(counts.where(F.col("split") == "train"), 2))
    return model, counts.where(F.col("split").isin(SCORED))


def _of_each(spark, found: DataFrame) -> DataFrame:
    """One row per scored split, also of those without a token."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in SCORED])).alias("split"))
    return names.join(found, "split", "left")


def _two_tokens(df: DataFrame) -> DataFrame:
    """The context of a model of order 2 as two columns, -1 where there is none."""
    return df.withColumns({f"c{i}": F.coalesce(F.try_element_at("context", F.lit(i)), F.lit(-1)) for i in (1, 2)})


@query("order:i c1:i c2:i next:i n:i", 'SELECT "order", c1, c2, next, n FROM seq_model')
def sequence_model(spark, d):
    rows = split_tokens(Records(spark, d))
    return _two_tokens(seqmodel.fit_sequence_model(rows.where(F.col("split") == "train")))


_lags = ", ".join(f"lag(token_id, {j}) OVER w AS c{j}" for j in range(1, 6))
_levels = " UNION ALL ".join(
    f"""SELECT {k} AS "order", {f"concat_ws(',', {', '.join(f'c{j}' for j in range(1, k + 1))})" if k else "''"} AS context, next, count(*) AS n
    FROM g WHERE {f'c{k} IS NOT NULL' if k else 'pos > 0'} GROUP BY ALL"""
    for k in range(6)
)


@query(
    "order:i context:s next:i n:i",
    f"""SELECT * FROM (WITH g AS (SELECT pos, token_id AS next, {_lags} FROM split_tokens WHERE split = 'train'
    WINDOW w AS (PARTITION BY seq ORDER BY pos)) {_levels})""",
)
def sequence_model_5(spark, d):
    """Orders 0 to 5."""
    rows = split_tokens(Records(spark, d))
    model = seqmodel.fit_sequence_model(rows.where(F.col("split") == "train"), 5)
    return model.withColumn("context", F.array_join(F.col("context").cast("array<string>"), ","))


@query(
    "order:i c1:i c2:i next:i p:f",
    """SELECT "order", c1, c2, next, p / sum(p) OVER (PARTITION BY "order", c1, c2) AS p FROM (
    SELECT * FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY "order", c1, c2 ORDER BY p DESC, next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT * EXCLUDE (p), p / sum(p) OVER (PARTITION BY "order", c1, c2) AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY "order", c1, c2 ORDER BY p DESC, next) AS rk FROM (
      SELECT "order", c1, c2, next, power(n / sum(n) OVER (PARTITION BY "order", c1, c2), 1 / 0.8) AS p FROM seq_model)) WHERE rk <= 20))
    WHERE before < 0.9)""",
)
def next_tokens(spark, d):
    model, _ = _model(Records(spark, d))
    return _two_tokens(seqmodel.next_token_dist(model, temperature=0.8, top_k=20, top_p=0.9))


_logp = """ln((coalesce(m.n, 0) + 1.0) / (coalesce(t2.total, t1.total, t0.total) + 1.0 * (SELECT count(*) FROM vocab)))"""
_score_joins = """LEFT JOIN model_totals t2 ON t2."order" = 2 AND t2.c1 = g.c1 AND t2.c2 = g.c2
    LEFT JOIN model_totals t1 ON t1."order" = 1 AND t1.c1 = g.c1
    JOIN model_totals t0 ON t0."order" = 0
    LEFT JOIN seq_model m ON m."order" = CASE WHEN t2.total IS NOT NULL THEN 2 WHEN t1.total IS NOT NULL THEN 1 ELSE 0 END
    AND m.c1 = CASE WHEN t2.total IS NOT NULL OR t1.total IS NOT NULL THEN g.c1 ELSE -1 END
    AND m.c2 = CASE WHEN t2.total IS NOT NULL THEN g.c2 ELSE -1 END AND m.next = g.next"""


@query(
    "split:s n_tokens:i perplexity:f",
    f"""SELECT split, sum(g.m) AS n_tokens, exp(-sum(g.m * {_logp}) / sum(g.m)) AS perplexity FROM test_grams g {_score_joins} GROUP BY split""",
)
def perplexity(spark, d):
    r = Records(spark, d)
    model, rows = _scored_model(r)
    size = r.meta.vocab().agg(F.count("*")).scalar()
    return _of_each(spark, seqmodel.perplexity(model, rows, size, by=["split"]))


@query(
    "split:s perplexity:f",
    f"""SELECT split, exp(-sum(g.m * g.weight * {_logp}) / sum(g.m * g.weight)) AS perplexity FROM (
    SELECT split, c1, c2, target_id AS next, m, weight FROM test_grams JOIN soft ON token_id = next) g {_score_joins} GROUP BY split""",
)
def soft_perplexity(spark, d):
    r = Records(spark, d)
    model, rows = _scored_model(r)
    size = r.meta.vocab().agg(F.count("*")).scalar()
    soft = durable(vocab.soft_labels(r.meta))
    return _of_each(spark, seqmodel.soft_perplexity(model, rows, soft, size, by=["split"]))


@query(
    "ahead:i token_id:i next:i n:i p:f",
    """SELECT *, n / sum(n) OVER (PARTITION BY ahead, token_id) AS p FROM (SELECT ahead, token_id, next, count(*) AS n FROM (
    SELECT 1 AS ahead, token_id, lead(token_id, 1) OVER (PARTITION BY seq ORDER BY pos) AS next FROM tokens UNION ALL
    SELECT 2, token_id, lead(token_id, 2) OVER (PARTITION BY seq ORDER BY pos) FROM tokens UNION ALL
    SELECT 3, token_id, lead(token_id, 3) OVER (PARTITION BY seq ORDER BY pos) FROM tokens) WHERE next IS NOT NULL GROUP BY ALL)""",
)
def lookahead(spark, d):
    return seqmodel.lookahead_model(Records(spark, d).tokens, 3)


_heads = " UNION ALL ".join(
    f"SELECT split, {j} AS ahead, token_id, lead(token_id, {j}) OVER (PARTITION BY seq ORDER BY pos) AS next FROM split_tokens" for j in (1, 2, 3)
)


@query(
    "split:s ahead:i perplexity:f",
    f"""SELECT * FROM (WITH heads AS (SELECT * FROM ({_heads}) WHERE next IS NOT NULL),
    fitted AS (SELECT ahead, token_id, next, count(*) AS n FROM heads WHERE split = 'train' GROUP BY ALL),
    known AS (SELECT ahead, token_id, sum(n) AS total FROM fitted GROUP BY ALL)
    SELECT split, ahead, exp(-avg(ln((coalesce(n, 0) + 1.0) / (coalesce(total, 0) + (SELECT count(*) FROM vocab))))) AS perplexity
    FROM heads LEFT JOIN known USING (ahead, token_id) LEFT JOIN fitted USING (ahead, token_id, next) WHERE split <> 'train' GROUP BY ALL)""",
)
def lookahead_scores(spark, d):
    r = Records(spark, d)
    counts = durable(seqmodel.lookahead_model(r.dealt_split_tokens, 3, by=["split"]).drop("p"))
    fitted = counts.where(F.col("split") == "train").drop("split")
    size = r.meta.vocab().agg(F.count("*")).scalar()
    return seqmodel.lookahead_perplexity(fitted, counts.where(F.col("split").isin(SCORED)), 3, size, by=["split"])


@query("seq:i pos:i token_id:i")
def generate(spark, d):
    """One synthetic sequence per subject of the tables, of at most 1024 tokens."""
    r = Records(spark, d)
    model, _ = _model(r)
    prompts = r.stays.select(F.col("sid").alias("seq")).distinct().withColumn(
        "input_ids", F.array(F.lit(r.meta.special("<s>")))
    )
    return seqmodel.generate(
        model, prompts, CONTEXT_TOKENS, r.meta.special("</s>"), seed=11, top_k=50, repetition_penalty=1.05
    )


# --- n-grams and text --------------------------------------------------------------------

def _ngram_sql(n: int) -> str:
    keys = ", ".join(f"t{i + 1}" for i in range(n))
    return f"SELECT {keys}, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM gram{n} WHERE t{n} IS NOT NULL GROUP BY {keys}"


def _register_ngrams():
    for n in (1, 2, 3, 4):
        def run(spark, d, n=n):
            return ngrams.ngram_probs(Records(spark, d).tokens, n)

        run.__name__ = f"ngram_{n}"
        query(" ".join(f"t{i + 1}:i" for i in range(n)) + " n:i p:f", _ngram_sql(n))(run)


_register_ngrams()


@query(
    "t1:i t2:i n:i p:f",
    """SELECT t1, t2, n, p FROM (SELECT t1, t2, count(*) AS n, count(*) / sum(count(*)) OVER () AS p FROM (
    SELECT token_id AS t1, lead(token_id) OVER (PARTITION BY seq ORDER BY pos) AS t2 FROM tokens
    WHERE token_id <> (SELECT token_id FROM special WHERE literal = '</adm>')) WHERE t2 IS NOT NULL GROUP BY t1, t2) WHERE p BETWEEN 0.0001 AND 0.01""",
)
def ngram_limits(spark, d):
    """Pairs across dropped tokens, of a share within limits."""
    r = Records(spark, d)
    return ngrams.ngram_probs(r.tokens, 2, 0.0001, 0.01, r.meta.special("</adm>"))


def _share_sql(n: int, split: str) -> str:
    keys = ", ".join(f"t{i + 1}" for i in range(n))
    cells = ", ".join(f"t{i + 1}" if i < n else f"-1 AS t{i + 1}" for i in range(4))
    return f"""SELECT {n} AS ord, {cells}, count(*) / sum(count(*)) OVER () AS p FROM gram{n}
      WHERE t{n} IS NOT NULL AND split = '{split}' GROUP BY {keys}"""


_shares = {s: " UNION ALL ".join(_share_sql(n, s) for n in (1, 2, 3, 4)) for s in ("train", "val", "synthetic")}
_r2 = "1 - sum(({a} - {b}) * ({a} - {b})) / nullif(var_pop({a}) * count(*), 0)"
_cmp = "SELECT '{pair}' AS pair, ord, (SELECT count(*) FROM ({left}) z WHERE z.ord = o.ord) AS size, x, y FROM (SELECT ord, p / sum(p) OVER (PARTITION BY ord) AS x, q / sum(q) OVER (PARTITION BY ord) AS y FROM (SELECT l.ord, l.p, r.p AS q FROM ({left}) l JOIN ({right}) r USING (ord, t1, t2, t3, t4))) o"
_ngram_compare = f"""SELECT pair, ord AS "order",
    CASE WHEN c < 10 THEN 0 ELSE kl END AS kl, CASE WHEN c < 10 THEN 0 ELSE js END AS js, CASE WHEN c < 10 THEN 0 ELSE cosine END AS cosine,
    CASE WHEN c < 10 THEN 0 ELSE euclidean END AS euclidean, CASE WHEN c < 10 THEN 0 ELSE pearson END AS pearson, CASE WHEN c < 10 THEN 0 ELSE r2 END AS r2,
    CASE WHEN c >= 10 THEN r2_log END AS r2_log, CASE WHEN c < 10 THEN 0 ELSE 100.0 * c / size END AS common_pct FROM (
    SELECT pair, ord, any_value(size) AS size, count(*) AS c, sum(x * ln(x / y)) AS kl,
    0.5 * sum(x * ln(2 * x / (x + y))) + 0.5 * sum(y * ln(2 * y / (x + y))) AS js,
    sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS cosine, sqrt(sum((x - y) * (x - y))) AS euclidean,
    covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS pearson, {_r2.format(a="x", b="y")} AS r2, {_r2.format(a="ln(x)", b="ln(y)")} AS r2_log
    FROM ({_cmp.format(pair="train-val", left=_shares["train"], right=_shares["val"])} UNION ALL
    {_cmp.format(pair="train-synthetic", left=_shares["train"], right=_shares["synthetic"])}) GROUP BY pair, ord)"""


@query("pair:s order:i " + " ".join(f"{m}:f" for m in ngrams.METRICS), _ngram_compare)
def ngram_compare(spark, d):
    cohorts = Records(spark, d).dealt_split_tokens.withColumnRenamed("split", "cohort")
    return ngrams.ngram_report(cohorts, [("train", "val"), ("train", "synthetic")])


def _turn_pairs(spark, d):
    turns = table(spark, d, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return turns.join(after, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "pred", F.col("text").alias("ref")
    )


_words = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: len(w) >= 2)"


def _tf(where: str) -> str:
    return f"SELECT doc, word, count(*) AS tf FROM (SELECT doc_id AS doc, unnest({_words}) AS word FROM documents WHERE {where}) GROUP BY ALL"



@query(
    "rmse:f n_words:i",
    f"""WITH tr AS ({_tf("lang = 'en'")}), ot AS ({_tf("lang <> 'en'")}),
    idf AS (SELECT word, ln((1 + (SELECT count(*) FROM documents WHERE lang = 'en')) / (1 + count(*))) + 1 AS idf FROM tr GROUP BY word),
    wa AS (SELECT doc, word, tf * idf AS w FROM tr JOIN idf USING (word)), wb AS (SELECT doc, word, tf * idf AS w FROM ot JOIN idf USING (word)),
    ma AS (SELECT word, sum(w / n) / (SELECT count(*) FROM documents WHERE lang = 'en') AS a FROM wa JOIN (SELECT doc, sqrt(sum(w * w)) AS n FROM wa GROUP BY doc) USING (doc) GROUP BY word),
    mb AS (SELECT word, sum(w / n) / (SELECT count(*) FROM documents WHERE lang <> 'en') AS b FROM wb JOIN (SELECT doc, sqrt(sum(w * w)) AS n FROM wb GROUP BY doc) USING (doc) GROUP BY word)
    SELECT sqrt(avg(power(a - coalesce(b, 0), 2))) AS rmse, count(*) AS n_words FROM ma LEFT JOIN mb USING (word)""",
)
def tfidf(spark, d):
    """Drift of the other languages from the English documents."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang")
    return textsim.tfidf_drift(docs.where(F.col("lang") == "en"), docs.where(F.col("lang") != "en"))


_rw = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"
_gram_list = "list_transform(range(0, len({w}) - {n} + 1), lambda i: array_to_string({w}[i + 1:i + {n}], ' '))"


def _overlap(words: str, n: int) -> str:
    return f"""SELECT pair_id, {n} AS ord, gram, count(*) FILTER (WHERE side = 'p') AS p, count(*) FILTER (WHERE side = 'r') AS r FROM (
      SELECT pair_id, 'p' AS side, unnest({_gram_list.format(w="pw", n=n)}) AS gram FROM ({words})
      UNION ALL SELECT pair_id, 'r', unnest({_gram_list.format(w="rw", n=n)}) FROM ({words})) GROUP BY ALL"""


_rouge_words = f"SELECT pair_id, {_rw.format('pred')} AS pw, {_rw.format('ref')} AS rw FROM turns"


@query(
    "order:i f:f",
    f"""SELECT ord AS "order", sum(2.0 * hit / (p + r)) / (SELECT count(*) FROM turns) AS f FROM (SELECT pair_id, ord, sum(least(p, r)) AS hit, sum(p) AS p, sum(r) AS r
    FROM ({_overlap(_rouge_words, 1)} UNION ALL {_overlap(_rouge_words, 2)}) GROUP BY pair_id, ord) GROUP BY ord""",
)
def rouge(spark, d):
    return textsim.rouge_n(_turn_pairs(spark, d))


_lcs = """list_reduce(list_prepend(list_transform(range(0, len(pw) + 1), lambda k: 0), list_transform(rw, lambda w: list_transform(range(0, len(pw) + 1), lambda k: CASE WHEN k > 0 AND pw[k] = w THEN 1 ELSE 0 END))),
    lambda row, hit: list_transform(range(1, len(row) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda j: greatest(row[j], CASE WHEN j > 1 AND hit[j] = 1 THEN row[j - 1] + 1 ELSE 0 END)))))"""


@query(
    "f:f",
    f"SELECT avg(CASE WHEN len(pw) + len(rw) > 0 THEN 2.0 * list_last({_lcs}) / (len(pw) + len(rw)) ELSE 0.0 END) AS f FROM ({_rouge_words})",
)
def rouge_l(spark, d):
    return textsim.rouge_l(_turn_pairs(spark, d))


_bleu_words = "SELECT pair_id, string_split(pred, ' ') AS pw, string_split(ref, ' ') AS rw FROM turns"


@query(
    "bleu:f",
    f"""SELECT CASE WHEN min(pr) > 0 AND count(*) = 4 THEN (SELECT CASE WHEN sum(len(pw)) > sum(len(rw)) THEN 1.0 ELSE exp(1 - sum(len(rw)) / sum(len(pw))) END FROM ({_bleu_words})) * exp(sum(ln(pr)) / 4) ELSE 0.0 END AS bleu
    FROM (SELECT ord, sum(least(p, r)) / sum(p) AS pr FROM ({" UNION ALL ".join(_overlap(_bleu_words, n) for n in (1, 2, 3, 4))}) GROUP BY ord)""",
)
def bleu(spark, d):
    words = _turn_pairs(spark, d).select(
        "pair_id", F.split("pred", " ").alias("pred"), F.split("ref", " ").alias("ref")
    )
    return textsim.bleu(words)


_seqs = """SELECT split, row_number() OVER (PARTITION BY split ORDER BY seq) - 1 AS i, t FROM (
    SELECT split, seq, list(token_id ORDER BY pos) AS t FROM split_tokens WHERE split IN ('train', 'val', 'synthetic') GROUP BY ALL)"""
_report = f"""SELECT * FROM (WITH seqs AS ({_seqs}), size AS (SELECT split, count(*) AS n FROM seqs GROUP BY split),
    grams AS (SELECT split, i, n AS ord, unnest(list_transform(range(0, len(t) - n + 1), lambda k: t[k + 1:k + n])) AS g FROM seqs, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(t) >= n),
    counted AS (SELECT split, i, ord, g, count(*) AS c FROM grams GROUP BY ALL),
    against AS (SELECT o.split AS against, least(o.n, t.n) AS n FROM size o, size t WHERE t.split = 'train' AND o.split <> 'train'),
    met AS (SELECT against, i, ord, g, sum(c) FILTER (WHERE split = against) AS p, sum(c) FILTER (WHERE split = 'train') AS r, n
      FROM counted, against WHERE (split = against OR split = 'train') AND i < n GROUP BY ALL),
    hits AS (SELECT against, i, ord, n, sum(least(coalesce(p, 0), coalesce(r, 0))) AS hit, sum(coalesce(p, 0)) AS p, sum(coalesce(r, 0)) AS r FROM met GROUP BY ALL),
    orders AS (SELECT against, ord, sum(hit) AS hit, sum(p) AS p, sum(r) AS r FROM hits GROUP BY ALL),
    words AS (SELECT split, i, CAST(g[1] AS VARCHAR) AS word, c FROM counted WHERE ord = 1 AND len(CAST(g[1] AS VARCHAR)) >= 2),
    idf AS (SELECT word, ln((1 + (SELECT n FROM size WHERE split = 'train')) / (1 + count(*))) + 1 AS idf FROM words WHERE split = 'train' GROUP BY word),
    weights AS (SELECT split, i, word, c * idf AS w FROM words JOIN idf USING (word)),
    means AS (SELECT split, word, sum(w / norm) / any_value(n) AS m FROM weights JOIN (SELECT split, i, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ALL) USING (split, i) JOIN size USING (split) GROUP BY split, word)
    SELECT against, 'rouge' || ord AS metric, sum(2.0 * hit / (p + r)) / any_value(n) AS value FROM hits WHERE ord <= 2 GROUP BY against, ord
    UNION ALL SELECT against, 'bleu', CASE WHEN min(hit) > 0 AND count(*) = 4 THEN (CASE WHEN sum(p) FILTER (WHERE ord = 1) > sum(r) FILTER (WHERE ord = 1) THEN 1.0
      ELSE exp(1 - sum(r) FILTER (WHERE ord = 1) / sum(p) FILTER (WHERE ord = 1)) END) * exp(sum(ln(hit / p)) / 4) ELSE 0.0 END FROM orders GROUP BY against
    UNION ALL SELECT against, 'tfidf_rmse', sqrt(avg(power(t.m - coalesce(o.m, 0), 2))) FROM against JOIN means t ON t.split = 'train' LEFT JOIN means o ON o.split = against AND o.word = t.word GROUP BY against)"""


def _sequence_texts(spark, d) -> textsim.SequenceTexts:
    rows = split_tokens(Records(spark, d))
    return textsim.SequenceTexts({s: rows.where(F.col("split") == s) for s in ("train", "val", "synthetic")})


@query("against:s metric:s value:f", _report)
def text_report(spark, d):
    """Token sequences as texts: validation and synthetic ones against training ones."""
    return textsim.text_report(_sequence_texts(spark, d))


@query("against:s f:f")
def rouge_l_tokens(spark, d):
    texts = _sequence_texts(spark, d)
    return union_all([texts.rouge_l(s).withColumn("against", F.lit(s)) for s in ("val", "synthetic")])


# --- series fidelity -----------------------------------------------------------------------

def _cohorts(spark, d) -> dict[str, DataFrame]:
    frame = Records(spark, d).series
    return {c: cohort_series(frame, c) for c in ("real", "test", "synthetic")}


def _each(frames: dict[str, DataFrame], make) -> DataFrame:
    return union_all([make(f).withColumn("cohort", F.lit(c)) for c, f in frames.items()])


@query(
    "id:i cohort:s row_idx:i " + " ".join(f"{v}:f" for v in CONTINUOUS),
    "SELECT * FROM fill",
)
def ffill(spark, d):
    return _each(_cohorts(spark, d), lambda f: series.ffill(f, "id", CONTINUOUS))


@query(
    "cohort:s var_a:s var_b:s n_pairs:i corr:f",
    "SELECT cohort, var_a, var_b, coalesce(n_pairs, 0) AS n_pairs, corr FROM (SELECT DISTINCT cohort FROM cohorts) CROSS JOIN pair_names LEFT JOIN corr USING (cohort, var_a, var_b)",
)
def corr(spark, d):
    return _each(_cohorts(spark, d), lambda f: series.corr_matrix(f, CONTINUOUS, 100))


@query(
    "cohort:s var_a:s var_b:s n_pairs:i corr:f",
    "SELECT cohort, var_a, var_b, n_pairs, corr FROM corrf",
)
def corr_ffill(spark, d):
    return _each(_cohorts(spark, d), lambda f: series.correlation(f, CONTINUOUS, "ffill"))


@query("cohort:s var_a:s var_b:s n_pairs:i corr:f", "SELECT * FROM corr_id")
def corr_by_id(spark, d):
    return _each(_cohorts(spark, d), lambda f: series.correlation(f, CONTINUOUS, "agg"))


def _matrices(spark, d) -> dict[str, DataFrame]:
    return {
        c: durable(series.correlation(f, CONTINUOUS, "ffill")) for c, f in _cohorts(spark, d).items()
    }


def _against(spark, d, make) -> DataFrame:
    m = _matrices(spark, d)
    return union_all(
        [make(m["real"], m[c]).withColumn("against", F.lit(c)) for c in ("test", "synthetic")]
    )


TH = 0.05


@query(
    "against:s corr_distance:f",
    f"""SELECT against, sum(abs(CASE WHEN abs(ca) < {TH} THEN 0 ELSE coalesce(ca, 0) END - CASE WHEN abs(cb) < {TH} THEN 0 ELSE coalesce(cb, 0) END)) / count(*) AS corr_distance
    FROM band_pairs GROUP BY against""",
)
def corr_distance(spark, d):
    return _against(spark, d, lambda a, b: series.corr_distance(a, b, TH))


@query(
    "against:s var_a:s var_b:s diff:f",
    f"""SELECT against, var_a, var_b, CASE WHEN abs(ca) < {TH} THEN 0.0 WHEN abs(cb - ca) >= {TH} THEN abs(cb - ca) END AS diff FROM band_pairs""",
)
def corr_diff(spark, d):
    return _against(spark, d, lambda a, b: series.corr_diff(a, b, TH))


_band_list = "['high-neg', 'medium-neg', 'low', 'medium-pos', 'high-pos'"


@query(
    "against:s band_a:s band_b:s n:i",
    f"""SELECT against, band_a, band_b, count(p.var_a) AS n FROM (SELECT * FROM (SELECT unnest(['test', 'synthetic']) AS against), (SELECT unnest({_band_list}, 'null']) AS band_a),
    (SELECT unnest({_band_list}, 'null']) AS band_b)) LEFT JOIN band_pairs p USING (against, band_a, band_b) GROUP BY ALL""",
)
def band_confusion(spark, d):
    return _against(spark, d, series.band_confusion)


@query(
    "against:s band:s accuracy:f f1:f",
    f"""SELECT against, band, avg(((band_a = band) = (band_b = band))::INT) AS accuracy, coalesce(2.0 * sum((band_a = band AND band_b = band)::INT)
    / nullif(sum((band_a = band)::INT) + sum((band_b = band)::INT), 0), 0) AS f1 FROM band_pairs, (SELECT unnest({_band_list}]) AS band) GROUP BY against, band""",
)
def band_scores(spark, d):
    return _against(spark, d, series.band_scores)


_report_sql = " UNION ALL ".join(
    f"SELECT against, {metric} AS metric, {value} AS value FROM ({CATALOG[name].sql})"
    for name, metric, value in (
        ("corr_distance", "'corr_distance'", "corr_distance"),
        ("band_scores", "'accuracy/' || band", "accuracy"),
        ("band_scores", "'f1/' || band", "f1"),
        ("band_confusion", "'confusion/' || band_a || '/' || band_b", "n"),
        ("corr_diff", "'difference/' || var_a || '/' || var_b", "diff"),
    )
)


@query("against:s metric:s value:f", _report_sql)
def correlation_report(spark, d):
    c = _cohorts(spark, d)
    return series.correlation_report(c["real"], c["test"], c["synthetic"], CONTINUOUS, "ffill", TH)


FEATURES = [f"{v}_{n}" for v in CONTINUOUS for n in ("min", "max", "mean", "std")]


@query("cohort:s id:i " + " ".join(f"{f}:f" for f in FEATURES), "SELECT * FROM features")
def features(spark, d):
    c = _cohorts(spark, d)
    return _each(c, lambda f: series.summary_features(f, CONTINUOUS, c["real"]))


def _static(spark, d) -> DataFrame:
    """Labels of the series subjects, from their first stay."""
    first = clean.first_stay(proxy.stays(spark, d))
    return first.select(F.col("sid").alias("id"), *label_columns("label_phe", 3))


LABELS = [f"label_phe_{i}" for i in range(3)]


@query(
    "cohort:s id:i " + " ".join(f"{f}:f" for f in FEATURES) + " label_phe_0:i label_phe_1:i label_phe_2:i",
    """SELECT features.*, l0 AS label_phe_0, l1 AS label_phe_1, l2 AS label_phe_2
    FROM features JOIN stays ON sid = id WHERE stay_idx = 0""",
)
def feature_table(spark, d):
    c, static = _cohorts(spark, d), durable(_static(spark, d))
    return _each(c, lambda f: series.feature_table(f, static, CONTINUOUS, LABELS, c["real"]))


@query(
    "cohort:s id:i " + " ".join(f"mr_{v}:f" for v in CONTINUOUS),
    "SELECT cohort, id, "
    + ", ".join(f'count(*) FILTER (WHERE "{v}" IS NULL) / nullif(max(hours), 0) AS mr_{v}' for v in CONTINUOUS)
    + " FROM cohorts GROUP BY cohort, id",
)
def missing_rate(spark, d):
    return _each(_cohorts(spark, d), lambda f: series.missing_rate(f, CONTINUOUS))


# --- scores and utility ----------------------------------------------------------------------

def _scored(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    labels = table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "label", "truth")
    return docs.join(labels, "doc_id").withColumn("pred", (F.col("score") > 1000).cast("int"))


_auc = """SELECT label, sum(truth * (below + same / 2.0)) / (sum(truth) * 1.0 * sum(1 - truth)) AS {name} FROM (SELECT label, truth,
    coalesce(sum(1 - truth) OVER (PARTITION BY label ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - same AS below, same FROM (
    SELECT *, sum(1 - truth) OVER (PARTITION BY label, score) AS same FROM {source})) GROUP BY label"""
_ap = """SELECT label, sum(pos * tp / (tp + fp)) / any_value(p) AS average_precision FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY label) AS p FROM (SELECT label, score, sum(truth) AS pos, sum(1 - truth) AS neg FROM {source} GROUP BY label, score)
    WINDOW w AS (PARTITION BY label ORDER BY score DESC)) GROUP BY label"""
_micro = "(SELECT * REPLACE ('micro' AS label) FROM doc_long)"


def _with_micro(rows: DataFrame, metric, value: str) -> DataFrame:
    by_label = metric(rows, value, "truth", ["label"])
    return by_label.unionByName(metric(rows, value, "truth").withColumn("label", F.lit("micro")))


@query(
    "label:s auroc:f",
    _auc.format(name="auroc", source="doc_long") + " UNION ALL " + _auc.format(name="auroc", source=_micro),
)
def auroc(spark, d):
    return _with_micro(_scored(spark, d), scores.auroc, "score")


@query("label:s average_precision:f", _ap.format(source="doc_long") + " UNION ALL " + _ap.format(source=_micro))
def average_precision(spark, d):
    return _with_micro(_scored(spark, d), scores.average_precision, "score")


_f1 = """SELECT label, 2.0 * sum(pred * truth) / nullif(sum(pred) + sum(truth), 0) AS f1 FROM {source} GROUP BY label"""


@query("label:s f1:f", _f1.format(source="doc_long") + " UNION ALL " + _f1.format(source=_micro))
def f1(spark, d):
    return _with_micro(_scored(spark, d), scores.f1, "pred")


@query(
    "hamming_loss:f jaccard:f",
    """SELECT (SELECT avg((pred <> truth)::INT) FROM doc_long) AS hamming_loss,
    (SELECT avg(j) FROM (SELECT coalesce(sum(pred * truth) / nullif(sum(greatest(pred, truth)), 0), 0) AS j FROM doc_long GROUP BY doc_id)) AS jaccard""",
)
def hamming_jaccard(spark, d):
    rows = _scored(spark, d)
    loss = scores.hamming_loss(rows, "pred", "truth")
    return loss.withColumn("jaccard", scores.jaccard(rows, "doc_id", "pred", "truth").scalar())


@query("regime:s metric:s value:f")
def utility_regimes(spark, d):
    c, static = _cohorts(spark, d), durable(_static(spark, d))
    tables = {
        n: durable(series.feature_table(f, static, CONTINUOUS, LABELS, c["real"])) for n, f in c.items()
    }
    return utility.utility_pair(tables["real"], tables["test"], tables["synthetic"], FEATURES, LABELS)


@query("real_ratio:f syn_ratio:f metric:s value:f")
def utility_mixes(spark, d):
    """All training mixes, every label, 20 rounds."""
    c, static = _cohorts(spark, d), durable(_static(spark, d))
    tables = {
        n: durable(series.feature_table(f, static, CONTINUOUS, LABELS, c["real"])) for n, f in c.items()
    }
    return utility.utility(tables["real"], tables["test"], tables["synthetic"], FEATURES, LABELS)


# --- privacy -----------------------------------------------------------------------------------

def _sets(spark, d, pairs=None) -> privacy.VectorSets:
    v = proxy.vectors(spark, d)
    return privacy.VectorSets({c: v.where(F.col("cohort") == c) for c in ("real", "synthetic", "test")}, pairs)


@query(
    "cohort:s id:i dist2:f",
    "SELECT ca AS cohort, ia AS id, d2 AS dist2 FROM nn WHERE cb = 'synthetic'",
)
def nearest_vector(spark, d):
    v = proxy.vectors(spark, d)
    sets = {c: v.where(F.col("cohort") == c) for c in ("real", "test", "synthetic")}
    return union_all(
        [
            privacy.nearest_vector(sets[c], sets["synthetic"], exclude_self=c == "synthetic").withColumn("cohort", F.lit(c))
            for c in sets
        ]
    )


_share = "(SELECT share FROM vshare WHERE ca = '{0}' AND cb = '{1}')"
_aa = {
    "aa_train_syn": f"({_share.format('real', 'synthetic')} + {_share.format('synthetic', 'real')}) / 2",
    "aa_test_syn": f"({_share.format('test', 'synthetic')} + {_share.format('synthetic', 'test')}) / 2",
    "aa_train_test": f"({_share.format('real', 'test')} + {_share.format('test', 'real')}) / 2",
}
_aa["nnaa"] = f"{_aa['aa_train_syn']} - {_aa['aa_test_syn']}"


@query(
    "metric:s value:f",
    " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value" for k, v in _aa.items()),
)
def vector_nnaa(spark, d):
    return privacy.vector_nnaa(_sets(spark, d))


@query(
    "metric:s value:f",
    """SELECT ca || '-' || cb AS metric, share - a.n / (a.n + b.n) AS value FROM vshare JOIN vn a ON a.cohort = ca JOIN vn b ON b.cohort = cb""",
)
def vector_nnaa_directional(spark, d):
    return privacy.vector_nnaa_directional(_sets(spark, d))


@query(
    "metric:s value:f",
    """SELECT 'knn_auroc' AS metric, sum((r.d > t.d)::INT + 0.5 * (r.d = t.d)::INT) / count(*) AS value FROM (SELECT d FROM mia_d WHERE ca = 'real') r, (SELECT d FROM mia_d WHERE ca = 'test') t
    UNION ALL SELECT 'wasserstein', avg(abs(p.y - q.y)) FROM (SELECT y, row_number() OVER (ORDER BY y) AS r FROM kde WHERE ca = 'real') p
      JOIN (SELECT y, row_number() OVER (ORDER BY y) AS r FROM kde WHERE ca = 'test') q USING (r)
    UNION ALL SELECT 'jsd', 0.5 * sum(x * ln(x / m)) + 0.5 * sum(z * ln(z / m)) FROM (SELECT p.y / sum(p.y) OVER () AS x, q.y / sum(q.y) OVER () AS z,
      (p.y + q.y) / sum(p.y + q.y) OVER () AS m FROM (SELECT * FROM kde WHERE ca = 'real') p JOIN (SELECT * FROM kde WHERE ca = 'test') q USING (i)) WHERE x > 0 AND z > 0""",
)
def mia(spark, d):
    return privacy.mia_knn(_sets(spark, d, [("real", "synthetic"), ("test", "synthetic")]))


def _prdc_sql(other: str) -> str:
    return f"""SELECT '{other}' AS other, 'precision' AS metric, avg(hit) AS value FROM (SELECT ia, max((sqrt(d2) < r)::INT) AS hit FROM dist JOIN kth ON id = ib WHERE ca = '{other}' AND cb = 'real' GROUP BY ia)
    UNION ALL SELECT '{other}', 'recall', avg(hit) FROM (SELECT ia, max((sqrt(d2) < r)::INT) AS hit FROM dist JOIN kth ON id = ib WHERE ca = 'real' AND cb = '{other}' GROUP BY ia)
    UNION ALL SELECT '{other}', 'density', avg(hit) / 5 FROM (SELECT ia, sum((sqrt(d2) < r)::INT) AS hit FROM dist JOIN kth ON id = ib WHERE ca = '{other}' AND cb = 'real' GROUP BY ia)
    UNION ALL SELECT '{other}', 'coverage', avg((d < r)::INT) FROM nn JOIN kth ON id = ia WHERE ca = 'real' AND cb = '{other}'"""


@query("other:s metric:s value:f", _prdc_sql("test") + " UNION ALL " + _prdc_sql("synthetic"))
def prdc(spark, d):
    sets = _sets(spark, d, [("real", "test"), ("real", "synthetic")])
    return union_all(
        [privacy.prdc(sets, o).withColumn("other", F.lit(o)) for o in ("test", "synthetic")]
    )


@query(
    "metric:s value:f",
    """SELECT 'identifiability' AS metric, avg((s < o)::INT) AS value FROM (SELECT ia, min(d) FILTER (WHERE cb = 'synthetic') AS s, min(d) FILTER (WHERE cb = 'real') AS o FROM (
    SELECT a.id AS ia, b.cohort AS cb, list_sum(list_transform(list_zip(a.v, b.v, w), lambda z: (z[1] * z[3] - z[2] * z[3]) * (z[1] * z[3] - z[2] * z[3]))) AS d
    FROM vec a JOIN vec b ON a.id <> b.id, (SELECT list(CASE WHEN h > 1e-12 THEN 1 / h ELSE 0 END ORDER BY dim) AS w FROM (SELECT dim, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (
      SELECT dim, round(x) AS x, count(*) AS n FROM (SELECT unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM vec WHERE cohort = 'real') GROUP BY ALL) GROUP BY dim))
    WHERE a.cohort = 'real' AND b.cohort <> 'test') GROUP BY ia)""",
)
def identifiability(spark, d):
    v = proxy.vectors(spark, d)
    return privacy.identifiability(v.where(F.col("cohort") == "real"), v.where(F.col("cohort") == "synthetic"))


PART_OF = {"train": "t", "val": "e", "test": "e", "synthetic": "s"}


def record_tables(r: Records) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes, visits and labels of every record with the part its split is in."""
    part = F.when(F.lit(False), F.lit(""))
    for split, name in PART_OF.items():
        part = part.when(F.col("split") == split, name)
    codes = r.stay_codes.select(part.alias("part"), F.col("sid").alias("rid"), F.col("stay_idx").alias("visit_idx"), "code")
    visits = r.stays.select(part.alias("part"), F.col("sid").alias("rid"), F.col("stay_idx").alias("visit_idx"))
    labels = codestats.record_labels(r.stays).groupBy(F.col("seq").alias("rid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("label", "value"))), lambda x: x["value"]).alias("labels")
    )
    split = proxy.subjects(r.spark, r.sf_dir).select(part.alias("part"), F.col("sid").alias("rid"))
    return codes, visits, labels.join(split, "rid")


@query(
    "part:s rid:i dist:i",
    "SELECT pa AS part, ra AS rid, d AS dist FROM rnn WHERE pb = 't'",
)
def nearest_record(spark, d):
    """Nearest training record of every record."""
    sets = records.record_set(*record_tables(Records(spark, d)))
    return records.each_record(sets, records.nearest_records(sets, sets.only("t")))


_rshare = "(SELECT count(*) FROM rnn o JOIN rnn s ON o.ra = s.ra AND s.pb = s.pa WHERE o.pa = '{0}' AND o.pb = '{1}' AND o.d > s.d) / (SELECT count(*) FROM rset WHERE part = 't')"
_rv = {f"{a}_{b}": _rshare.format(a, b) for a, b in (("e", "s"), ("s", "e"), ("t", "s"), ("s", "t"), ("e", "t"), ("t", "e"))}
_rv["aaes"] = f"({_rv['e_s']} + {_rv['s_e']}) / 2"
_rv["aaet"] = f"({_rv['t_s']} + {_rv['s_t']}) / 2"


@query(
    "metric:s value:f",
    " UNION ALL ".join(f"SELECT '{k}' AS metric, {v} AS value" for k, v in _rv.items()),
)
def record_nnaa(spark, d):
    return privacy.record_nnaa(records.record_set(*record_tables(Records(spark, d))))


@query(
    "metric:s value:f",
    " UNION ALL ".join(f"SELECT '{k}' AS metric, {v.replace('rnn', 'rnn_picked').replace('rset', 'rset_picked')} AS value" for k, v in _rv.items()),
)
def record_privacy(spark, d):
    """On 1,000 records of each part, drawn by hash."""
    return privacy.record_privacy(*record_tables(Records(spark, d)))


@query("part:s metric:s value:f")
def evaluate(spark, d):
    c, static = _cohorts(spark, d), durable(_static(spark, d))
    return report.evaluate(
        c["real"], c["test"], c["synthetic"], {n: static for n in c}, CONTINUOUS, LABELS, "ffill"
    )
