"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm import bpe, decontam, langid, ngramjoin, secretscan
from visitframe.llm.common import table, written
from visitframe.llm.queries import BYTE_BPE, held_out

#: Of the labelled texts that taught nothing and are told rightly, so small a share may score lower
#: than the quantile; the margin leaves room for short and odd texts.
LOW_SHARE, MARGIN = 0.01, 0.65
#: The least score if no labelled text is held out.
MIN_SCORE = 0.1


def least_score(docs: DataFrame, ranker: langid.Ranker) -> float:
    """A text with a lower score is in no learned language: MARGIN times the LOW_SHARE
    quantile of the held-out labelled texts' scores. One number comes to the driver."""
    held = docs.where(held_out() & F.col("lang").isNotNull()).select("lang", "text")
    right = langid.predict(held, ranker, keep=("lang",)).where(F.col("lang") == F.col("lang_pred"))
    low = right.agg(F.percentile_approx("score", LOW_SHARE, 10_000)).first()[0]
    return MIN_SCORE if low is None else max(MIN_SCORE, MARGIN * low)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and texts unlike every learned language, go.

    A document without a label gets the predicted one. If no document has a
    label, nothing can be learned and nothing is rejected but texts without a letter.
    """
    ranker = langid.fit(docs.where(~held_out()))
    if ranker is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs, ranker, keep=tuple(docs.columns))
    known = found.where((F.col("lang_pred") != langid.NO_LETTER) & (F.col("score") >= least_score(docs, ranker)))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least id stays."""
    return ngramjoin.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out; no document goes. ``n_chars`` follows the text."""
    spans = secretscan.find_secrets(F.col("text"))
    return docs.withColumn("text", secretscan.redacted(F.col("text"), spans)).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text; ``same`` tells that decoding them gave the text again."""
    path = public_tokenizers.path(BYTE_BPE)
    encoded = docs.select(F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5")).alias("doc"), "text")
    out = bpe.decode(bpe.encode(encoded, path, id_col="doc"), path, id_col="doc")
    return out.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.md5("decoded") == F.col("doc.md5")).alias("same"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: Ranks of n-grams, near-copy classes and BPE merges are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
