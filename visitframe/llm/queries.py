"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm import ann, bpe, convrepair, decontam, langid, licenses, ngramjoin, pii, secretscan, tiktok, tokenfile, urlfilter, variants
from visitframe.llm.common import fresh_path, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return tokenfile.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path)
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(doc_id: str = "doc_id"):
    """Rows that teach nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = langid.fit(docs.where(~held_out()))
    found = langid.predict(docs, ranker)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity", "distance")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; ``class_id`` is the least doc_id of its class."""
    found = ngramjoin.classes(table(spark, sf_dir, "documents"))
    least = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "class").select("doc_id", "class_id", "n_links")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants.runs(table(spark, sf_dir, "documents"))
    words = found.select(variants.misspelt(F.col("doc"), F.col("run")).alias("word"))
    return variants.group(variants.word_counts(words))


def op12_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN
    ids = tiktok.encode(table(spark, sf_dir, "documents"), path, pattern)
    return tiktok.decode(ids, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    edits = convrepair.repair(convrepair.damaged(conversations))
    return convrepair.summary(edits, conversations)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_file, op2_bpe, op3_language_id, op4_secret_scan, op5_url_filter, op6_decontamination,
        op7_nearest, op8_license_scan, op9_ngram_join, op10_pii_surrogates,
        op11_spelling_variants, op12_tiktoken, op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {}
