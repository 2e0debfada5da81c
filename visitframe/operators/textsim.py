"""Text similarity of aligned or whole corpora."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import block_of, by_size, position_in, prefix_by_value, union_all, with_halo
from visitframe.session import durable


def terms(text: str | Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.filter(
        F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 2
    )


def rouge_words(text: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _weights(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.explode(terms("text")).alias("word")).groupBy("doc", "word").agg(
        F.count("*").alias("_tf")
    )


def tfidf_drift(train: DataFrame, other: DataFrame) -> DataFrame:
    """RMSE between the mean TF-IDF vectors of two corpora (doc, text).

    Smoothed idf learned on ``train``, rows scaled to length 1, every word of
    the train vocabulary counts.
    """
    sizes = [d.agg(F.count("*")).scalar() for d in (train, other)]
    return weight_drift(_weights(train), _weights(other), *sizes)


def weight_drift(tf_train: DataFrame, tf_other: DataFrame, n_train: Column, n_other: Column) -> DataFrame:
    """``tfidf_drift`` of term counts (doc, word, _tf) and the numbers of documents."""
    idf = tf_train.groupBy("word").agg(F.count("*").alias("_df")).select(
        "word", (F.log((1 + n_train) / (1 + F.col("_df"))) + 1).alias("_idf")
    )

    def means(tf: DataFrame, total: Column, name: str) -> DataFrame:
        weighted = tf.join(idf, "word").select(
            "doc", "word", (F.col("_tf") * F.col("_idf")).alias("_w")
        )
        norms = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        return (
            weighted.join(norms, "doc")
            .groupBy("word")
            .agg(F.sum(F.col("_w") / F.col("_norm")).alias("_s"))
            .select("word", (F.col("_s") / total).alias(name))
        )

    a, b = means(tf_train, n_train, "_a"), means(tf_other, n_other, "_b")
    gap = F.col("_a") - F.coalesce("_b", F.lit(0.0))
    return a.join(b, "word", "left").agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("n_words")
    )


def _grams(words: Column, n: int) -> Column:
    starts = F.size(words) - n
    return F.when(
        starts >= 0,
        F.transform(
            F.sequence(F.lit(0), starts),
            lambda i: F.concat_ws(" ", F.slice(words, i + 1, n)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _gram_counts(pairs: DataFrame, orders: list[int]) -> DataFrame:
    """(pair_id, order, gram, pred, ref): both sides counted in one shuffle."""
    sides = F.array(
        *[
            F.struct(F.lit(n).alias("order"), F.lit(side).alias("side"), _grams(F.col(side), n).alias("grams"))
            for n in orders
            for side in ("pred", "ref")
        ]
    )
    rows = pairs.select("pair_id", F.inline(sides)).select(
        "pair_id", "order", "side", F.explode("grams").alias("gram")
    )
    return rows.groupBy("pair_id", "order", "gram").agg(
        F.count_if(F.col("side") == "pred").alias("pred"),
        F.count_if(F.col("side") == "ref").alias("ref"),
    )


def rouge_n(pairs: DataFrame, orders: list[int] | None = None) -> DataFrame:
    """Mean ROUGE-n F over pairs (pair_id, pred, ref: texts)."""
    orders = orders or [1, 2]
    words = pairs.select(
        "pair_id", rouge_words("pred").alias("pred"), rouge_words("ref").alias("ref")
    )
    counts = _gram_counts(words, orders).groupBy("pair_id", "order").agg(
        F.sum(F.least("pred", "ref")).alias("_hit"), F.sum("pred").alias("_p"), F.sum("ref").alias("_r")
    )
    # F = 2PR / (P + R) with P = hit / pred and R = hit / ref.
    score = F.coalesce(ratio(2 * F.col("_hit"), F.col("_p") + F.col("_r")), F.lit(0.0))
    total = pairs.agg(F.count("*")).scalar()
    return counts.groupBy("order").agg(F.sum(score).alias("_s")).select(
        "order", (F.col("_s") / total).alias("f")
    )


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per item of ``a``."""
    where: dict = {}
    for i, item in enumerate(a):
        where[item] = where.get(item, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for item in b:
        hit = row & where.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([_lcs(list(a), list(b)) for a, b in zip(left, right)])


def rouge_l(pairs: DataFrame) -> DataFrame:
    """Mean ROUGE-L F over pairs."""
    words = pairs.select(rouge_words("pred").alias("p"), rouge_words("ref").alias("r"))
    lengths = words.select(
        _lcs_length("p", "r").alias("_hit"), F.size("p").alias("_p"), F.size("r").alias("_r")
    )
    score = F.coalesce(ratio(2 * F.col("_hit"), F.col("_p") + F.col("_r")), F.lit(0.0))
    return lengths.agg(F.avg(score).alias("f"))


def bleu(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """Corpus BLEU with one reference, clipped counts and brevity penalty.

    ``pairs``: pair_id and two word arrays, pred and ref.
    """
    orders = list(range(1, max_order + 1))
    # Integer sums per order: what was matched, and what could have been.
    by_order = _gram_counts(pairs, orders).groupBy("order").agg(
        F.sum(F.least("pred", "ref")).alias("_hit"), F.sum("pred").alias("_all")
    )
    lengths = pairs.agg(F.struct(F.sum(F.size("pred")).alias("c"), F.sum(F.size("ref")).alias("r"))).scalar()
    return _bleu_of(by_order, lengths, max_order)


def _bleu_of(by_order: DataFrame, lengths: Column, max_order: int) -> DataFrame:
    """BLEU from matched and possible n-grams (order, _hit, _all) and the total lengths c and r."""
    precision = F.coalesce(ratio(F.col("_hit"), F.col("_all")), F.lit(0.0))
    found = by_order.agg(
        F.min(precision).alias("_min"),
        F.count("*").alias("_orders"),
        F.sum(F.when(precision > 0, F.log(precision))).alias("_logs"),
    ).withColumn("_len", lengths)
    share = ratio(F.col("_len.c"), F.col("_len.r"))
    penalty = F.when(share > 1, 1.0).otherwise(F.exp(1 - ratio(F.lit(1.0), share)))
    complete = (F.col("_min") > 0) & (F.col("_orders") == max_order)
    return found.select(
        F.when(complete, penalty * F.exp(F.col("_logs") / max_order)).otherwise(0.0).alias("bleu")
    )


# --- token sequences -------------------------------------------------------------

MAX_ORDER = 4


class SequenceTexts:
    """Token tables (seq, pos, token_id) of cohorts compared as texts, the first being the reference.

    The n-th sequence of each cohort by ``seq`` form one row of texts;
    sequences beyond the shortest cohort have no partner and count for TF-IDF
    alone. Tokens are dealt by text, so their n-grams are counted in place and
    only what the metrics need of a text is written; texts too long for a task
    are cut into blocks.
    """

    def __init__(self, cohorts: Mapping[str, DataFrame], pad_id: int | None = None, width: int = 4096):
        self.names = list(cohorts)
        self.base = self.names[0]
        rows, ranks = [], []
        for name, tokens in cohorts.items():
            kept = tokens.select("seq", "pos", "token_id")
            seqs = kept.select("seq").distinct().withColumn("one", F.lit(1).cast("long"))
            ranks.append(prefix_by_value(durable(seqs), [], "seq", {"text": F.col("one")}).select("seq", "text", F.lit(name).alias("cohort")))
            if pad_id is not None:
                kept = kept.where(F.col("token_id") != pad_id).withColumn("_b", block_of("pos"))
                kept = position_in(kept.withColumnRenamed("pos", "_p"), ["seq"], ["_b"], ["_p"]).select("seq", "pos", "token_id")
            rows.append(kept.withColumn("cohort", F.lit(name)))
        self.ranks = durable(union_all(ranks))
        self.sizes = durable(self.ranks.groupBy("cohort").agg(F.count("*").alias("n")))
        self.tokens = durable(union_all(rows).join(self.ranks, ["cohort", "seq"]).select("cohort", "text", "pos", "token_id"))
        self.width = width

    def _runs(self, near: DataFrame, *block: str) -> DataFrame:
        """(cohort, text, block, _g): each token with those after it."""
        w = Window.partitionBy("cohort", "text", *block).orderBy("pos")
        ahead = [F.col("token_id"), *[F.lead("token_id", j).over(w) for j in range(1, MAX_ORDER)]]
        return near.select("*", F.array(*ahead).alias("_g"))

    @property
    def counts(self) -> list[Column]:
        """Occurrences in each cohort: ``n_0``, ``n_1``, ..."""
        return [F.count_if(F.col("cohort") == c).alias(f"n_{i}") for i, c in enumerate(self.names)]

    @cached_property
    def hits(self) -> DataFrame:
        """(text, order, ref, hit_i, all_i): n-grams of a text, and those each cohort shares with the reference."""
        def split(rows: DataFrame) -> DataFrame:
            near = with_halo(rows, "pos", after=MAX_ORDER - 1, width=self.width)
            return self._runs(near, "_block").where("_home").select("cohort", "text", "_g")

        grams = by_size(self.tokens, ["text"], lambda rows: self._runs(rows.repartition("text")).select("cohort", "text", "_g"), split)
        full = F.filter(F.transform(F.sequence(F.lit(1), F.lit(MAX_ORDER)), lambda n: F.slice("_g", F.lit(1), n)), lambda g: ~F.exists(g, lambda t: t.isNull()))
        exploded = grams.select("cohort", "text", F.explode(full).alias("gram"))
        counted = exploded.groupBy("text", "gram").agg(*self.counts).withColumn("order", F.size("gram"))
        sums = [F.sum("n_0").alias("ref")]
        for i in range(1, len(self.names)):
            sums += [F.sum(F.least("n_0", f"n_{i}")).alias(f"hit_{i}"), F.sum(f"n_{i}").alias(f"all_{i}")]
        return durable(counted.groupBy("text", "order").agg(*sums))

    @cached_property
    def words(self) -> DataFrame:
        """(text, token_id, n_i): the tokens of a text."""
        return durable(self.tokens.groupBy("text", "token_id").agg(*self.counts))

    def size(self, name: str) -> Column:
        return F.coalesce(self.sizes.where(F.col("cohort") == name).agg(F.max("n")).scalar(), F.lit(0))

    def partners(self, name: str) -> Column:
        """Number of texts that both the reference and the cohort have."""
        return F.least(self.size(self.base), self.size(name))

    def _hits(self, name: str, keys: Sequence[str]) -> DataFrame:
        i = self.names.index(name)
        paired = self.hits.where(F.col("text") < self.partners(name))
        return paired.groupBy(*keys).agg(F.sum(f"hit_{i}").alias("_hit"), F.sum(f"all_{i}").alias("_all"), F.sum("ref").alias("_ref"))

    def rouge(self, name: str, order: int) -> Column:
        """Mean ROUGE-n F; a pair without such an n-gram counts 0."""
        by_text = self._hits(name, ["text", "order"]).where(F.col("order") == order)
        score = F.coalesce(ratio(2 * F.col("_hit"), F.col("_all") + F.col("_ref")), F.lit(0.0))
        return ratio(by_text.agg(F.coalesce(F.sum(score), F.lit(0.0))).scalar(), self.partners(name))

    def bleu(self, name: str) -> Column:
        by_order = self._hits(name, ["order"])
        lengths = by_order.where("order = 1").select(F.struct(F.col("_all").alias("c"), F.col("_ref").alias("r"))).scalar()
        return _bleu_of(by_order, lengths, MAX_ORDER).scalar()

    def drift(self, name: str) -> Column:
        """RMSE of the mean TF-IDF vectors; tokens written with one digit are no words."""
        def weights(cohort: str) -> DataFrame:
            n = F.col(f"n_{self.names.index(cohort)}")
            word = F.col("token_id").cast("string")
            return self.words.where((n > 0) & (F.length(word) >= 2)).select(
                F.col("text").alias("doc"), word.alias("word"), n.alias("_tf")
            )

        return weight_drift(weights(self.base), weights(name), self.size(self.base), self.size(name)).select("rmse").scalar()

    def rouge_l(self, name: str) -> DataFrame:
        """Mean ROUGE-L F. The two sequences of a pair have to fit a row; their matrix is never held."""
        paired = self.tokens.where(F.col("text") < self.partners(name)).where(F.col("cohort").isin(self.base, name))
        place = F.struct("pos", "token_id")
        sides = paired.groupBy("text").agg(
            *[F.transform(F.array_sort(F.collect_list(F.when(F.col("cohort") == c, place))), lambda x: x["token_id"]).alias(s) for c, s in ((name, "p"), (self.base, "r"))]
        )
        lengths = sides.select(_lcs_length("p", "r").alias("_hit"), F.size("p").alias("_p"), F.size("r").alias("_r"))
        score = F.coalesce(ratio(2 * F.col("_hit"), F.col("_p") + F.col("_r")), F.lit(0.0))
        return lengths.agg(ratio(F.sum(score), self.partners(name)).alias("f"))


def text_report(texts: SequenceTexts) -> DataFrame:
    """(against, metric, value) of every cohort against the first: drift, ROUGE-1, ROUGE-2 and BLEU."""
    spark = texts.tokens.sparkSession
    parts = []
    for name in texts.names[1:]:
        cells = {"tfidf_rmse": texts.drift(name), "rouge1": texts.rouge(name, 1), "rouge2": texts.rouge(name, 2), "bleu": texts.bleu(name)}
        row = spark.range(1).select(*[v.cast("double").alias(m) for m, v in cells.items()])
        parts.append(row.unpivot([], list(cells), "metric", "value").select(F.lit(name).alias("against"), "metric", "value"))
    return union_all(parts)
