"""License scan: a trained paragraph classifier, confirmed by templates.

1. Training paragraphs: notices of each family below, whole and cut; as class
   ``unknown`` ordinary sentences with license words, and the paragraphs of a bounded
   sample of the corpus that scan() would look at and no template confirms.
2. Features are the words and word pairs of a paragraph, present or not. A
   multinomial logistic regression with an L1 penalty keeps few of them.
3. ``unknown`` is calibrated: a family needs at least the probability that
   no more than ``FALSE_SHARE`` of held-out sentences and paragraphs of that kind
   reach. Half of each kind is held out and teaches nothing.
4. A prediction counts if most word pairs of one of the family's templates
   stand in the paragraph.

A paragraph is a single line, or the lines up to a blank one (without letter or
digit), since notices are often wrapped. A line that is a hit by itself is taken
out of its run, so it is told once.

Only paragraphs with a content word of a template are classified. That loses
nothing: in each template fewer than CONFIRM of the word pairs are free of
such words, so no other paragraph could be confirmed (checked when the
templates are prepared).

All on the JVM: DataFrame functions and Spark ML.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm.common import let, lowest_hashes, written
from visitframe.llm.decontam import words_of

# Customary notices of each family, and words that carry no content or are
# everyday words of another language.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GPL version 3 or later.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0 Universal.",
        "The person who associated a work with this deed has dedicated the work to the public domain",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("All rights reserved. No part of this publication may be reproduced without prior written permission.",),
}
ORDINARY = (
    "The driver showed a valid license to the officer.",
    "He lost his driving licence in version two of the story.",
    "The film was released under a new title last year.",
    "This work is under review by the editors.",
    "The general public may visit the foundation on Sundays.",
    "A copy of the document was granted to the person who asked.",
    "The hotel is licensed to sell spirits.",
    "Use the source and follow the conditions of the form.",
    "She studied at the MIT and later joined a software company.",
    "The apache helicopter is in its second version.",
    "The permission slip must be signed by a parent.",
    "They published a common code of conduct for the project.",
)
FUNCTION_WORDS = set("mit nc sa a an and any are as at be by for from in into is it its may no not of or our that the this to under use with who whose you your v".split())
UNKNOWN = "unknown"
#: Bound of the sample of the corpus: documents, those of the lowest hash.
SAMPLE_DOCS = 400
FALSE_SHARE = 0.001
CONFIRM = 0.6


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def content_words(templates: dict[str, tuple[str, ...]]) -> list[str]:
    """The templates' words without function words and single digits."""
    found = set()
    for notices in templates.values():
        for notice in notices:
            words = _words(notice)
            own = {w for w in words if w not in FUNCTION_WORDS and not w.isdigit()}
            pairs = set(zip(words, words[1:]))
            if sum(not own & set(p) for p in pairs) >= CONFIRM * len(pairs):
                raise ValueError(f"a template of function words: {notice}")
            found |= own
    return sorted(found)


def has_cue(text: str, words: list[str]) -> Column:
    """Whether one of the words stands in the text."""
    return F.coalesce(F.arrays_overlap(words_of(F.col(text)), F.array(*[F.lit(w) for w in words])), F.lit(False))


def _pairs(words: Column) -> Column:
    both = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.slice(both, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def _rows(spark: SparkSession, rows: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    structs = [F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for a, b in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _features(df: DataFrame, text: str = "paragraph") -> DataFrame:
    return df.withColumn("_terms", let(words_of(F.col(text)), lambda w: F.array_distinct(F.concat(w, _pairs(w)))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _row, n, run, paragraph): the lines of every text, numbered from 0, and the runs
    of several lines up to a blank one, under the number of their first line."""

    def runs(lines: Column, blank: Column) -> Column:
        # Blank marks stand around the lines: line i has mark i + 1.
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        first = F.filter(at, lambda i: ~F.get(blank, i + 1) & F.get(blank, i))
        last = F.filter(at, lambda i: ~F.get(blank, i + 1) & F.get(blank, i + 2))
        ends = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] < x["b"])
        return F.transform(
            ends,
            lambda x: F.struct(x["a"].alias("n"), F.lit(True).alias("run"), F.array_join(F.slice(lines, x["a"] + 1, x["b"] - x["a"] + 1), "\n").alias("paragraph")),
        )

    def units(lines: Column) -> Column:
        single = F.transform(lines, lambda x, i: F.struct(i.alias("n"), F.lit(False).alias("run"), x.alias("paragraph")))
        edge = F.array(F.lit(True))
        blank = F.concat(edge, F.transform(lines, lambda x: ~x.rlike(r"[\p{L}\p{N}]")), edge)
        return F.concat(single, let(blank, lambda b: runs(lines, b)))

    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\R")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), let(lines, units).alias("_units"))
    return rows.select("doc_id", "_row", F.inline("_units"))


def confirmed(df: DataFrame, templates: dict[str, tuple[str, ...]], text: str = "paragraph") -> DataFrame:
    """``_shares``: similarity and template for each template of which CONFIRM of the word pairs stand in the text; empty if none."""
    wanted = {}
    for family, notices in templates.items():
        for k, notice in enumerate(notices):
            words = _words(notice)
            wanted[family, k] = sorted({" ".join(p) for p in zip(words, words[1:])})
    # Few paragraphs hold as many pairs of all templates together as the smallest needs.
    least = min(math.ceil(CONFIRM * len(v)) for v in wanted.values())
    known = F.array(*[F.lit(p) for p in sorted({p for v in wanted.values() for p in v})])

    def shares(own: Column) -> Column:
        each = [
            F.struct(
                (F.size(F.array_intersect(own, F.array(*[F.lit(p) for p in v]))) / F.lit(len(v))).alias("similarity"),
                F.lit(-k).alias("_first"), F.lit(f"{family}/{k}").alias("template"), F.lit(family).alias("family"),
            )
            for (family, k), v in wanted.items()
        ]
        every = F.filter(F.array(*each), lambda x: x["similarity"] >= CONFIRM)
        return F.when(F.size(own) >= least, every).otherwise(F.slice(every, 1, 0))

    own = let(words_of(F.col(text)), lambda w: F.array_intersect(_pairs(w), known))
    return df.withColumn("_shares", let(own, shares))


def candidates(docs: DataFrame, id_col: str, text_col: str, cues: list[str]) -> DataFrame:
    """The paragraphs with a cue word."""
    return paragraphs(docs.where(has_cue(text_col, cues)), id_col, text_col).where(has_cue("paragraph", cues))


@dataclass
class Classifier:
    terms: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    least: float

    def probabilities(self, df: DataFrame, text: str = "paragraph") -> DataFrame:
        """``family`` and ``probability`` of the most probable family, ``unknown`` aside."""
        scored = self.model.transform(self.terms.transform(_features(df, text)))
        p = vector_to_array("probability")
        ranked = F.array_max(F.array(*[F.struct(p[k].alias("p"), F.lit(name).alias("family")) for k, name in enumerate(self.families) if name != UNKNOWN]))
        out = scored.withColumn("_best", ranked)
        return out.select(*df.columns, F.col("_best.family").alias("family"), F.col("_best.p").alias("probability"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, sample: int = SAMPLE_DOCS) -> Classifier:
    """Fit and calibrate. Of the corpus at most ``sample`` documents are looked at."""
    templates = templates or TEMPLATES
    spark = docs.sparkSession
    cues = content_words(templates)
    notices = _rows(spark, [(k, t) for k, v in templates.items() for t in v], ("family", "paragraph"))
    words = F.split("paragraph", " ")
    size = F.size(words)
    cuts = F.array(
        F.col("paragraph"), F.lower("paragraph"), F.upper("paragraph"),
        F.array_join(F.slice(words, F.lit(2), F.greatest(size - 1, F.lit(1))), " "),
        F.array_join(F.slice(words, F.lit(1), F.greatest(size - 1, F.lit(1))), " "),
        F.concat(F.lit("Copyright 2020 the authors. "), F.col("paragraph")),
        F.concat(F.col("paragraph"), F.lit(" See the file for details.")),
    )
    positive = notices.select("family", F.explode(cuts).alias("paragraph"))
    # Every other sentence is held out.
    ordinary = [_rows(spark, [(UNKNOWN, t) for t in half], ("family", "paragraph")) for half in (ORDINARY[::2], ORDINARY[1::2])]
    lowest = docs.select(id_col, text_col, F.xxhash64(id_col, text_col).alias("_h")).where(F.length(text_col) > 0)
    negative = candidates(lowest_hashes(lowest, "_h", sample).drop("_h"), id_col, text_col, cues)
    negative = confirmed(negative, templates).where(F.size("_shares") == 0)
    corpus = written(negative.select(F.lit(UNKNOWN).alias("family"), "paragraph", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("held")), "negatives")
    data = positive.unionByName(ordinary[0]).unionByName(corpus.where(~F.col("held")).drop("held"))
    families = sorted({*templates, UNKNOWN})
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    data = _features(written(data.withColumn("label", label), "training"))
    terms = CountVectorizer(inputCol="_terms", outputCol="features", binary=True, vocabSize=20_000).fit(data.where(F.col("family") != UNKNOWN))
    fit = LogisticRegression(regParam=0.001, elasticNetParam=1.0, maxIter=60, family="multinomial").fit(terms.transform(data))
    out = Classifier(terms, fit, families, 0.5)
    held = out.probabilities(corpus.where("held").drop("held").unionByName(ordinary[1]))
    reached = held.agg(F.percentile("probability", 1 - FALSE_SHARE)).first()[0]
    out.least = max(0.5, float(reached or 0.0))
    return out


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, paragraph, family, probability, template, similarity): license paragraphs.

    One row per paragraph (line or run of lines, by its first line, numbered from 0) whose
    family is predicted and confirmed; other paragraphs give none, nor do NULL and empty texts.
    A run is judged without the lines that are hits themselves. Of equally
    probable families the last in the alphabet is taken, of equally similar templates the
    first. Rows with one id are scanned each on its own. Only confirmed paragraphs are shuffled.
    """
    templates = templates or TEMPLATES
    cues = content_words(templates)

    def told(df: DataFrame) -> DataFrame:
        found = classifier.probabilities(df).where(F.col("probability") >= classifier.least)
        own = F.filter("_shares", lambda x: x["family"] == F.col("family"))
        return found.withColumn("_t", F.array_max(own)).where(F.col("_t").isNotNull())

    # Few are confirmed; only those are classified.
    kept = written(confirmed(candidates(docs, id_col, text_col, cues), templates).where(F.size("_shares") > 0), "confirmed")
    lines = written(told(kept.where(~F.col("run"))), "lines")
    hits = lines.groupBy("_row").agg(F.collect_set("n").alias("_hits"))
    runs = kept.where("run").drop("_shares").join(hits, "_row", "left")
    # A word of no template stands for a line taken out.
    rest = F.transform(F.split("paragraph", "\n"), lambda x, i: F.when(F.array_contains("_hits", i + F.col("n")), "x0x0x").otherwise(x))
    runs = runs.withColumn("paragraph", F.when(F.col("_hits").isNull(), F.col("paragraph")).otherwise(F.array_join(rest, "\n"))).drop("_hits")
    out = lines.unionByName(told(confirmed(runs, templates).where(F.size("_shares") > 0)))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("paragraph"), "family", "probability", "_t.template", "_t.similarity")
