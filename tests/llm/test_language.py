"""Language identification: held-out accuracy, a plain version, odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from visitframe.llm import langid
from visitframe.llm.queries import QUERIES


def plain_grams(text):
    words, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        out.update(w)
        padded = f"_{w}_"
        for n in (2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


@pytest.mark.parametrize("text", ["a", "ab cd", "Über 12 straße!x", " é é  ", "x1y2z", "abc" * 50 + " İ"])
def test_grams_are_the_plain_ones(text):
    got = Counter()
    for code in langid.grams(text).tolist():
        chars = []
        while code:
            chars.append(code & (1 << langid.BITS) - 1)
            code >>= langid.BITS
        got["".join("_" if c == 1 else chr(c) for c in reversed(chars))] += 1
    assert got == plain_grams(text)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_language_id"](spark, folder).join(docs, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert right[1] > 200 and right[0] > 0.97


def test_odd_rows(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog " * 3, "en"), ("el gato y el perro " * 3, "es"), (None, "en"), ("", "es"), ("12 !", "en"), ("un perro", None)])]
    docs = spark.createDataFrame(rows + rows[:1] + [(None, "the dog", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    ranker = langid.fit(docs)
    assert ranker.langs == ["en", "es"]
    got = langid.predict(docs, ranker).collect()
    assert len(got) == 8
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by_id[2] == by_id[3] == by_id[4] == ("und", 0.0)
    assert by_id[5][0] == "es" and by_id[None][0] == "en" and 0 < by_id[5][1] <= 1
    none = docs.limit(0)
    assert langid.fit(none) is None
    assert langid.predict(docs, None).where("lang_pred != 'und'").count() == 0
    assert langid.predict(none, ranker).count() == 0


def test_pipeline_rejects_unlearned_languages_and_gibberish(spark):
    import corpus_pipeline

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.", "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền.",
        "xkqz vwpj ghtr bnmz qwrt plkj zxcv mnbv jhgf trwq ppqz kkxw vvbn", "SGVsbG8gd29ybGQhIFRoaXMgaXMgYSB0ZXN0IG9mIGJhc2U2NCBlbmNvZGluZyBmb3IgdGhlIGZpbHRlcg",
    ]
    clean = [
        "The weather was fine and they walked to the river before dinner.", "Das Wetter war schön und sie gingen vor dem Essen an den Fluss.",
        "Le temps était beau et ils sont allés à la rivière avant le dîner.", "El tiempo era bueno y caminaron hasta el río antes de la cena.",
    ]
    extra = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(foreign + clean)]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id", "lang").collect()}
    assert [kept.get(10**6 + i) for i in range(len(extra))] == [None] * len(foreign) + ["en", "de", "fr", "es"]
    lost = {r["doc_id"] for r in base.where("lang is not null").collect()} - set(kept)
    assert not lost
