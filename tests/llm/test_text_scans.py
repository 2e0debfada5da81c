"""License paragraphs, PII surrogates and the pipeline."""

import re
import textwrap

import pytest
from pyspark.sql import functions as F

from visitframe.llm import licenses, pii
from visitframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return licenses.train(docs)


def test_licenses_are_told_and_look_alikes_are_not(spark, trained):
    rows = [
        "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\ny", "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.", "LICENSED UNDER CC BY 4.0!", "Some prose here. Released under the BSD License. And more prose then.",
        "Her driving license was released to the public.", "The MIT opened a foundation.", "It was licensed.", None, "", "\n\n", "word " * 50_000 + "\nReleased under the MIT License.",
        "This work is licensed under the GNU General Public License, version 2.",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)) + [(0, rows[0])], "doc_id long, text string").withColumn("family", F.lit(1)).withColumn("n", F.lit(2))
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(docs, trained).collect())
    assert got == sorted([(0, 0, "MIT"), (0, 0, "MIT"), (1, 1, "Apache-2.0"), (2, 0, "GPL-3.0"), (3, 0, "CC-BY-NC-4.0"), (4, 0, "CC-BY-4.0"), (5, 0, "BSD"), (12, 1, "MIT"), (13, 0, "GPL-2.0")])
    assert licenses.scan(docs.limit(0), trained).count() == 0
    assert 0.5 <= trained.least < 1


def test_every_template_is_its_own_family(spark, trained):
    rows = [(k, t) for k, v in licenses.TEMPLATES.items() for t in v]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["family"] for r in licenses.scan(docs, trained).collect()}
    right = sum(got.get(i) == k for i, (k, _) in enumerate(rows))
    assert right >= len(rows) - 2


GPL = (
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    "1. Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer."
)
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."


def test_wrapped_notices(spark, trained):
    want = [(k, "\n".join(textwrap.wrap(t, 30))) for k, v in licenses.TEMPLATES.items() for t in v] + [("GPL-3.0", GPL), ("BSD", BSD), ("ISC", ISC)]
    rows = [f"Some prose.\n\n# {t.replace(chr(10), chr(10) + '# ')}\n#\nOther prose.\nAnd more." for _, t in want]
    rows.append(f"{GPL}\n\n{BSD}\nReleased under the MIT License.\n \n{ISC}")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(docs, trained).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph"], r["family"]))
    wrong = {i: (k, got.get(i)) for i, (k, _) in enumerate(want) if [f for _, f in got.get(i, [])] != [k]}
    assert not [i for i in wrong if i >= len(want) - 3], wrong
    assert len(wrong) <= 2, wrong
    assert sorted(got[len(want)]) == [(0, "GPL-3.0"), (5, "BSD"), (10, "MIT"), (12, "ISC")]


def test_unknown_is_calibrated_on_what_is_scanned(spark):
    """Corpus lines with cue words raise the least probability; before, they were left out."""
    lines = [f"It is licensed and released under the version {i} of a public permission." for i in range(40)]
    docs = spark.createDataFrame([(i, t + "\nword") for i, t in enumerate(lines)], "doc_id long, text string")
    cues = licenses.content_words(licenses.TEMPLATES)
    seen = licenses.candidates(docs, "doc_id", "text", cues)
    assert seen.count() == 80 and licenses.confirmed(seen, licenses.TEMPLATES).where(F.size("_shares") > 0).count() == 0
    model = licenses.train(docs)
    assert model.probabilities(seen).where(F.col("probability") >= model.least).count() <= 1


def test_license_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"] for r in QUERIES["op8_license_scan"](spark, folder).collect()}
    assert got == {d for d, t in texts.items() if re.search("licen[sc]e", t or "", re.I)}


PEOPLE = [
    "Mail ann.lee+1@mail3.example.com or ANN.LEE+1@MAIL3.EXAMPLE.COM now", "call +1 (988) 555-2485 or 1.988.555.2485, not 12345", "from 42.144.35.254, v1.2.3.4.5 and 999.1.1.1",
    "card 4041 8949 7460 8795 and 4041894974608795, not 4041894974608796", "Mr. John Smith met Mrs Mary Smith and Dr. Who", "Herr Müller, Господин Иванов и Госпожа Иванова",
    "nothing here", None, "", "\x01 a@b.co \x01", "a@b.co " * 5000,
]


def test_surrogates(spark):
    docs = spark.createDataFrame(list(enumerate(PEOPLE)) + [(0, PEOPLE[0]), (None, PEOPLE[2])], "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("normal", F.lit("x"))
    out = pii.replace(docs).collect()
    assert len(out) == len(PEOPLE) + 2
    new = {r["doc_id"]: r for r in out}
    a, b = re.findall(r"\S+@\S+", new[0]["text"])
    assert b == a.upper() and "lee" not in a and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+\d@m[0-9a-f]{4}\.example\.org", a)
    assert re.fullmatch(r"call \+1 \((\d{3})\) 555-(\d{4}) or 1\.\1\.555\.\2, not 12345", new[1]["text"])
    assert re.fullmatch(r"from 10\.\d+\.\d+\.\d+, v1\.2\.3\.4\.5 and 999\.1\.1\.1", new[2]["text"]) and new[None]["text"] == new[2]["text"]
    spaced, plain, kept = re.fullmatch(r"card (.{19}) and (\d{16}), not (\d{16})", new[3]["text"]).groups()
    assert spaced.replace(" ", "") == plain != "4041894974608795" and kept == "4041894974608796" and plain[0] == "4"
    digits = [int(c) for c in plain][::-1]
    assert sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) == (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) // 10 * 10
    he, she, third = re.fullmatch(r"Mr\. (\S+ \S+) met Mrs (\S+ \S+) and Dr\. (\S+)", new[4]["text"]).groups()
    assert he.split()[0] in pii.GIVEN["m", "latin"] and she.split()[0] in pii.GIVEN["f", "latin"] and third != "Who"
    assert re.fullmatch(r"Herr \w+-\w+, Господин [А-яё-]+ и Госпожа [А-яё-]+а", new[5]["text"])
    assert new[6]["text"] == PEOPLE[6] and new[7]["text"] is None and new[8]["text"] == ""
    assert "a@b.co" not in new[9]["text"] and new[10]["n_email"] == 5000 and len(set(new[10]["text"].split())) == 1
    assert (new[0]["n_email"], new[1]["n_phone"], new[3]["n_card"], new[4]["n_name"]) == (2, 2, 2, 3)
    assert pii.replace(docs.limit(0)).count() == 0
    other = {r["doc_id"]: r["text"] for r in pii.replace(docs, key="another").collect()}
    assert other[0] != new[0]["text"] and other[6] == PEOPLE[6]


def replaced(spark, *texts):
    rows = pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r for _, r in sorted((r["doc_id"], r) for r in rows)]


def test_one_person_has_one_surrogate(spark):
    texts = [
        "Mr. John Smith met us. John Smith said hello. Dr. Smith left. Mr. Smith too, and Smith's dog; Smithson stayed.",
        "Dr. John Smith wrote this.", "Mrs. Jane Doe and Mr. Jack Doe: Mrs. Doe called Mr. Doe.", "John Smith is a stranger here.",
    ]
    a, b, c, d = (r["text"] for r in replaced(spark, *texts))
    first, last = re.match(r"Mr\. (\S+) (\S+) met us\. ", a).groups()
    assert a == f"Mr. {first} {last} met us. {first} {last} said hello. Dr. {last} left. Mr. {last} too, and {last}'s dog; Smithson stayed."
    assert b == f"Dr. {first} {last} wrote this." and first in pii.GIVEN["m", "latin"] and d == texts[3]
    jane, jack, her, his = re.fullmatch(r"Mrs\. \S+ (\S+) and Mr\. \S+ (\S+): Mrs\. (\S+) called Mr\. (\S+)\.", c).groups()
    assert jane == her and jack == his and jane != jack


def test_forms_of_numbers(spark):
    numbers = ["+49 30 1234567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+14155552671", "+1 415 555 2671", "(415) 555-2671", "3782 822463 10005", "2221 0000 0000 0009"]
    rows = replaced(spark, *[f"see {n} now" for n in numbers], "+49 30 1234567 or +49-30-1234567", "at +12 3, 3782 822463 10006")
    new = [re.fullmatch("see (.*) now", r["text"])[1] for r in rows[:8]]
    for old, now in zip(numbers, new):
        assert now != old and re.sub("[0-9]", "0", now) == re.sub("[0-9]", "0", old)
    assert [n[:3] for n in new[:3]] == ["+49", "+44", "+33"]
    digits = [re.sub("[^0-9]", "", n)[-10:] for n in new[3:6]]
    assert len(set(digits)) == 1 and [r["n_phone"] for r in rows[:8]] == [1] * 6 + [0] * 2 and rows[6]["n_card"] == rows[7]["n_card"] == 1
    one, two = rows[8]["text"].split(" or ")
    assert re.sub("[^0-9]", "", one) == re.sub("[^0-9]", "", two)
    assert rows[9]["text"] == "at +12 3, 3782 822463 10006"


def test_all_else_is_kept(spark):
    text = "\x01a\x03b\x03\x04\x03\x05c a@b.co \x01\x02"
    now = replaced(spark, text)[0]["text"]
    assert re.fullmatch("\x01a\x03b\x03\x04\x03\x05c [a-z]@m[0-9a-f]{4}\\.example\\.org \x01\x02", now)


def test_surrogates_stay_distinct(spark):
    """Cards of 13 digits and short addresses have few surrogates: clashes are drawn again."""
    rows = [("email", f"{a}@x.co") for a in "abcdefghij"] + [("ipv4", f"10.0.{i}.{j}") for i in range(40) for j in range(50)] + [("phone", f"{200 + i}5550{j:03d}") for i in range(100) for j in range(40)]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, normal string")).collect()
    assert len(out) == len(rows)
    assert len({(r["kind"], r["surrogate"]) for r in out}) == len(rows)
    assert not {(r["kind"], r["surrogate"]) for r in out} & set(rows)


def test_name_surrogates_do_not_run_out(spark):
    """576 one-word names of one gender and script come first; more names than that need further parts."""
    letters = "abcdefghij"
    rows = [("name", f"{g}:{script}:{a}{b}{c}{d}") for g, script, most in (("m", "latin", 5), ("f", "cyrillic", 1)) for a in letters[:most] for b in letters for c in letters for d in letters]
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, normal string")).collect()
    assert len(out) == len(rows) == len({r["surrogate"] for r in out})
    for r in out:
        gender, script, name = r["surrogate"].split(":")
        assert [gender, script] == r["normal"].split(":")[:2]
        assert re.fullmatch("[a-z-]+" if script == "latin" else "[а-яё-]+а", name)


def test_pii_query_on_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ip = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])"
    for r in QUERIES["op10_pii_surrogates"](spark, folder).collect():
        old = texts.pop(r["doc_id"])
        for pattern in (r"[\w.]+@\w+\.example\.com", ip, r"\(\d{3}\) 555-\d{4}"):
            assert not set(re.findall(pattern, old)) & set(re.findall(pattern, r["text"]))
        if not re.search("[0-9@]", old):
            assert r["text"] == old
    assert not texts


def test_pipeline_stages(spark):
    import corpus_pipeline
    from visitframe.llm.common import written

    folder = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{folder}/documents.parquet")
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    extra = [
        (10**6, None, "en", "s", None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 !!", None, "s", 6), (10**6 + 3, "the " + item, "en", "s", 9),
        (10**6 + 4, "this text is here twice and it is the same text", "en", "s", 1), (10**6 + 5, "this text is here twice and it is the same text", "en", "s", 1),
        (None, "a text with token=abcdefghijkl0 in it", None, None, 3),
    ]
    docs = base.unionByName(spark.createDataFrame(extra, base.schema))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder))
        steps[name] = (before, docs)
        if name != "encoding":
            assert docs.columns == base.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(steps["language_id"][0]) - ids(steps["language_id"][1]) == {10**6, 10**6 + 1, 10**6 + 2}
    assert 10**6 + 5 not in ids(steps["near_duplicates"][1]) and 10**6 + 4 in ids(steps["near_duplicates"][1])
    assert 10**6 + 3 in ids(steps["near_duplicates"][1]) and 10**6 + 3 not in ids(steps["decontamination"][1])
    told = steps["secrets"][1].where("doc_id is null").first()
    assert told["text"] == "a text with [SECRET] in it" and told["n_chars"] == len(told["text"]) and told["lang"] == "en"
    assert ids(steps["secrets"][1]) == ids(steps["decontamination"][1]) == ids(steps["encoding"][1])
    assert steps["encoding"][1].where("not same").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.limit(0), folder).count() == 0
