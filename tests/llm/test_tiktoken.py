"""Byte-level BPE by rank file against the library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from visitframe.llm import tiktok
from visitframe.llm.queries import BYTE_RANKS, QUERIES

PATH, PATTERN = public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    bits = ["a", "B", "The", " ", "  ", "\n", "\t", "\r\n", "1", "42", ".", "'s", "'", "'ll", "é", "Σ", "中", "🙂", "\x1c", "\x85", "\xa0", "　", "½", "<|endoftext|>", "\0"]
    odd = [None, "", " ", "\n\n", "<|endoftext|> x", "aaaa" * 50_000, " " * 50_000, "word " * 30_000, "a1" * 40_000, "漢字" * 20_000]
    return odd + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]


@pytest.mark.parametrize("most", [1, 3, 17, 1 << 16])
def test_parts_have_the_ids_of_the_whole(library, most):
    for text in texts():
        if text and len(text) < 500 or most > 1000:
            cut = list(tiktok.parts(text or "", most))
            assert "".join(cut) == (text or "")
            assert [i for part in cut for i in library.encode_ordinary(part)] == library.encode_ordinary(text or "")
    assert len(list(tiktok.parts("ab cd " * 100, 50))) > 5


def test_rows_keep_their_ids_and_bytes(spark, library):
    rows = [(i, t, "x", b"y") for i, t in enumerate(texts())]
    rows += [(3, "the same id again", "x", b"y"), (7, rows[7][1], "x", b"y"), (None, "no id", "x", b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded binary").repartition(4)
    encoded = tiktok.encode(docs, PATH, PATTERN)
    out = tiktok.decode(encoded, PATH, PATTERN).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out) == want
    assert all(4 * r["n_tokens"] == len(r["ids"]) for r in out)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in tiktok.as_arrays(encoded).collect()) == sorted((i, ids) for i, ids, _ in want)


def test_ids_that_are_no_text(spark, library):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50256) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    packed = [(i, len(ids), np.array(ids, "<u4").tobytes()) for i, ids in rows] + [(900, 0, None), (901, 1, np.array([2**32 - 1], "<u4").tobytes())]
    out = tiktok.decode(spark.createDataFrame(packed, "doc_id long, n_tokens long, ids binary"), PATH, PATTERN).collect()
    by_id = {r["doc_id"]: bytes(r["decoded"]) for r in out}
    assert all(by_id[i] == library.decode_bytes(ids) for i, ids in rows)
    assert by_id[900] == b"" and by_id[901] == b""


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tiktok.decode(tiktok.encode(none, PATH, PATTERN), PATH, PATTERN).count() == 0


def test_query_digest(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op12_tiktoken"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
