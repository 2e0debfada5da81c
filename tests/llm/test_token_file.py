"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from visitframe.llm import bpe, tokenfile

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  a  b \n\n c ", "\n a", "a \n", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "don't I'LL 's's '''",
    "x<|endoftext|> y <|endoftext|><|endoftext|>", "<|startoftext|>hi", " \x1c a\x1db \x02 \x02\x02", "é́ ü ﷺ 漢字 \xa0 x\x85y",
    "ΣΑΣ İstanbul ſ ＡＢＣ", "0123 456789 ½", "word " * 30_000,
]


def texts():
    rng = random.Random(3)
    parts = ["a", "b", "The", " ", "  ", "\n", "\t", "1", ".", "'s", "é", "Σ", "中", "🙂", "he", "ll", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1.5) for i, t in enumerate(texts())]
    rows += [(3, "again the same id", "x", 1.0), (7, texts()[7], "x", 1.0), (None, "no id", "x", 1.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, _text double").repartition(5)


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_token_file_holds_every_document_in_order(spark, docs, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    tokenfile.write_tokens(docs, path, WORD, segment_tokens=500)
    got = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    assert [g["doc_id"] for g in got] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))
    t, start = library(WORD), 0
    left = [(r["doc_id"], r["text"]) for r in rows]
    for g in got:
        assert g["start"] == start
        ids = np.frombuffer(g["ids"], dtype="<u4").tolist()
        start += len(ids)
        own = next(x for x in left if x[0] == g["doc_id"] and t.encode(x[1] or "", add_special_tokens=False).ids + [2] == ids)
        left.remove(own)
        assert g["n_tokens"] == len(ids)
    assert not left


def test_words_through_pieces_have_the_tokenizers_ids():
    rng = random.Random(11)
    bits = [chr(c) for c in range(1, 0x250) if not chr(c).isspace()] + ["'s", "'LL", "<|endoftext|>", "Σ", "é", "İ", "the", "ING", "12"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(6000)] + bits
    encoder = tokenfile.WordEncoder(WORD)
    encoder.words.most = encoder.pieces.most = 500  # generations turn
    whole = library(WORD)
    for begin in range(0, len(words), 300):
        part = words[begin : begin + 300] + words[:50]
        for word, ids in zip(part, encoder.encode(part, None)):
            assert ids.tolist() == whole.encode(word, add_special_tokens=False).ids, repr(word)


def test_random_access(spark, docs, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    unique = docs.where("doc_id > 20")
    tokenfile.write_tokens(unique, path, WORD, segment_tokens=300)
    want = {(r["doc_id"], k): v for r in unique.collect() for k, v in enumerate(library(WORD).encode(r["text"] or "", add_special_tokens=False).ids + [2])}
    asked = [*random.Random(2).sample(sorted(want), 60), (25, -1), (25, 10**6), (9999, 0)]
    got = tokenfile.tokens_at(spark, path, spark.createDataFrame(asked, "doc_id long, k long")).collect()
    assert {(r["doc_id"], r["k"]): r["token_id"] for r in got} == {a: want[a] for a in asked if a in want}


def test_levels_give_any_number_back():
    rng = np.random.default_rng(0)
    for ids in (np.array([], dtype=np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], dtype=np.uint32), (2 ** rng.uniform(0, 32, 5000)).astype(np.uint32)):
        levels = tokenfile.dac_encode(ids)
        assert (tokenfile.dac_decode(levels) == ids).all()
        assert [tokenfile.dac_access(levels, i) for i in range(len(ids))] == ids.tolist()


def test_bpe_is_the_librarys(spark, docs):
    out = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    t = library(BYTE)
    want = sorted((str(r["doc_id"]), t.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in out) == want
    assert all(r["decoded"] == t.decode(r["ids"], skip_special_tokens=False) for r in out)


def test_decode_of_any_ids(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    out = bpe.decode(spark.createDataFrame(rows + [(900, None), (901, [5, None, 6])], "doc_id long, ids array<int>"), BYTE).collect()
    t = library(BYTE)
    by_id = {r["doc_id"]: r["decoded"] for r in out}
    assert all(by_id[i] == t.decode(ids, skip_special_tokens=False) for i, ids in rows)
    assert by_id[900] == "" and by_id[901] == t.decode([5, 6])


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    tokenfile.write_tokens(none, path, WORD)
    assert tokenfile.read_tokens(spark, path).count() == 0
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0


def test_queries_digest(spark):
    from visitframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    word, byte = library(WORD), library(BYTE)
    got = {r["doc_id"]: r for r in QUERIES["op1_token_file"](spark, folder).collect()}
    two = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, folder).collect()}
    start = 0
    for d in docs:
        ids = word.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
        ids = byte.encode(d["text"] or "", add_special_tokens=False).ids
        r = two[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
