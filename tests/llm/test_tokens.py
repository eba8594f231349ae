import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqlgauge.llm import bpe, token_files
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables

LETTERS = ["abthe  \n\t'sdreX1²½é ñ\xa0\x85\x1c.,!-ßİÉſʰ", "abthe  \n\t'sdre1²½é ñ\xa0\x85\x1c.,!-ßİ中文😀́ ͏٣", "a b<|endoftext|>"]


def texts(seed):
    rng = random.Random(seed)
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in LETTERS for _ in range(150)]
    extra = ["<|endoftext|>a <|endoftext|> b", "x" * 3000, " " * 500 + "a", "a\n\n\nb  ", "", None, "the cat " * 9000]
    return made + extra


@pytest.fixture(scope="module")
def rows():
    order = random.Random(9).sample(range(5000), 457)
    return [*zip(order, texts(4)), (None, "no id"), (order[0], "again"), (order[0], "again")]


def test_token_files_equal_the_library(spark, tmp_path, rows):
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows).repartition(5))
    made = Tokenizer.from_file(token_files.VOCABULARY)
    expected, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*made.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op8_token_files"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_bpe_equals_the_library(spark, tmp_path, rows):
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows))
    made = Tokenizer.from_file(bpe.VOCABULARY)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = []
    for i, text in rows:
        ids = made.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), sha(",".join(map(str, ids))), sha(made.decode(ids, skip_special_tokens=False))))
    got = QUERIES["op10_bpe"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_decode_is_its_own_operator(spark):
    docs = doc_rows(spark, [(1, "Hello <|endoftext|> wörld"), (2, None)]).withColumnRenamed("lang", "n_tokens")
    got = bpe.decode(bpe.encode(docs)).select("doc_id", "_decoded").collect()
    assert sorted(map(tuple, got)) == [(1, "Hello <|endoftext|> wörld"), (2, "")]
    broken = spark.createDataFrame([([bpe.TrieEncoder(bpe.VOCABULARY).ids[b"\xbf"]],), (None,)], "_ids array<int>")
    assert [r["_decoded"] for r in bpe.decode(broken).collect()] == ["�", ""]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        for high in (1, 2, 300, 49408, 2**32 - 1):
            ids = rng.integers(0, high, n).astype(np.uint32)
            if n > 600:
                ids[rng.integers(0, n, n // 30)] = 2**32 - 1
            payload = token_files.pack(ids)
            assert (token_files.unpack(payload) == ids).all()
            assert (token_files.unpack(payload, 1, 3) == ids[512:1536]).all()


def test_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, documents=doc_rows(spark, []))
    for name in ("op8_token_files", "op10_bpe"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
    docs = doc_rows(spark, [(1, "a")]).withColumn("shard", F.lit(1))
    token_files.write_token_files(docs, str(tmp_path / "t"), end=None)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).first()["start"] == 0


def test_workers_keep_nothing_when_a_task_ends():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["the cat", None, "naïve 中文"]})
    rows = list(bpe._encode_step(bpe.VOCABULARY, "text", True)(iter([batch])))
    encode = Tokenizer.from_file(bpe.VOCABULARY).encode
    assert rows[0].column(1).to_pylist() == [encode(t or "").ids for t in batch.column(0).to_pylist()]
    assert all(held.cache_info().currsize == 0 for held in (bpe._encoder, bpe._splitter, bpe._token_bytes))


def test_memo_of_token_files_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 3)
    made, memo = Tokenizer.from_file(token_files.VOCABULARY), {}
    for text in ("one two three", "four five", "one six", "naïve ŒUVRE 12"):
        assert token_files.encode_texts([text], memo)[0].tolist() == made.encode(text, add_special_tokens=False).ids
        assert len(memo) <= 4


def test_ascii_words_are_cut_by_their_own_pattern():
    latin, rng = token_files.latin_words, random.Random(6)
    made = Tokenizer.from_file(token_files.VOCABULARY)
    for _ in range(500):
        text = "".join(rng.choice("abze09 \n\t\x0b\x0c\r\x00\x1c\x1f\x7f'sdrevmlt.,!-_<|") for _ in range(rng.randint(0, 60)))
        assert latin(text) == latin(text + " é")[: len(latin(text))]
        assert token_files.encode_texts([text], {})[0].tolist() == made.encode(text, add_special_tokens=False).ids
