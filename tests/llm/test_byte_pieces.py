import base64
import hashlib
import random

import pytest
import sentencepiece
import tiktoken
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sqlgauge.llm import byte_pieces
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables

COMMON = "ab thé \n\t'sdreX1²½Ⅷ é中文😀́ ͏٣ \x85\xa0\x1c.,!-\x00𝟘𐐀"


def texts(seed):
    rng = random.Random(seed)

    def letter():
        if rng.random() < 0.85:
            return rng.choice(COMMON)
        return chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)]))

    made = ["".join(letter() for _ in range(rng.randint(0, 50))) for _ in range(600)]
    return made + ["<|endoftext|> a", "x" * 5000, " " * 900 + "a", "a\n\n\nb  ", "", None, "the cat " * 9000, "𐐀" * 300]


def library():
    with open(byte_pieces.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=byte_pieces.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(spark, tmp_path):
    rows = [*enumerate(texts(3)), (None, "no id"), (7, "again"), (7, "again")]
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows).repartition(3))
    encode, sha = library().encode_ordinary, lambda data: hashlib.sha256(data).hexdigest()
    expected = []
    for i, text in rows:
        ids = encode(text or "")
        expected.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = QUERIES["op11_byte_pieces"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_the_model_is_what_the_format_says():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301, b" a": 299}
    made = sentencepiece.SentencePieceProcessor(model_proto=byte_pieces.serialise(ranks))
    assert made.get_piece_size() == 260 and made.unk_id() == 259
    assert made.id_to_piece(256) == byte_pieces.spell(b" a") and made.get_score(257) == -300.0
    assert made.encode(byte_pieces.spell(b"xabc")) == [ord("x"), 258]
    every = bytes(range(256))
    assert byte_pieces.unspell(byte_pieces.spell(every)) == every and len(set(byte_pieces.letters())) == 256


def _write_ranks(path, ranks):
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    return str(path)


def test_gaps_in_ranks_and_tokens_that_no_merge_gives(spark, tmp_path):
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 400, b"ab": 500, b"abcd": 600, b"xyz": 700}
    path = _write_ranks(tmp_path / "own.ranks", ranks)
    seen = tiktoken.Encoding("gaps", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rows = ["abcd", "xyz abcd", "abcde", "xyzz", "aabbcc", ""]
    docs = doc_rows(spark, list(enumerate(rows))).withColumn("_ids", F.lit("clash")).withColumn("_decoded", F.lit(1))
    got = byte_pieces.encode(docs, vocabulary=path, pattern=r"\S+|\s+", decoded=True).orderBy("doc_id").collect()
    assert [r["_ids"] for r in got] == [seen.encode_ordinary(t) for t in rows]
    assert [bytes(r["_decoded"]).decode() for r in got] == rows
    assert got[0]["_ids"] == [600] and got[2]["_ids"] != [600, ord("e")]  # the whole pre-token only
    del ranks[b"q"]
    with pytest.raises(ValueError, match="single byte"):
        byte_pieces.load(_write_ranks(tmp_path / "short.ranks", ranks))


def test_decode_is_its_own_operator(spark):
    docs = doc_rows(spark, [(1, "Hello <|endoftext|> wörld"), (2, None)]).withColumnRenamed("lang", "n_tokens")
    got = byte_pieces.decode(byte_pieces.encode(docs)).orderBy("doc_id").collect()
    assert [bytes(r["_decoded"]).decode() for r in got] == ["Hello <|endoftext|> wörld", ""] and got[0]["n_tokens"] == "en"
    assert bytes(byte_pieces.decode(spark.createDataFrame([(None,)], "_ids array<int>")).first()["_decoded"]) == b""
    with pytest.raises(PythonException):
        byte_pieces.decode(spark.createDataFrame([([50256],)], "_ids array<int>")).collect()


def test_memo_is_bounded_and_left_empty(monkeypatch):
    monkeypatch.setattr(byte_pieces, "MEMO", 3)
    coder = byte_pieces.Coder(byte_pieces.load())
    first = coder.encode(["one two three", "four five six seven"])
    assert coder.encode(["one two three"])[0] == first[0] and len(coder.memo) <= 3
    coder.close()
    assert not coder.memo and not coder.token and coder.library is None


def test_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, documents=doc_rows(spark, []))
    assert QUERIES["op11_byte_pieces"](spark, str(tmp_path)).count() == 0
