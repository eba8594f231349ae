import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import decontamination as D
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables


def expected(documents, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = tokens(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for doc, text in documents:
        w, hit, found = tokens(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if held := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= held
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["the", "of", "é", "b2", "Zu", "qa", "st"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([0, 3, 10, 12, 25]))) for k in range(12)] + [(50, None), (51, "single"), (1, make(11))]
    documents = [(k, make(rng.randint(0, 120))) for k in range(40)]
    documents += [(100 + k, f"x9 {items[k % 12][1]}-, {make(4)}, single!") for k in range(30)]
    documents += [(None, make(30)), (7, documents[7][1]), (200, None), (201, ""), (202, "other " * 40000 + (items[3][1] or ""))]
    write_tables(spark, tmp_path, documents=doc_rows(spark, documents), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = QUERIES["op1_decontaminate"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(documents, items)


def test_blocks_of_the_query_set_give_the_same_result(spark):
    items = spark.createDataFrame([(k, f"a{k} b c d e f g h i j k l m") for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z a7 b c d e f g h i j q a8 b c d e f g h i"), (2, "c d e f g h i j k l"), (3, None)], "doc_id long, text string")
    whole = D.find_contamination(docs, items).select("doc_id", "_words", "_spans", "_items").collect()
    parts = D.find_contamination(docs, items, block_words=100).select("doc_id", "_words", "_spans", "_items").collect()
    assert sorted(whole) == sorted(parts)
    assert [(s["start"], s["end"]) for s in sorted(whole)[0]["_spans"]] == [(1, 11)]


@pytest.mark.parametrize("items", [[(None, "p q r s t u v w x y z")], [(4, "l m n"), (None, "p q r s t u v w x y z"), (None, None), (5, "p q r s t u v w x y")]])
def test_items_without_an_id_are_hits_without_a_name(spark, items):
    docs = spark.createDataFrame([(1, "a p q r s t u v w x y z b"), (2, "p q r"), (3, "k l m n")], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for words in (D.BLOCK_WORDS, 1):
        rows = {r["doc_id"]: r for r in D.find_contamination(docs, asked, block_words=words).collect()}
        assert [(s["start"], s["end"]) for s in rows[1]["_spans"]] == [(1, 12)] and rows[1]["_items"] == [str(i) for i, _ in items[3:]]
        assert rows[2]["_spans"] == [] and rows[3]["_items"] == [str(i) for i, _ in items[:1] if i is not None]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for benchmark in (none, some):
        got = D.find_contamination(docs, benchmark).collect()
        assert [(r["doc_id"], r["_words"], r["_spans"], r["_items"], r["n_words"]) for r in sorted(got)] == [(a, 0, [], [], "clash") for a, _ in rows]


def test_suffix_order_and_ranks():
    import numpy as np

    rng = np.random.default_rng(2)
    code = rng.integers(0, 5, 300).astype(np.int32)
    code[-1] = 0
    index = D.FmIndex(code, 4)
    for symbol in range(1, 5):
        rows = np.arange(301)
        assert list(index.rank(np.full(301, symbol), rows)) == [int((index.last[:r] == symbol).sum()) for r in rows]
    low, high = index.search(np.array([[1, 2], [3, 0]], np.int32), np.array([2, 1]))
    text = code.tolist()
    assert sorted(index.locate(np.arange(low[0], high[0]))) == [k for k in range(299) if text[k : k + 2] == [1, 2]]
    assert high[1] - low[1] == text.count(3)


def test_removed_spans_leave_the_rest(spark):
    docs = spark.createDataFrame([(1, "Hello, One two THREE! bye", "s"), (2, "nothing", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    cut = D.remove_spans(D.find_contamination(docs, items), docs.columns).collect()
    assert sorted(map(tuple, cut)) == [(1, "Hello, \n! bye", "s"), (2, "nothing", "s")]
