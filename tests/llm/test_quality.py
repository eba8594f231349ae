import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sqlgauge.llm import quality as Q
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def expected(rows):
    out = []
    for i, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice(["the", "of", "é😀", "a|b", "x#", "\xa0y"]) for _ in range(n))
    rows = [(k, make(rng.randint(0, 60))) for k in range(50)]
    rows += [(100, None), (101, ""), (102, "a b c d e " * 3), (103, "line\n line\nline\n\n\nline\r\x0bz"), (104, " \t\n"), (105, make(20_000))]
    return [*rows, (5, rows[5][1]), (None, make(30))]


def test_base_equals_brute_force(spark, tmp_path):
    rows = corpus()
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows))
    got = QUERIES["op6_quality"](spark, str(tmp_path))
    assert got.columns[:8] == [*BASE, "kept"]
    assert sorted(map(tuple, got.select(*BASE).collect()), key=str) == expected(rows)
    assert all(not r["kept"] for r in got.where("base_failed").collect())


def brute_model(texts, order):
    """Modified Kneser-Ney by the textbook recursion over dictionaries."""
    padded = [b"\n" * (order - 1) + t for t in texts]
    counts = {order: Counter(t[k : k + order] for t in padded for k in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {k: (0, *Q.discounts(Counter(c.values()))) for k, c in counts.items()}

    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        total = sum(c for g, c in counts[k].items() if g[:-1] == gram[:-1])
        if not total:
            return probability(gram[1:])
        cut = lambda c: cuts[k][min(c, 3)]
        weight = sum(cut(c) for g, c in counts[k].items() if g[:-1] == gram[:-1]) / total
        c = counts[k][gram]
        return max(c - cut(c), 0) / total + weight * probability(gram[1:])

    return probability


@pytest.mark.parametrize("limit", [2_000_000, 150])
def test_perplexity_equals_the_textbook(spark, limit):
    rng = random.Random(8)
    docs = [(k, "".join(rng.choice("abé ") for _ in range(rng.randint(1, 40))), "en" if k % 3 else None) for k in range(24)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["_perplexity"] for r in Q.judge(frame, limit=limit).collect()}
    for lang in ("en", None):
        own = [(k, t.encode()) for k, t, x in docs if x == lang]
        p = brute_model([t for _, t in own], Q.ORDER)
        for k, t in own:
            full = b"\n" * (Q.ORDER - 1) + t
            logs = [math.log(p(full[j : j + Q.ORDER])) for j in range(len(t))]
            assert got[k] == pytest.approx(math.exp(-sum(logs) / len(t)), rel=1e-9)


def test_unseen_text_backs_off(spark):
    frame = spark.createDataFrame([(1, "abab baab abba", "x")], "doc_id long, text string, lang string")
    (model,) = Q.models(Q.count_grams(frame))
    p = brute_model([b"abab baab abba"], Q.ORDER)
    key, _ = Q._keys(["abzba b\x00"], ["x"])
    full = b"\n\n\n\nabzba b\x00"
    assert model.log_probability(key) == pytest.approx([math.log(p(full[k : k + 5])) for k in range(8)])


def test_bands_reject_other_writing(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "an", "the", "st"]) for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(120))) for k in range(200)]
    rows.append((900, " ".join("".join(rng.choice("qxzjkvwy#0987") for _ in range(7)) for _ in range(120))))
    kept = {r["doc_id"]: r["_kept"] for r in Q.judge(doc_rows(spark, rows)).collect()}
    assert not kept.pop(900) and sum(kept.values()) >= 198


def test_hash_array_finds_only_what_it_holds():
    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    held = Q.HashArray(keys[:4000], np.arange(4000.0))
    assert list(held.values[held.find(keys[:4000])]) == list(range(4000))
    assert (held.find(keys[4000:]) == -1).all() and len(Q.HashArray(keys[:0], np.zeros(0)).find(keys)) == 5000


def test_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, documents=doc_rows(spark, []))
    assert QUERIES["op6_quality"](spark, str(tmp_path)).count() == 0


def test_learnt_lower_band_rejects_regular_writing(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice(["ti", "on", "er", "an", "the", "st"]) for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(120))) for k in range(400)]
    regular = ["*" * rng.randint(15, 30) for _ in range(5)]
    rows.append((900, " ".join([*(word() for _ in range(120)), *regular])))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows), labels=labels)
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, str(tmp_path)).collect()}
    usual = sorted(r["perplexity"] for k, r in got.items() if k != 900)
    assert got[900]["perplexity"] < usual[0] and not got[900]["base_failed"]
    assert {r["doc_id"]: r["_kept"] for r in Q.judge(doc_rows(spark, rows)).collect()}[900]  # by the fixed band
    assert not got.pop(900)["kept"] and sum(r["kept"] for r in got.values()) >= 385
