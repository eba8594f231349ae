import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import toxicity as T
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables


def corpus(n=600):
    rng = random.Random(12)
    plain = ["tion", "ander", "the", "of", "loren", "dolor", "amet", "sit", "vel", "qui"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(20, 120))]
        toxic = k % 8 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgel", "blatschig", "zorgelich", "mufti"]))
        rows.append((k, " ".join(w + rng.choice(["", "", ",", ".\n"]) for w in words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables():
    return corpus()


def test_held_out_accuracy(spark, tmp_path, tables):
    rows, labels = tables
    extra = [(None, "zorgel mufti zorgel"), (9000, None), (9001, ""), (7, rows[7][1]), (9002, "tion the " * 20000)]
    write_tables(
        spark, tmp_path, documents=doc_rows(spark, rows + extra), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    )
    got = QUERIES["op7_toxicity"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    truth = {k: t for k, _, t in labels}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.97
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[None] == 1 and by_id[9000] == by_id[9001] == by_id[9002] == 0


def test_grammar_scores_clauses_not_words():
    model = T.Model(words={"mufti": 4.0}, stems={"zorg": 3.0}, curve=[0.0, 0.0, 0.0, 0.0, 0.0]).compile()
    assert model.clauses("a mufti. the zorgel; nothing") == [4.0, 3.0]
    assert model.clauses("you are a mufti") == [4.0 * T.FACTORS["target"]]
    assert model.clauses("she is not a mufti") == [4.0 * T.FACTORS["target"] * T.FACTORS["negated"]]
    assert model.clauses("he said: mufti") == [4.0]  # the clause ends at the colon
    assert model.clauses("the paper reported on some big mufti") == [4.0 * T.FACTORS["reported"]]
    assert model.clauses("kill") == [3.0] and model.clauses("amufti muftis") == [] and model.clauses("") == []


def by_hand(model, text):
    """Clause scores by looking around each hit instead of by an automaton."""
    found = []
    for clause in re.split("[.!?;:\n]", text.lower()):
        words = [model.weigh(w) for w in re.findall(r"[\w']+", clause)]
        kinds = [k for k, _ in words]
        total = 0.0
        for at, (kind, weight) in enumerate(words):
            if not weight:
                continue
            if "report" in kinds[:at]:
                weight *= T.FACTORS["reported"]
            if "negation" in kinds[max(0, at - T.REACH["negation"]) : at]:
                weight *= T.FACTORS["negated"]
            if "target" in kinds[max(0, at - T.REACH["target"]) : at]:
                total += weight * T.FACTORS["target"]
                continue
            total += weight
            for after in kinds[at + 1 : at + 1 + T.REACH[kind]]:
                if after in T.HITS:
                    break
                if after == "target":
                    total += weight * T.FOLLOWED[kind]
                    break
        if total:
            found.append(total)
    return found


def test_clauses_equal_brute_force():
    model = T.Model(words={"mufti": 4.0, "blatschig": 2.5}, stems={"zorg": 3.0}).compile()
    rng = random.Random(4)
    words = ["mufti", "blatschig", "zorgelich", "kill", "you", "not", "said", "tion", "ander", "amufti", "they", "burn", "loren"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ", ", ". ", "!?", "\n", ": "]) for _ in range(rng.randrange(40)))
        assert model.clauses(text) == pytest.approx(by_hand(model, text), rel=1e-12), text


def test_insults_and_threats_are_patterns_of_the_composition():
    model = T.Model(words={"mufti": 4.0}).compile()
    assert model.clauses("i will kill you") == [3.0 * (1 + T.FOLLOWED["threat"])]
    assert model.clauses("a mufti are you") == [4.0 * (1 + T.FOLLOWED["insult"])]
    assert model.clauses("a mufti are you all, you") == [4.0 * (1 + T.FOLLOWED["insult"])]  # directed once
    assert model.clauses("you mufti you") == [4.0 * T.FACTORS["target"]]
    assert model.clauses("a mufti tion tion tion tion you") == [4.0]
    assert len(T.grammar().arcs["other"]) > 30


def test_long_clauses_are_read_whole():
    model = T.Model(words={"mufti": 4.0}).compile()
    assert model.clauses("he said" + " tion" * 700 + " mufti") == pytest.approx([4.0 * T.FACTORS["reported"]])
    assert model.clauses("mufti " * 9000) == [36_000.0]
    assert model.clauses("tion " * 100_000 + "mufti. " + "mufti, " * 20_000) == [4.0, 80_000.0]


def test_labels_of_one_kind_or_none(spark, tables):
    docs = doc_rows(spark, tables[0][:20]).withColumn("toxic", F.lit("clash"))
    for labels, value in (([], 0.0), ([(1, 1, 0), (2, 1, None)], 0.0), ([(1, 1, 1), (2, 1, 1), (3, 1, 1)], 1.0)):
        frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = T.fit(docs.drop("toxic"), frame)
        scores = [r["_toxicity"] for r in T.score(docs, model).collect()]
        assert len(scores) == 20 and all(abs(s - value) < 1e-6 for s in scores)
    assert T.score(doc_rows(spark, []), T.Model()).count() == 0
