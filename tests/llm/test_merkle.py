import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import merkle
from sqlgauge.llm.queries import QUERIES

from .helpers import DOCUMENTS, write_tables


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)]
    return sha(*values)


def proof_and_fold(nodes, at, start):
    """Siblings of one leaf and what ``start`` in its place folds to, by walking the whole tree."""
    siblings, held = [], start
    while len(nodes) > 1:
        run = [at - at % 2 + k for k in range(2) if at - at % 2 + k < len(nodes)]
        siblings += [nodes[k] for k in run if k != at]
        held = sha(*(held if k == at else nodes[k] for k in run))
        nodes, at = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], at // 2
    return siblings, held


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for key in keys:
        trees[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    leaves = {key: [leaf_of(*r) for r in trees[key]] for key in keys}
    subroots = [proof_and_fold(leaves[key], 0, leaves[key][0])[1] for key in keys]
    top = proof_and_fold(subroots, 0, subroots[0])[1] if keys else None
    out = []
    for number, key in enumerate(keys):
        for at, row in enumerate(trees[key]):
            i, text, lang, source, n = row
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
            shown = leaf_of(i, text, lang, source, n + 1) if hit and n is not None else leaves[key][at]
            low, sub = proof_and_fold(leaves[key], at, shown)
            high, folded = proof_and_fold(subroots, number, sub)
            out.append((i, leaves[key][at], subroots[number], top, sha(*low, *high), folded, folded == top))
    return out


def odd_rows(seed):
    rng = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "é", "𐐀", "ﬁ", "zz"]
    rows = [
        (rng.choice([None, rng.randrange(400)]), rng.choice([None, "", "a:b", "x" * rng.randrange(9), "ü𐐀"]), rng.choice(langs),
         rng.choice([None, "s", "-"]), rng.choice([None, 0, -5, rng.randrange(10**12)]))
        for _ in range(250)
    ]
    return rows + rows[:20] + [(3, "many", "en", "s", 4)] * 100


@pytest.mark.parametrize("rows", [odd_rows(1), odd_rows(2)[:1], [(k, "t", "en", "s", 1) for k in range(33)]], ids=["odd", "one", "one tree"])
def test_query_equals_brute_force(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("_tree", F.lit("clash")).withColumn("_leaf", F.lit(0))
    write_tables(spark, tmp_path, documents=docs.repartition(4))
    got = QUERIES["op12_merkle"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def built(spark, rows, height):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    fields = map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))
    return merkle.build(docs.withColumn("_leaf", merkle.row_digest(*fields)).withColumn("_place", F.lit(1)), height=height)


@pytest.mark.parametrize("height", [1, 3])
def test_many_levels_of_blocks(spark, height):
    """Low blocks: a tree takes several steps, runs of equal rows cross borders, the top tree too has levels."""
    rows = odd_rows(5)
    made = built(spark, rows, height)
    expected = sorted((r[0], r[1], r[2], r[4]) for r in ((str(b[0]), *b[1:]) for b in brute(rows)))
    proved = merkle.prove(made)
    got = merkle.fold(proved, "_leaf").select("doc_id", "_leaf", "_subroot", "_proof", "_root", "_folded", "text").collect()
    assert sorted((str(r[0]), r[1], r[2], sha(*r[3])) for r in got) == expected
    assert {r["_root"] for r in got} == {r["_folded"] for r in got} == {merkle.root(made)}
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)


def test_proofs_of_some_leaves_fetch_what_they_lack(spark):
    made = built(spark, [(k, f"t{k}", "en" if k % 3 else "de", "s", k) for k in range(90)], 2)
    every = {r["doc_id"]: r["_proof"] for r in merkle.prove(made).collect()}
    some = merkle.prove(made, made.leaves.where("doc_id IN (0, 1, 7, 50, 89)")).collect()
    assert len(some) == 5 and all(r["_proof"] == every[r["doc_id"]] for r in some)
    assert all(merkle.folded(sha("other"), r["_place"], r["_size"], r["_tree"], r["_trees"], r["_proof"]) != r["_root"] for r in some)


def test_missing_is_least():
    """No node fetched can be derived from the leaves held and the others fetched."""
    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(1, 40)
        known = sorted(rng.sample(range(size), rng.randint(1, size)))
        asked = [set(map(int, level)) for level in merkle.missing(np.array(known), size)]
        held, width = set(known), size
        for level in asked:
            assert not level & held and all((at ^ 1) in held for at in level)
            assert all((at ^ 1) in held | level for at in held if at ^ 1 < width)
            held, width = {at >> 1 for at in held}, -(-width // 2)
    assert all(not len(level) for level in merkle.missing(np.arange(13), 13))


def test_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, documents=spark.createDataFrame([], DOCUMENTS))
    assert QUERIES["op12_merkle"](spark, str(tmp_path)).count() == 0
    assert merkle.root(built(spark, [], 4)) is None
