import random
import re

import numpy as np
import pytest

from sqlgauge.llm import ngram_join as N
from sqlgauge.llm.components import components
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables


def shingles(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    width = min(5, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else frozenset()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(v for v in (least.get(x), i) if v is not None) if (least.get(x), i) != (None, None) else None
    return sorted(
        ((i, least[x], sum(s == t for t in sets) if s else 1, n) for (i, _), x, s, n in zip(rows, label, sets, links)), key=str
    )


def corpus(seed, groups=14, extra=()):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 9, 60, 150, 400]))]
        for _ in range(rng.randint(1, 7)):
            other = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 40])):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other) + rng.choice(["", ".", " !"]))
    texts += [None, "", "...", "one", "One", "two words", "é " * 12, "x y " * 30000, *extra]
    ids = rng.sample(range(10_000), len(texts))
    return [*zip(ids, texts), (None, texts[4])]


def pairs_near_the_border(rows):
    sets = [shingles(t) for _, t in rows]
    return sum(0.7 < len(a & b) / len(a | b) < 0.8 for k, a in enumerate(sets) for b in sets[:k] if a and b)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    assert pairs_near_the_border(rows)
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows))
    got = QUERIES["op4_ngram_join"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "class_id", "n_copies", "n_links"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_large_groups_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 7)
    base = [f"w{k}" for k in range(90)]
    many = [" ".join([*base[: 3 * k % 80], f"edit{k}", *base[3 * k % 80 :]]) for k in range(60)]
    rows = corpus(3, 5, many)
    got = N.near_duplicates(doc_rows(spark, rows)).drop("_row", "_first")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_a_chain_of_groups_takes_work_in_proportion(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_NODES", 5)
    work = []
    for length in (60, 180):
        words = [f"w{k}" for k in range(60)]
        rows = []
        for k in range(length):  # each is near the next ones only
            rows.append((k, " ".join(words)))
            words = [*words[3:], *(f"c{k}x{j}" for j in range(3))]
        docs, seen = doc_rows(spark, rows), []
        plain = N.materialize
        monkeypatch.setattr(N, "materialize", lambda df, label: seen.append((label, made := plain(df, label))) or made)
        got = N.near_duplicates(docs).drop("_row", "_first")
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
        monkeypatch.setattr(N, "materialize", plain)
        assert any(label == "large-groups" for label, _ in seen)
        work.append(dict(seen)["members"].selectExpr("sum(size(meets))").first()[0])
    assert work[1] < 4.5 * work[0]  # 9 times if all blocks met


def test_shared_shingles_by_products_and_by_lists(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, k, 40).astype(np.uint64)) for k in (50, 60, 5000, 90) * 12] + [np.zeros(0, np.uint64)]
    ids, side, copies = np.arange(len(sets)), np.arange(len(sets)) % 2, np.ones(len(sets), np.int64)
    brute = [
        sum(len(np.intersect1d(a, b)) >= 0.3 * len(np.union1d(a, b)) and len(np.intersect1d(a, b)) > 0 for j, b in enumerate(sets) if j != i)
        for i, a in enumerate(sets)
    ]
    for gain, cells in ((0, 1 << 22), (32, 1 << 22), (10**9, 100)):
        monkeypatch.setattr(N, "PRODUCT_GAIN", gain)
        monkeypatch.setattr(N, "TILE_CELLS", cells)
        assert N.linked(ids, side, copies, sets, 0.3, True)[0].tolist() == brute
    assert sum(brute)


def test_empty_and_wordless_tables(spark):
    assert N.near_duplicates(doc_rows(spark, [])).count() == 0
    got = N.near_duplicates(doc_rows(spark, [(1, None), (2, ""), (3, "a b"), (None, " ")])).drop("_row", "_first")
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 1, 0), (None, None, 1, 0)]


def test_recall_of_the_bands():
    n = N.bands_for()
    assert 1 - (1 - 0.8**N.ROWS) ** n >= N.RECALL > 1 - (1 - 0.8**N.ROWS) ** (n - 1)


def test_shingle_hashes_follow_the_words():
    texts = ["Aa b, c d e f", "aa B c d e f", "f", None, "é É é x y z z z z z z z"]
    sets, sizes = N.shingle_sets(texts)
    assert list(sizes) == [len(shingles(t)) for t in texts]
    assert list(sets[:2]) == list(sets[2:4])


def test_components_of_ascending_chains_take_few_rounds(spark, monkeypatch):
    from sqlgauge.llm import components as C

    seen, plain = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: seen.append(label) or plain(df, label))
    got = C.components(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long"), path=True).collect()
    assert {(r["id"], r["label"]) for r in got} == {(k, 0) for k in range(301)}
    assert seen.count("moved") < 16 and {len(r["path"]) for r in got} == {seen.count("moved")}


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    order = rng.permutation(400).tolist()
    edges = [(order[k], order[k + 1]) for k in range(200) if k % 50] + [(order[250], order[k]) for k in range(251, 400)] + [(7, 7)]
    label = {k: k for k in range(400)}
    for a, b in edges * 50:
        label[a] = label[b] = min(label[a], label[b])
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: label[k] for e in edges if e[0] != e[1] for k in e}
