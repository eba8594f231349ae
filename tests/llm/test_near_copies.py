import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sqlgauge.llm import near_copies as C
from sqlgauge.llm import ngram_join as N

from .helpers import doc_rows
from .test_ngram_join import corpus, expected, pairs_near_the_border


def partition(rows):
    """The members of each group of more than one row, by brute force."""
    groups = {}
    for i, class_id, _, links in expected(rows):
        if links:
            groups.setdefault(class_id, set()).add(-1 if i is None else i)
    return sorted(map(sorted, groups.values()))


def found(spark, rows):
    docs = doc_rows(spark, rows)
    got = C.near_copies(docs, N.row_id())
    assert got.columns == ["_member", "_page"]
    names = {r["row"]: r["doc_id"] for r in docs.select(N.row_id().alias("row"), "doc_id").collect()}
    groups = {}
    for member, page in got.collect():
        groups.setdefault(page, set()).add(-1 if names[member] is None else names[member])
    assert all(page in names for page in groups)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few", [0, 10**9])
def test_groups_equal_brute_force(spark, monkeypatch, seed, few):
    monkeypatch.setattr(C, "PAIRS_PER_ROW", few)  # by centres first, or all pairs at once
    rows = corpus(seed)
    assert pairs_near_the_border(rows) and len(partition(rows)) > 5
    assert found(spark, rows) == partition(rows)


def test_chains_and_large_groups(spark):
    words, rows = [f"w{k}" for k in range(60)], []
    for k in range(60):  # each is near the next ones only
        rows.append((k, " ".join(words)))
        words = [*words[3:], *(f"c{k}x{j}" for j in range(3))]
    base = [f"v{k}" for k in range(90)]
    rows += [(100 + k, " ".join([*base[: 3 * k % 80], f"edit{k}", *base[3 * k % 80 :]])) for k in range(60)]
    rows += [(200, None), (201, ""), (202, "..."), (203, "É é"), (204, "é é"), (205, "É É"), (206, "one"), (207, "ONE!")]
    got = found(spark, rows)
    assert got == partition(rows) and len(got[0]) == 60 and len(got) == 3


def test_a_large_group_takes_rows_in_proportion(spark, monkeypatch):
    plain, tested = C._near, []
    monkeypatch.setattr(C, "_near", lambda pairs, *a: tested.append(pairs.count()) or plain(pairs, *a))
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: k % 190], f"edit{k}", *base[k % 190 :]])) for k in range(400)]
    assert found(spark, rows) == [list(range(400))]
    assert sum(tested) < 31 * 400  # of 79,800 pairs


def test_texts_with_one_long_passage_are_no_pairs(spark, monkeypatch):
    plain, tested = C._near, []
    monkeypatch.setattr(C, "_near", lambda pairs, *a: tested.append(pairs.count()) or plain(pairs, *a))
    passage = [f"v{k}" for k in range(100)]
    rows = [(k, " ".join([*passage, *(f"own{k}x{j}" for j in range(14 + k % 16))])) for k in range(200)]
    rows += [(300 + k, " ".join([*passage, *(f"own{k}x{j}" for j in range(14 + k % 16)), "more"])) for k in range(0, 200, 50)]
    assert found(spark, rows) == partition(rows) == [[k, 300 + k] for k in range(0, 200, 50)]
    assert sum(tested) < 3 * len(rows)  # of 20,706 pairs


def test_rows_of_open_buckets_are_made_once_a_round(spark, monkeypatch):
    plain, plans, rounds, opened = C._near, [], [], C._open
    monkeypatch.setattr(C, "_near", lambda pairs, *a: plans.append(pairs._jdf.queryExecution().toString()) or plain(pairs, *a))
    monkeypatch.setattr(C, "_open", lambda held: rounds.append(opened(held)) or rounds[-1])
    base = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join([*base[: k % 190], f"edit{k}", *base[k % 190 :]])) for k in range(400)]
    assert found(spark, rows) == [list(range(400))]
    assert plans and not any("LeftSemi" in p for p in plans)
    assert sum(size for _, size, _ in rounds) < 2 * 31 * 400


def test_rows_without_ids_and_empty_tables(spark):
    same = " ".join(f"w{k}" for k in range(20))
    assert found(spark, [(None, same), (7, same.upper()), (8, "other"), (None, None)]) == [[-1, 7]]
    assert found(spark, []) == [] and found(spark, [(1, "a"), (2, "b")]) == []


def test_line_dedup_of_the_pipeline_has_no_python(spark, tmp_path, monkeypatch):
    plans = []
    for module in (C, P, P.line_dedup):
        plain = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, label, f=plain: plans.append(df) or f(df, label))
    rows = [(k, f"menu\npage {k} " + " ".join(f"w{k // 2}x{j}" for j in range(40))) for k in range(40)]
    cut = P.drop_lines(spark, doc_rows(spark, rows), str(tmp_path))
    assert cut.where(F.col("text").contains("menu")).count() == 0 and len(plans) > 5
    for df in [*plans, cut]:
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
