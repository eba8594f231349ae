import random

import pytest

import corpus_pipeline as P

from .helpers import doc_rows, write_tables
from .test_decontamination import expected as contaminated
from .test_ngram_join import expected as classes
from .test_toxicity import corpus as toxic_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_force(rows, toxic, items):
    """What is left of (doc_id, text) rows of one source: ids and texts."""
    rows = [r for r in rows if r[0] not in toxic]
    held = {}
    for _, text in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            held[line] = held.get(line, 0) + 1
    bad = {x for x, n in held.items() if n >= 5 and n > 0.01 * len(rows)}
    cut = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        if text is None or len(kept) == len(lines) or any(x.strip(" ") for x in kept):
            cut.append((i, text if text is None else "\n".join(kept)))
    seen, left = set(), []
    of = {}
    for (i, class_id, *_rest) in classes(cut):
        of.setdefault(i, set()).add(class_id)
    for i, text in cut:
        if i in of[i] and i not in seen:
            seen.add(i)
            left.append((i, text))
    hit = {r[0]: r for r in contaminated(left, items)}
    return {i: (text, hit[i][2], hit[i][1]) for i, text in left if not hit[i][1] or hit[i][2] < hit[i][1]}


def tables(spark, folder):
    rng = random.Random(21)
    rows, labels = toxic_corpus(260)
    toxic = {k for k, _, t in labels if t}
    items = [(k, " ".join(f"item{k}w{rng.randint(0, 50)}" for _ in range(14))) for k in range(3)] + [(9, None)]
    clean = [r for r in rows if r[0] not in toxic]
    rows = [(i, t + ("\nSubscribe now" if i % 3 == 0 else "") + (f"\nmenu {i}" if i % 2 else "")) for i, t in rows]
    rows += [(1000 + k, clean[k][1]) for k in range(12)] + [(1100 + k, clean[30 + k][1].replace("the", "THE") + " end") for k in range(8)]
    rows += [(1200 + k, f"{clean[60 + k][1]}\n{items[k][1]}, and on {k}") for k in range(3)] + [(1300, items[0][1])]
    rows += [(1400, None), (1401, ""), (1402, "Subscribe now"), (1, rows[1][1]), (1403, "alone " * 20_000)]
    write_tables(
        spark, folder, documents=doc_rows(spark, rows), benchmark=spark.createDataFrame(items, "item_id long, text string"),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    return rows, toxic, items


def test_run_equals_brute_force(spark, tmp_path):
    rows, toxic, items = tables(spark, tmp_path)
    expected = brute_force(rows, toxic, items)
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(expected)
    for row in got:
        text, hit, words = expected[row["doc_id"]]
        if not hit:
            assert row["text"] == (text or "")
        else:
            assert all((t or "-")[:40] not in row["text"] for _, t in items) and 0 < len(row["text"]) < len(text)
        assert row["n_tokens"] == len(row["token_ids"])
    assert 1300 not in expected and any(h for _, h, _ in expected.values())


def test_stages_keep_the_columns_and_bear_odd_tables(spark, tmp_path):
    tables(spark, tmp_path)
    for rows in ([], [(None, None), (None, "a b"), (None, "a b"), (5, ""), (5, "x y z")]):
        for name, stage in P.STAGES:
            got = stage(spark, doc_rows(spark, rows), str(tmp_path))
            if name != "bpe":
                assert got.columns == COLUMNS
            assert got.count() == (0 if not rows else 3 if name == "ngram_join" else 5)


def test_stages_keep_extra_columns(spark, tmp_path):
    tables(spark, tmp_path)
    names = ["score", "toxic", "n_words", "class_id", "label", "row", "line", "tokens", "id", "_row", "_spans"]
    docs = doc_rows(spark, [(1, "a b c"), (2, None)])
    for name in names:
        docs = docs.withColumn(name, docs.doc_id)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == COLUMNS + names[:-2] and got.count() == 2 and got.where("row = doc_id").count() == 2
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 2


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_every_stage_is_registered_in_order(name):
    assert [n for n, _ in P.STAGES].index(name) == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"].index(name)


def test_of_texts_under_one_id_the_same_stays(spark, tmp_path):
    rows = [(5, "x y z"), (5, "other words"), (5, None), (6, "alone")]
    kept = [
        sorted((r["doc_id"], r["text"]) for r in P.keep_one_of_each(spark, doc_rows(spark, order), str(tmp_path)).collect())
        for order in (rows, rows[::-1], [rows[1], rows[3], rows[0], rows[2]])
    ]
    assert kept[0] == kept[1] == kept[2] and [i for i, _ in kept[0]] == [5, 6]


def test_of_a_group_of_copies_one_survives(spark, tmp_path):
    rng = random.Random(22)
    page = lambda k: [" ".join(f"p{k}w{rng.randint(0, 400)}" for _ in range(12)) for _ in range(10)]
    exact, near, rows = page(0), page(1), [(k, "\n".join([*page(k), "Subscribe now"])) for k in range(100, 140)]
    rows += [(k, "\n".join(exact)) for k in range(200, 208)] + [(None, "\n".join(exact))] * 6
    rows += [(k, "\n".join([*near[:9], f"{near[9]} {k % 3}"])) for k in range(300, 330)]
    rows += [(k, "*** ***") for k in range(400, 407)] + [(500, "Subscribe now"), (501, None)]
    docs = doc_rows(spark, rows)
    cut = P.drop_lines(spark, docs, str(tmp_path))
    assert cut.where("text LIKE '%Subscribe%'").count() == 0 and cut.where("doc_id = 500").count() == 0
    left = {r["doc_id"]: r["text"] for r in P.keep_one_of_each(spark, cut, str(tmp_path)).collect()}
    assert [i for i in left if i is None or 200 <= i < 208] == [200] and left[200] == "\n".join(exact)
    assert [i for i in left if i and 300 <= i < 330] == [300] and left[300] == dict(rows)[300]
    assert sum(i in left for i in range(100, 140)) == 40 and all(i in left for i in range(400, 407)) and 501 in left
