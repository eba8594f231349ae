import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlgauge.llm import lexical_search
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, top=10):
    held = [(i, Counter(found), len(found)) for i, t in docs if (found := terms(t))]
    total, frequency = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, count, n in held:
            m = 25 + 75 * n * len(held) // total
            score = 0
            for t in terms(text):
                if count[t]:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * frequency[t] + 1)))
                    score += w * (1_000_000_000 * count[t] // (1000 * count[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "É", "é", "Zürich", "zürich", "中文", "x1", "ﬁ", "rare", "İ"]

    def text(most):
        return rng.choice(["", " "]).join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", " "]) for _ in range(rng.randint(0, most)))

    docs = [(k, text(12)) for k in range(150)] + [(k, "a rare x1") for k in range(300, 340)]  # ties at every rank
    docs += [(None, "a rare x1"), (None, None), (7, "a rare x1"), (7, "a rare x1"), (900, "b " * 30000 + "rare"), (901, "---"), (902, "")]
    items = [(k, text(20)) for k in range(50)] + [(3, "a rare x1"), (None, "rare RARE"), (60, None), (61, ""), (62, "absent"), (63, "b " * 5000)]
    return docs, items


def frames(spark, docs, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    return doc_rows(spark, docs).repartition(5), asked.withColumn("doc_id", F.lit(0)).withColumn("score", F.lit("clash"))


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    docs, items = tables(seed)
    made, asked = frames(spark, docs, items)
    write_tables(spark, tmp_path, documents=made.withColumn("n", F.lit(1)), benchmark=asked)
    got = QUERIES["op13_lexical_search"](spark, str(tmp_path))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_passes_small_tiles_and_split_sums_change_nothing(spark):
    docs, items = tables(3)
    made, asked = frames(spark, docs, items)
    exact = lexical_search.IMPACT * 40_000  # many runs, and the weight of 5000 repeats is cut into parts
    got = lexical_search.search(made, asked, top=4, pass_words=200, tile_items=3, exact=exact)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_partial_sums_are_bounded_and_whole():
    rng = random.Random(5)
    weights = np.array([rng.choice([0, 1, 700, 20_000]) for _ in range(60)])
    items = [Counter(rng.choices(range(60), k=rng.choice([3, 50, 4000]))) for _ in range(40)]
    exact = lexical_search.IMPACT * 100_000
    seen = 0
    for tile in lexical_search.tiles(items, weights, 7, exact):
        assert tile.runs[0][0] == 0 and tile.runs[-1][1] == len(tile.words) and all(a[1] == b[0] for a, b in zip(tile.runs, tile.runs[1:]))
        for a, b in tile.runs:
            assert (tile.weights[:, a:b].sum(axis=1) * lexical_search.IMPACT < exact).all()
        for row, item in zip(tile.weights, tile.items.tolist()):
            summed = Counter()
            for word, part in zip(tile.words.tolist(), row.astype(int).tolist()):
                summed[word] += part
            assert +summed == +Counter({w: int(weights[w]) * n for w, n in items[item].items()})
            seen += 1
    assert seen == sum(any(weights[w] for w in item) for item in items)


def test_impacts_stay_below_their_bound():
    counts = np.array([1, 5, 10**6, 10**9])
    assert (lexical_search.impacts(counts, np.array([1, 5, 10**6, 10**9]), 10**9, 10**12) <= lexical_search.IMPACT).all()


def test_empty_tables(spark, tmp_path):
    docs, items = tables(4)
    none = spark.createDataFrame([], "item_id long, text string")
    made, asked = frames(spark, docs, items)
    assert lexical_search.search(made, none).count() == 0 == lexical_search.search(doc_rows(spark, []), asked).count()
    write_tables(spark, tmp_path, documents=doc_rows(spark, [(1, None)]), benchmark=asked)
    assert QUERIES["op13_lexical_search"](spark, str(tmp_path)).count() == 0
