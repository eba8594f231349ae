"""Ranked lexical search of every item over all documents by dense blocked matrix products.

The words of the items are numbered; one pass over the texts writes each document's length and the counts of those words
(``count_words``), from which the document frequencies come. Scores are matrix products: an item tile holds up to
``ITEMS`` items over its own compact vocabulary, a document tile the impacts of its words, both as float64. Weights,
impacts and sums are whole numbers, and a tile's vocabulary is cut into runs whose sums stay under 2^53 in every item,
so each product is exact; runs are added as 64-bit integers. A weight that is too large by itself is cut into parts.

Each task keeps the best documents of each item: a tile offers every document at or above the item's last kept score,
equal scores are ordered by id, so no tie is lost. The tasks' lists meet in two steps, per group of tasks and then per
item, so no task sees more than a bounded number of rows per group.

Items are searched in passes of at most ``PASS_WORDS`` words with repeats (one longer item is a pass by itself), which is
all that the driver and a task hold of them; only the passes' number grows with the items. Null and empty item texts and
those without a match return no row. Repeated items, also of one id, are ranked each for itself. Null and empty texts
hold no word and are no document of N. Among equal scores a null document id comes last; repeated document rows are
ranked each for itself. Only doc_id and text, item_id and text are read, so further columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import lists, prepared, ranges, slices

TOP = 10
#: Documents with words weigh in with 75 of 100 by their length.
LENGTH_SHARE = 75
ITEMS = 32
PASS_WORDS = 200_000
CELLS = 1 << 21
BATCH_BYTES = 1 << 21
EXACT = 1 << 53
#: An impact is at most this: the quotient of a million times as much by at least its own thousandth.
IMPACT = 1_000_000
GROUPS = 256
NO_ID = np.iinfo(np.int64).max

#: Bytes of words stay, A-Z lower-cased; all others become blanks.
_PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_PLAIN).split() if text else []


# --- counts ---------------------------------------------------------------------------------------------------------

COUNTED = "doc_id long, n long, words array<int>, counts array<int>"


def count_words(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a word: doc_id, n (its words with repeats), the numbers of those in the vocabulary and their counts."""
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            keys, sizes = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = words(text)
                sizes.append(len(found))
                numbers = np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))
                keys.append(numbers[numbers >= 0] + k * width)
            key, many = np.unique(np.concatenate(keys), return_counts=True)
            row = key // width
            held = np.bincount(row, minlength=len(sizes))
            columns = [
                batch.column(0), pa.array(sizes, pa.int64()), lists(pa.array(key - row * width, pa.int32()), held),
                lists(pa.array(many, pa.int32()), held),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "words", "counts"]).filter(pa.array(np.array(sizes) > 0))

    texts = prepared(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, COUNTED)


# --- tiles ----------------------------------------------------------------------------------------------------------


class Tile(NamedTuple):
    """Some items over their own words: the words' numbers, weights with repeats, and the runs whose sums are exact."""

    items: np.ndarray
    words: np.ndarray
    weights: np.ndarray
    runs: list[tuple[int, int]]


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def tiles(items: list[Counter], weights: np.ndarray, size: int = ITEMS, exact: int = EXACT) -> list[Tile]:
    """Tiles over the items (counts of word numbers); words of no weight add nothing and are left out."""
    out = []
    most = (exact - 1) // IMPACT
    order = [k for k, item in enumerate(items) if any(weights[w] > 0 for w in item)]
    for low in range(0, len(order), size):
        own = order[low : low + size]
        columns: list[tuple[int, np.ndarray]] = []
        for word in sorted({w for k in own for w in items[k] if weights[w] > 0}):
            left = np.array([int(weights[word]) * items[k][word] for k in own], np.int64)
            while left.any():  # more than once only for a weight that is too large by itself
                part = np.minimum(left, most)
                columns.append((word, part))
                left = left - part
        runs, start, total = [], 0, np.zeros(len(own), np.int64)
        for k, (_, part) in enumerate(columns):
            if (total + part > most).any():
                runs.append((start, k))
                start, total = k, np.zeros(len(own), np.int64)
            total = total + part
        runs.append((start, len(columns)))
        matrix = np.array([part for _, part in columns], np.float64).T
        out.append(Tile(np.array(own), np.array([w for w, _ in columns]), np.ascontiguousarray(matrix), runs))
    return out


def impacts(counts: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Best:
    """The best documents seen so far of each item."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.ids = [np.zeros(0, np.int64) for _ in range(items)]
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def offer(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a tile, items by documents; a score that only equals the last kept one may win by its id."""
        row, column = np.nonzero(scores >= self.least[items][:, None])
        cuts = np.searchsorted(row, np.arange(len(items) + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            item, at = items[k], column[cuts[k] : cuts[k + 1]]
            score = np.concatenate([self.scores[item], scores[k, at]])
            doc = np.concatenate([self.ids[item], ids[at]])
            kept = np.lexsort((doc, -score))[: self.top]
            self.scores[item], self.ids[item] = score[kept], doc[kept]
            if len(kept) == self.top:
                self.least[item] = score[kept[-1]]


def _document_tiles(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    """Pieces of a batch whose dense counts fit: ids, lengths, row and word and count of each entry."""
    ids = np.asarray(batch.column(0).fill_null(NO_ID))
    length = np.asarray(batch.column(1))
    held = np.asarray(batch.column(2).value_lengths())
    word, count = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten()).astype(np.int64)
    ends = np.cumsum(held)
    rows = max(1, CELLS // max(1, width))
    for low in range(0, len(ids), rows):
        high = min(low + rows, len(ids))
        part = slice(int(ends[low] - held[low]), int(ends[high - 1]))
        yield ids[low:high], length[low:high], np.repeat(np.arange(high - low), held[low:high]), word[part], count[part]


def _search_step(held: list[Tile], width: int, n_items: int, documents: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, top)
        for batch in batches:
            for ids, length, row, word, count in _document_tiles(batch, width):
                dense = np.zeros((width, len(ids)))
                dense[word, row] = impacts(count, length[row], documents, total)
                for tile in held:
                    own = dense[tile.words]
                    scores = np.zeros((len(tile.items), len(ids)), np.int64)
                    for a, b in tile.runs:
                        scores += (tile.weights[:, a:b] @ own[a:b]).astype(np.int64)
                    best.offer(tile.items, scores, ids)
        sizes = [len(s) for s in best.ids]
        ids = np.concatenate([np.zeros(0, np.int64), *best.ids])
        columns = [
            pa.array(np.repeat(np.arange(n_items), sizes), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID),
            pa.array(np.concatenate([np.zeros(0, np.int64), *best.scores]), pa.int64()),
            pa.array(np.full(len(ids), TaskContext.get().partitionId() % GROUPS), pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score", "part"])

    return run


FOUND = "item int, doc_id long, score long, part int"


def _merged(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` per item, by way of groups of tasks."""
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return found


def _passes(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """Items (item_id, text) with a word, in order, cut into passes; a pass at a time is on the driver."""
    held, total = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        found = words(row["text"])
        if held and total + len(found) > most:
            yield held
            held, total = [], 0
        if found:
            held.append((row["item_id"], found))
            total += len(found)
    if held:
        yield held


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, pass_words: int = PASS_WORDS, tile_items: int = ITEMS, exact: int = EXACT
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest scores above 0 of each item (columns item_id, text)."""
    spark, out = docs.sparkSession, None
    for held in _passes(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")), pass_words):
        found = _one_pass(spark, docs, held, top, tile_items, exact)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _one_pass(spark: SparkSession, docs: DataFrame, held: list[tuple], top: int, tile_items: int, exact: int) -> DataFrame:
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, found in held for w in found}))}
    counted = materialize(count_words(docs, vocabulary), "counted")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency: list[Row] = counted.select(F.explode("words").alias("word")).groupBy("word").count().collect()  # the pass's words
    weights = np.zeros(len(vocabulary), np.int64)
    for word, n in frequency:
        weights[word] = weight(documents, n)
    made = tiles([Counter(vocabulary[w] for w in found) for _, found in held], weights, tile_items, exact)
    step = _search_step(made, len(vocabulary), len(held), documents, total, top)
    best = materialize(_merged(counted.mapInArrow(step, FOUND), top), "best")
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(held)], "item int, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
