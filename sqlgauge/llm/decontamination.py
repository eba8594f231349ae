"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_BYTES`` bytes inside one task. Its words are coded by the
benchmark's vocabulary; words that occur in no benchmark text break the sequence, as no phrase can reach over
them, and stretches shorter than the shortest phrase are left out. The rest is indexed: suffix order,
Burrows-Wheeler transform, wavelet matrix for ranks, sampled suffix positions. All benchmark phrases are searched
backward at once, occurrences are located by walking to a sampled position, and hit words become merged spans.

The benchmark is the stated query set. It is streamed to the driver in blocks of at most ``BLOCK_WORDS`` words;
each block is broadcast and searched in its own narrow step over all rows, so no size of benchmark is cut.

Benchmark rows without an id are searched like others: their phrases are hits and spans, only a name for _items is lacking.
Null and empty texts have no words and no hits; repeated rows and ids are judged row by row; further columns of the
input pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, extended, lists, merged, prepared, ranges, slices, tidy, with_columns, words

PHRASE_WORDS = 10
SHARD_BYTES = 8 << 20
BLOCK_WORDS = 1_000_000
SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order (prefix doubling over the ties that are left)."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    slot = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, slot, 0))
    tied = order[~(fresh & np.append(fresh[1:], True))]
    step = 1
    while len(tied):
        ahead = tied + step
        key = rank[tied] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        inner = np.argsort(key, kind="stable")
        tied, key = tied[inner], key[inner]
        old = rank[tied]
        opens = np.ones(len(tied), bool)
        opens[1:] = old[1:] != old[:-1]
        slot = old + np.arange(len(tied)) - np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))
        order[slot] = tied
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[tied] = np.maximum.accumulate(np.where(fresh, slot, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return order


class FmIndex:
    """Index of word stretches; ``code`` holds 1..vocabulary, and 0 behind each stretch."""

    def __init__(self, code: np.ndarray, vocabulary: int) -> None:
        breaks = np.flatnonzero(code == 0)
        symbols = code.astype(np.int64) + len(breaks)
        symbols[breaks] = np.arange(len(breaks))  # each break its own symbol, so copies of stretches end apart
        order = suffix_order(symbols)
        self.last = code[order - 1]  # the transform; the first suffix takes the last break
        counts = np.bincount(code, minlength=vocabulary + 2)
        self.below = np.cumsum(counts) - counts
        self.levels: list[tuple[np.ndarray, int]] = []
        rest = self.last
        for level in reversed(range(int(vocabulary).bit_length())):
            bit = (rest >> level & 1).astype(bool)
            ones = np.zeros(len(rest) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(rest) - int(ones[-1])))
            rest = np.concatenate([rest[~bit], rest[bit]])
        starts = np.zeros(len(code), bool)
        starts[0] = True
        starts[breaks[:-1] + 1] = True
        sampled = (order % SAMPLE == 0) | starts[order]
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands above its row of the transform."""
        low = np.zeros_like(row)
        for depth, (ones, zeros) in enumerate(self.levels):
            bit = (symbol >> (len(self.levels) - 1 - depth) & 1).astype(bool)
            low_ones, row_ones = ones[low], ones[row]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            row = np.where(bit, zeros + row_ones, row - row_ones)
        return row - low

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (rows of ``phrases``, padded behind)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < sizes) & (low < high))
            symbol = phrases[live, sizes[live] - 1 - back].astype(np.int64)
            low[live] = self.below[symbol] + self.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: step back until a sampled position is met."""
        found = np.empty(len(rows), np.int64)
        at, walk, steps = np.arange(len(rows)), rows, 0
        while len(at):
            done = self.sampled[walk]
            found[at[done]] = self.samples[self.sample_at[walk[done]]] + steps
            at, walk = at[~done], walk[~done]
            symbol = self.last[walk].astype(np.int64)
            walk = self.below[symbol] + self.rank(symbol, walk)
            steps += 1
        return found


class Phrases:
    """One block of benchmark phrases: coded words, and the items that hold each distinct phrase."""

    def __init__(self, size: int) -> None:
        self.size, self.total = size, 0
        self.vocabulary: dict[bytes, int] = {}
        self.found: dict[tuple[int, ...], set[str]] = {}

    def add(self, item: str | None, text: str | None) -> None:
        code = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
        self.total += len(code)
        for start in range(max(1, len(code) - self.size + 1) if code else 0):
            named = self.found.setdefault(tuple(code[start : start + self.size]), set())
            if item is not None:
                named.add(item)

    def close(self) -> Phrases:
        self.sizes = np.array([len(p) for p in self.found], np.int64)
        self.phrases = np.array([p + (0,) * (self.size - len(p)) for p in self.found], np.int32)
        self.phrases = self.phrases.reshape(len(self.found), self.size)
        items = sorted({i for held in self.found.values() for i in held})
        number = {name: k for k, name in enumerate(items)}
        self.items = pa.array(items, pa.string())
        self.held_sizes = np.array([len(h) for h in self.found.values()], np.int64)
        self.held = np.array([number[i] for h in self.found.values() for i in sorted(h)], np.int64)
        self.held_start = np.cumsum(self.held_sizes) - self.held_sizes
        del self.found
        return self


def phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[Phrases]:
    """Stream the query set to the driver, one bounded block at a time."""
    block = Phrases(size)
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in rows.toLocalIterator():
        block.add(item, text)
        if block.total >= limit:
            yield block.close()
            block = Phrases(size)
    if block.total:
        yield block.close()


def _stretches(code: np.ndarray, bounds: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of known words inside documents: start and length, runs under ``shortest`` left out."""
    inside = code > 0
    edge = np.zeros(len(code) + 1, bool)
    edge[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    keep = end - start >= shortest
    return start[keep], (end - start)[keep]


def search_shard(texts: list[str | None], block: Phrases):
    """Word counts, merged word spans (document, start, end) and (document, item) pairs of one shard."""
    get, coded, sizes = block.vocabulary.get, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = WORD.findall(text.encode().lower()) if text else []
        sizes[k] = len(found)
        coded.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
    none = np.zeros(0, np.int64)
    nothing = sizes, (none, none, none), (none, none)
    code = np.concatenate(coded) if coded else none
    if not len(block.sizes) or not len(code):
        return nothing
    first = np.cumsum(sizes) - sizes
    start, length = _stretches(code, np.append(first, len(code)), int(block.sizes.min()))
    if not len(start):
        return nothing
    distinct: dict[bytes, int] = {}  # equal stretches are indexed once
    number = np.array(
        [distinct.setdefault(code[s : s + n].tobytes(), len(distinct)) for s, n in zip(start.tolist(), length.tolist())]
    )
    text = np.frombuffer(b"".join(s + b"\0\0\0\0" for s in distinct), np.int32)
    size = np.array([len(s) // 4 for s in distinct], np.int64)
    place = np.cumsum(size + 1) - size - 1
    index = FmIndex(text, len(block.vocabulary))
    low, high = index.search(block.phrases, block.sizes)
    hits = np.maximum(high - low, 0)
    if not hits.sum():
        return nothing
    phrase = np.repeat(np.arange(len(hits)), hits)
    position = index.locate(ranges(low, hits))
    stretch = np.searchsorted(place, position, side="right") - 1
    by_stretch = np.argsort(number, kind="stable")  # back to every place that holds the stretch
    copies = np.bincount(number, minlength=len(distinct))
    copy_start = np.cumsum(copies) - copies
    many = copies[stretch]
    source = by_stretch[ranges(copy_start[stretch], many)]
    phrase, offset = np.repeat(phrase, many), np.repeat(position - place[stretch], many)
    word = start[source] + offset
    document = np.searchsorted(first, word, side="right") - 1
    spans = merged(document, word - first[document], word - first[document] + block.sizes[phrase])
    pair = np.unique(document * len(block.sizes) + phrase)
    document, phrase = pair // len(block.sizes), pair % len(block.sizes)
    held = block.held_sizes[phrase]
    width = max(1, len(block.items))  # none of the found may have a name
    pair = np.unique(np.repeat(document, held) * width + block.held[ranges(block.held_start[phrase], held)])
    return sizes, spans, (pair // width, pair % width)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _united(batch: pa.RecordBatch, n: int, spans, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of this block united with those of the blocks before it."""
    if column not in batch.schema.names:
        return spans
    old = batch.column(batch.schema.get_field_index(column))
    flat, counts = old.flatten(), np.asarray(pa.compute.list_value_length(old))
    group = np.repeat(np.arange(n), counts)
    return merged(
        np.append(group, spans[0]), np.append(np.asarray(flat.field("start")), spans[1]),
        np.append(np.asarray(flat.field("end")), spans[2]),
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = PHRASE_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """All columns of ``docs`` plus _words, _spans (word ranges, merged) and _items (found items, sorted)."""
    fields = "_words long, _spans array<struct<start: long, end: long>>, _items array<string>"
    docs = prepared(docs, fields)
    schema, out = docs.schema, extended(docs.schema, fields)
    blocks = list(_steps(docs, benchmark, item_col, item_text_col, size, block_words))
    if not blocks:
        blocks = [docs.sparkSession.sparkContext.broadcast(Phrases(size).close())]
    result = docs
    for held in blocks:
        result = result.mapInArrow(tidy(_searcher(held, text_col, schema.names)), out)
    return result


def _steps(docs, benchmark, item_col, item_text_col, size, block_words):
    for block in phrase_blocks(benchmark, item_col, item_text_col, size, block_words):
        yield docs.sparkSession.sparkContext.broadcast(block)


def _searcher(held, text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = held.value
        for batch in slices(batches, text_col, SHARD_BYTES):
            n = batch.num_rows
            sizes, spans, (document, item) = search_shard(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), block)
            spans = _united(batch, n, spans, "_spans")
            span_values = pa.StructArray.from_arrays(
                [pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.int64())], names=["start", "end"]
            )
            items = lists(block.items.take(pa.array(item)), np.bincount(document, minlength=n))
            if "_items" in batch.schema.names:
                before = batch.column(batch.schema.get_field_index("_items")).to_pylist()
                items = pa.array(
                    [sorted({*a, *b}) for a, b in zip(before, items.to_pylist())], pa.list_(pa.string())
                )
            kept = batch.select(names)
            yield with_columns(
                kept,
                {
                    "_words": pa.array(sizes, pa.int64()),
                    "_spans": lists(span_values, np.bincount(spans[0], minlength=n)),
                    "_items": items,
                },
            )

    return run


def hit_words(spans: str = "_spans") -> Column:
    """How many words the spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def _cutter(text_col: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            cut = []
            for text, ranges_ in zip(batch.column(at).to_pylist(), spans):
                if ranges_:
                    raw = text.encode()
                    places = [m.span() for m in WORD.finditer(raw.lower())]
                    parts, end = [], 0
                    for span in ranges_:
                        parts.append(raw[end : places[span["start"]][0]])
                        end = places[span["end"] - 1][1]
                    parts.append(raw[end:])
                    text = b"\n".join(parts).decode()
                cut.append(text)
            columns = [pa.array(cut, pa.string()) if n == text_col else batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_spans(found: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """Cut the hit words, with what stands between them, out of the texts; a line break takes their place."""
    return found.mapInArrow(tidy(_cutter(text_col, columns)), found.select(*columns).schema)
