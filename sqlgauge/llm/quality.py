"""Quality rules: counts of words, symbols and repeats, and perplexity bands per language.

The language model is a modified Kneser-Ney model of ``ORDER`` bytes per language, counted by Spark over all documents.
Counts are packed keys; a scoring step holds them as sorted hash arrays with an index over the leading bits. The model
grows with the corpus. It is split into blocks of at most ``BLOCK_ENTRIES`` entries by the last two bytes of the
context, so all that one position needs stands in one block (the two lowest orders stand in all). One block after the
other is broadcast for a narrow step over all documents, which adds what it knows; sums are complete after the last.

A document is kept if it passes the base rules and its perplexity lies in the band of its language. Its distance is that
of the logarithm from the language's median, in median absolute deviations over all documents of the language, divided by
the root of 1 + ``WIDEN`` / words, as a short text's mean scatters more. With labels the band reaches from the ``OUTSIDE``
quantile to the 1 - ``OUTSIDE`` quantile of the distances of the language's training rows: documents labelled quality 1
that pass the base rules, without those whose crc32(doc_id as text) mod 5 is 0. Languages with fewer than ``LEAST_ROWS``
training rows, and tables without labels, have the band from -``LOWER`` to ``UPPER``.

Null and empty texts have no words and fail. A null language is a language of its own. Rows are judged one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import extended, prepared, slices, with_columns
from .toxicity import held_out

ORDER = 5
BLOCK_ENTRIES = 2_000_000
LOWER, UPPER = 10.0, 4.0
OUTSIDE = 0.01
LEAST_ROWS = 100
WIDEN = 100
LEAST_SPREAD = 0.01
LANGUAGES = 12  # bits
SHIFT = np.uint64(8 * ORDER)
BLANK = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


def language_tag(lang: str | None) -> int:
    return 0 if lang is None else 1 + zlib.crc32(lang.encode()) % ((1 << LANGUAGES) - 1)


def _mix(key: np.ndarray) -> np.ndarray:
    key = key * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    return key * np.uint64(0xBF58476D1CE4E5B9)


def _keys(texts: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, tagged with the language; texts begin behind line breaks. And text sizes."""
    raw = [t.encode() if t else b"" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    pad = b"\n" * (ORDER - 1)
    data = np.frombuffer(pad + pad.join([*raw, b""]), np.uint8)
    key = np.zeros(len(data) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        key = key << np.uint64(8) | data[k : k + len(key)]
    own = np.ones(len(key), bool)
    ends = np.cumsum(sizes + ORDER - 1)
    for k in range(1, ORDER):  # places inside the padding behind a text
        at = ends - k
        own[at[(at >= 0) & (at < len(own))]] = False
    key = key[own]
    tags = np.array([language_tag(x) for x in langs], np.uint64)
    return key | np.repeat(tags << SHIFT, sizes), sizes


def _tagged(batch: pa.RecordBatch, text_col: str, lang_col: str):
    pick = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    return _keys(pick(text_col), pick(lang_col))


def _count_step(text_col: str, lang_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 3 << 20):
            key, count = np.unique(_tagged(batch, text_col, lang_col)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count, pa.int64())], names=["key", "n"])

    return run


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns order, key, n, written once: counts of the highest order, kinds of left neighbours for the lower ones."""
    texts = prepared(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    top = texts.mapInArrow(_count_step("text", "lang"), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = materialize(top, "grams")
    tables = [top.select(F.lit(ORDER).alias("order"), "key", "n")]
    kinds = top.select("key")
    tag = ~((1 << 8 * ORDER) - 1)
    for order in range(ORDER - 1, 0, -1):
        short = F.col("key").bitwiseAND(F.lit(tag | (1 << 8 * order) - 1))
        lower = kinds.select(short.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        tables.append(lower.select(F.lit(order).alias("order"), "key", "n"))
        kinds = lower.select("key")
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return materialize(out, "model")


class HashArray:
    """Sorted hashes with an index over their leading bits, and a value for each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashed = _mix(keys)
        order = np.argsort(hashed)
        self.hashes, self.values = hashed[order], values[order]
        self.bits = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        slots = np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.float64) * 2.0 ** int(self.bits)
        self.start = np.searchsorted(self.hashes >> self.bits, np.arange(len(slots), dtype=np.uint64)).astype(np.int32)
        self.hashes = np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))  # a stop behind the last one

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's value, or -1."""
        hashed = _mix(keys)
        at = self.start[(hashed >> self.bits).astype(np.int64)].astype(np.int64)
        held = self.hashes[at]
        behind = np.flatnonzero(held < hashed)
        while len(behind):
            at[behind] += 1
            held[behind] = self.hashes[at[behind]]
            behind = behind[held[behind] < hashed[behind]]
        return np.where((held == hashed) & (at < len(self.values)), at, -1)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams are counted once, twice, three and four times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), top) for d, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95)))


class Model:
    """One block: for each order the log probability of its n-grams and the log back-off weight of its contexts."""

    def __init__(self, order: np.ndarray, key: np.ndarray, n: np.ndarray, cuts: dict, block: int, blocks: int) -> None:
        self.block, self.blocks = block, blocks
        self.grams, self.contexts = {}, {}
        tag = ~np.uint64((1 << 8 * ORDER) - 1)
        for k in range(1, ORDER + 1):
            own = order == k
            gram, count = key[own], n[own].astype(np.float64)
            language = (gram >> SHIFT).astype(np.int64)
            table = np.zeros((1 << LANGUAGES, 3))
            for number in np.unique(language):
                table[number] = cuts[k, int(number)]
            cut = table[language, np.minimum(count, 3).astype(np.int64) - 1] if len(gram) else count
            context = gram & tag | (gram & ~tag) >> np.uint64(8)
            kinds, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, count, len(kinds))
            weight = np.bincount(at, cut, len(kinds)) / np.maximum(total, 1)
            if k == 1:
                lower = np.full(len(gram), 1 / 256)
            else:
                short = gram & (tag | np.uint64((1 << 8 * (k - 1)) - 1))
                lower = np.exp(self.grams[k - 1].values[self.grams[k - 1].find(short)])
            probability = (count - cut) / total[at] + weight[at] * lower
            self.grams[k] = HashArray(gram, np.log(probability))
            self.contexts[k] = HashArray(kinds, np.log(weight))

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithms for the n-grams of the highest order, backing off where one was never seen."""
        out = np.zeros(len(key))
        left = np.arange(len(key))
        tag = ~np.uint64((1 << 8 * ORDER) - 1)
        for k in range(ORDER, 0, -1):
            at = self.grams[k].find(key)
            seen = at >= 0
            out[left[seen]] += self.grams[k].values[at[seen]]
            left, key = left[~seen], key[~seen]
            if not len(left):
                return out
            context = self.contexts[k].find(key & tag | (key & ~tag) >> np.uint64(8))
            known = context >= 0
            out[left[known]] += self.contexts[k].values[context[known]]
            key = key & (tag | np.uint64((1 << 8 * (k - 1)) - 1))
        out[left] += np.log(1 / 256)
        return out


def _block_of(key: np.ndarray, blocks: int) -> np.ndarray:
    """By language and the last two bytes of the context."""
    tag = ~np.uint64((1 << 8 * ORDER) - 1)
    return (_mix(key & (tag | np.uint64(0xFFFF00))) >> np.uint64(33)) % np.uint64(blocks)


def models(counts: DataFrame, limit: int = BLOCK_ENTRIES) -> Iterator[Model]:
    """The blocks, one after the other; each holds at most about ``limit`` entries beside the two lowest orders."""
    entries = counts.count()
    blocks = max(1, -(-entries // limit))
    low = counts.where("n <= 4").groupBy("order", F.shiftrightunsigned("key", 8 * ORDER).alias("lang"), "n").count().collect()
    seen = counts.groupBy("order", F.shiftrightunsigned("key", 8 * ORDER).alias("lang")).count().collect()
    tally: dict = {(r["order"], r["lang"]): {} for r in seen}  # at most 2 ** LANGUAGES languages
    for r in low:
        tally[r["order"], r["lang"]][r["n"]] = r["count"]
    cuts = {k: discounts(v) for k, v in tally.items()}
    for block in range(blocks):
        own = counts
        if blocks > 1:
            part = _part_column(blocks)
            own = counts.where((F.col("order") <= 2) | (part == block))
        held = own.toArrow()
        order, n = np.asarray(held.column("order")), np.asarray(held.column("n"))
        yield Model(order, np.asarray(held.column("key")).view(np.uint64), n, cuts, block, blocks)


def _part_column(blocks: int):
    @F.pandas_udf("long")
    def part(key):
        return __import__("pandas").Series(_block_of(key.to_numpy(np.int64).view(np.uint64), blocks).astype(np.int64))

    return part("key")


def _exact_ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each distinct pair."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]


def repeated_words(words: list[list[bytes]], size: int = 5) -> np.ndarray:
    """Words of each text in windows of ``size`` words that the text holds twice or more."""
    counts = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for own in words for w in own], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    n = len(ids) - size + 1
    if n < 1:
        return np.zeros(len(words), np.int64)
    start = np.flatnonzero(owner[:n] == owner[size - 1 :])
    if not len(start):
        return np.zeros(len(words), np.int64)
    rank = ids[start]
    for k in range(1, size):
        rank = _exact_ranks(rank, ids[start + k])
    rank = _exact_ranks(rank, owner[start])
    twice = start[np.bincount(rank)[rank] > 1]
    edge = np.zeros(len(ids) + size + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + size, -1)
    return np.bincount(owner, np.cumsum(edge)[: len(ids)] > 0, len(words)).astype(np.int64)


BASE = "_words long, _word_chars long, _symbols long, _dup_lines long, _repeat_words long"


def _base_counts(texts: list[str | None]) -> dict[str, pa.Array]:
    texts = [t or "" for t in texts]
    words = [t.encode().split() for t in texts]
    columns = [[len(w) for w in words], [], [], [], repeated_words(words)]
    for text in texts:
        columns[1].append(len(text) - sum(map(text.count, BLANK)))
        columns[2].append(sum(map(text.count, SYMBOLS)))
        lines = [x for x in text.split("\n") if x.strip(BLANK)]
        columns[3].append(len(lines) - len(set(lines)))
    names = [c.split()[0] for c in BASE.split(", ")]
    return {n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}


def _measure_step(held, text_col: str, lang_col: str):
    """The base counts with the first block, and for every block what it adds to the log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in slices(batches, text_col, 1 << 20):
            key, sizes = _tagged(batch, text_col, lang_col)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if model.blocks > 1:
                own = _block_of(key, model.blocks) == model.block
                key, owner = key[own], owner[own]
            total = np.bincount(owner, model.log_probability(key), len(sizes))
            extra = {}
            if model.block:
                total = total + np.asarray(batch.column(batch.schema.get_field_index("_log_probability")))
                batch = batch.select([n for n in batch.schema.names if n != "_log_probability"])
            else:
                extra = _base_counts(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield with_columns(batch, extra | {"_log_probability": pa.array(total, pa.float64())})

    return run


def learnt_bands(judged: DataFrame, labels: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """Columns _band_lang, _low, _high of the languages with enough training rows; written once."""
    good = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_label_id"))
    good = good.agg(F.min("quality").alias("_quality")).where("_quality = 1")
    rows = judged.where("NOT _base_failed").join(good, F.col(id_col) == F.col("_label_id"), "left_semi")
    cuts = F.percentile_approx("_away", [OUTSIDE, 1 - OUTSIDE], 10_000)
    bands = rows.groupBy(F.col(lang_col).alias("_band_lang")).agg(cuts.alias("_cuts"), F.count("_away").alias("_rows"))
    bands = bands.where(F.col("_rows") >= LEAST_ROWS)
    return materialize(bands.select("_band_lang", F.col("_cuts")[0].alias("_low"), F.col("_cuts")[1].alias("_high")), "learnt-bands")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER,
          limit: int = BLOCK_ENTRIES, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """All columns but the text, plus the base counts, _perplexity, _base_failed and _kept. ``labels``: doc_id, quality."""
    docs = prepared(docs, BASE + ", _log_probability double, _log double, _lang string, _middle double, _spread double, _away double, "
                    "_base_failed boolean, _band_lang string, _low double, _high double")
    counts = count_grams(docs, text_col, lang_col)
    names = [*docs.columns, *(c.split()[0] for c in BASE.split(", "))]
    schema = extended(docs.schema, BASE + ", _log_probability double")
    measured = docs
    for model in models(counts, limit):
        if model.block:  # one block at a time in the workers' memory
            measured = materialize(measured, "blocks")
        held = docs.sparkSession.sparkContext.broadcast(model)
        measured = measured.mapInArrow(_measure_step(held, text_col, lang_col), schema)
    size = F.octet_length(F.coalesce(text_col, F.lit("")))
    measured = measured.withColumn("_log", F.when(size > 0, -F.col("_log_probability") / size))
    measured = materialize(measured.drop(text_col, "_log_probability"), "measured")
    middle = measured.groupBy(lang_col).agg(F.percentile_approx("_log", 0.5, 10_000).alias("_middle"))
    middle = materialize(middle.withColumnRenamed(lang_col, "_lang"), "middles")
    same = F.col(lang_col).eqNullSafe(F.col("_lang"))
    away = measured.select(lang_col, "_log").join(middle, same).groupBy("_lang").agg(
        F.first("_middle").alias("_middle"), F.percentile_approx(F.abs(F.col("_log") - F.col("_middle")), 0.5, 10_000).alias("_spread")
    )
    bands = materialize(away, "bands")
    spread = F.greatest(F.col("_spread"), F.lit(LEAST_SPREAD)) * F.sqrt(1 + WIDEN / F.greatest("_words", F.lit(1)))
    failed = (F.col("_words") < 10) | (100 * F.col("_repeat_words") > 20 * F.col("_words"))
    judged = measured.join(bands, same, "left").withColumn("_away", (F.col("_log") - F.col("_middle")) / spread)
    judged = judged.withColumn("_base_failed", failed)
    low, high = F.lit(-lower), F.lit(upper)
    if labels is not None:
        learnt = learnt_bands(judged, labels, id_col, lang_col)
        judged = judged.join(learnt, F.col(lang_col).eqNullSafe(F.col("_band_lang")), "left")
        low, high = F.coalesce("_low", low), F.coalesce("_high", high)
    inside = F.col("_away").between(low, high)
    return judged.select(
        *[c for c in names if c != text_col], F.exp("_log").alias("_perplexity"), "_base_failed",
        (~F.col("_base_failed") & F.coalesce(inside, F.lit(False))).alias("_kept"),
    )
