"""Token ids in a block-compressed file format, written in ascending id order and read back.

Format: a table of segments, each a run of whole documents in order, at most ``SEGMENT`` ids unless one document is
longer. A segment's payload holds its ids in blocks of ``BLOCK``: the block's minimum is subtracted, values are packed
at the width that fits ``FITS`` of them, the others are exceptions (place and high bits). The payload begins with

    number of blocks (u4), number of ids (u4), then per block: byte offset (u4), minimum (u4), width (u1), exceptions (u2)

so any block can be read alone; behind that follow the blocks: packed bits, exception places (u2), high bits (u4).
The segment row also holds the document ids, their sizes and how many ids its shard holds before it. Segments are written by Spark's own committer, so a lost
executor leaves no torn file.

Null and empty texts hold only the end id. Null ids come first; rows with equal ids are ordered by text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path
from .bpe import CONTRACTIONS, byte_letters
from .common import BLANK, LETTER, NOT_LATIN, NUMBER, prepared, slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 2
BLOCK = 512
FITS = 0.9
SEGMENT = 1 << 18
MEMO = 300_000
HEAD = np.dtype([("offset", "<u4"), ("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])

#: The most frequent kind first: of the kinds only contractions and other signs can begin alike.
_WORDS = re.compile(f"[{LETTER}]+|[{NUMBER}]|{CONTRACTIONS}|[^{BLANK}{LETTER}{NUMBER}]+")
_ASCII_WORDS = re.compile(rf"[a-z]+|[0-9]|{CONTRACTIONS}|[^\t-\r a-z0-9]+")  # the same for lower-case ASCII


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    specials = [t.content for t in made.get_added_tokens_decoder().values()]
    return made, specials


@lru_cache(1)
def _letters() -> dict[int, str]:
    return {b: c for c, b in byte_letters().items()}


def latin_words(text: str) -> list[str]:
    """The words of a Latin text, in lower case."""
    return (_ASCII_WORDS if text.isascii() else _WORDS).findall(text.lower())


def encode_texts(texts: list[str | None], memo: dict[str, bytes], path: str = VOCABULARY) -> list[np.ndarray]:
    """Ids of each text as the tokenizer gives them; ``memo`` is the task's own.

    Latin texts are cut here, and each word not in the memo goes to the tokenizer's model in byte letters; its
    normalisation leaves such words as they are once they are in lower case.
    """
    made, specials = _tokenizer(path)
    out: list[np.ndarray | None] = [None] * len(texts)
    split: dict[int, list[str]] = {}
    for k, text in enumerate(texts):
        if not text:
            out[k] = np.zeros(0, np.uint32)
        elif NOT_LATIN.search(text) or any(s in text for s in specials):
            out[k] = np.array(made.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            split[k] = latin_words(text)
    fresh = set().union(*split.values()).difference(memo)
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = set().union(*split.values())
    tokens, letters = made.model.tokenize, _letters()
    for word in fresh:
        plain = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(letters)
        memo[word] = array("I", [t.id for t in tokens(plain)]).tobytes()
    get = memo.__getitem__
    for k, found in split.items():
        out[k] = np.frombuffer(b"".join(map(get, found)), "<u4")
    return out


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """The payload of a segment."""
    count = -(-len(ids) // BLOCK)
    padded = np.zeros(count * BLOCK, np.int64)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    rows = padded.reshape(count, BLOCK)
    least = rows.min(axis=1) if count else np.zeros(0, np.int64)
    rest = rows - least[:, None]
    at = int(FITS * BLOCK) - 1
    width = _widths(np.partition(rest, at, axis=1)[:, at]) if count else least
    high = rest >> width[:, None]
    many = (high > 0).sum(axis=1)
    packed_size = width * BLOCK // 8
    size = packed_size + many * 6
    head = np.zeros(count, HEAD)
    base = 8 + HEAD.itemsize * count
    head["offset"] = base + np.cumsum(size) - size
    head["least"], head["width"], head["exceptions"] = least, width, many
    out = np.zeros(base + int(size.sum()), np.uint8)
    out[:8] = np.array([count, len(ids)], "<u4").view(np.uint8)
    out[8:base] = head.view(np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            low = rest[own].astype("<u4").view(np.uint8).reshape(-1, 4)
            bits = np.unpackbits(low, axis=1, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            place = head["offset"][own].astype(np.int64)[:, None] + np.arange(packed.shape[1])
            out[place] = packed
    for k in np.flatnonzero(many):
        at = np.flatnonzero(high[k])
        a = int(head["offset"][k]) + int(packed_size[k])
        out[a : a + 2 * len(at)] = at.astype("<u2").view(np.uint8)
        out[a + 2 * len(at) : a + 6 * len(at)] = high[k][at].astype("<u4").view(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` up to, but not including, ``last`` of a segment."""
    raw = np.frombuffer(payload, np.uint8)
    count, total = np.frombuffer(payload, "<u4", 2).tolist()
    last = count if last is None else min(last, count)
    head = np.frombuffer(payload, HEAD, count, 8)[first:last]
    rows = np.zeros((len(head), BLOCK), np.int64)
    width = head["width"].astype(np.int64)
    offset = head["offset"].astype(np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            packed = raw[offset[own][:, None] + np.arange(int(w) * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, int(w))
            rows[own] = bits @ (1 << np.arange(int(w), dtype=np.int64))
    for k in np.flatnonzero(head["exceptions"]):
        n = int(head["exceptions"][k])
        a = int(offset[k]) + int(width[k]) * BLOCK // 8
        at = raw[a : a + 2 * n].view("<u2").astype(np.int64)
        rows[k, at] |= raw[a + 2 * n : a + 6 * n].view("<u4").astype(np.int64) << width[k]
    rows += head["least"].astype(np.int64)[:, None]
    return rows.ravel()[: total - first * BLOCK].astype(np.uint32)


SEGMENTS = "shard int, first long, ids array<long>, sizes array<long>, payload binary"
SEGMENTS_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("first", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def _write_step(path: str, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        memo: dict[str, bytes] = {}
        total = 0

        def close() -> pa.RecordBatch:
            row = {
                "shard": [shard], "first": [first], "ids": [list(ids)], "sizes": [[len(h) for h in held]],
                "payload": [pack(np.concatenate(held))],
            }
            return pa.RecordBatch.from_pydict(row, SEGMENTS_ARROW)

        for batch in slices(batches, "text", 1 << 20):
            for doc, found in zip(batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist(), memo, path)):
                found = found if end is None else np.append(found, np.uint32(end))
                if held and total + len(found) > SEGMENT:
                    yield close()
                    first, total = first + total, 0
                    ids, held = [], []
                ids.append(doc)
                held.append(found)
                total += len(found)
        if held:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    end: int | None = END,
) -> None:
    """Encode all texts and write their segments in ascending order of the id; shard numbers follow that order."""
    ordered = (
        prepared(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(_write_step(vocabulary, end), SEGMENTS).write.option("compression", "uncompressed").parquet(path)


READ = "shard int, doc_id long, at long, tokens binary"


def _read_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            ids = unpack(row["payload"])
            ends = np.cumsum(row["sizes"])
            starts = ends - np.array(row["sizes"], np.int64)
            n = len(ends)
            data = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()),
                    pa.array(starts + row["first"], pa.int64()),
                    pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                ],
                names=["shard", "doc_id", "at", "tokens"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), tokens (little-endian 32-bit ids)."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, n: total + n)
    # one row per shard, that is at most one per partition of the write
    totals = sorted(map(tuple, files.groupBy("shard").agg(F.sum(size)).collect()))
    first = np.cumsum([0, *(n for _, n in totals)]).tolist()
    base = spark.createDataFrame([(s, b) for (s, _), b in zip(totals, first)], "shard int, base long")
    return (
        files.mapInArrow(_read_step, READ).join(F.broadcast(base), "shard")
        .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "tokens")
    )


def token_file_path(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
