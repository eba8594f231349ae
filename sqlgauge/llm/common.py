"""Small helpers the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ship_package

#: Words of lower-cased UTF-8: ASCII digits and letters, and every byte of a non-ASCII character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


#: Bytes of an Arrow batch between Spark and Python where the session does not say: they count twice on each side.
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; none for null."""
    return WORD.findall(text.encode().lower()) if text else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepared(docs: DataFrame, added: str = "") -> DataFrame:
    """``docs`` for an operator with Python steps: the package is shipped, Arrow batches are bounded in bytes, and
    columns with the names of those that are added (the DDL text ``added``) give way."""
    spark = docs.sparkSession
    ship_package(spark)
    if spark.conf.get(BATCH_SETTING, None) is None:  # by rows alone a batch of long texts has no bound
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs.drop(*T.StructType.fromDDL(added).names) if added else docs


def extended(schema: T.StructType, extra: str) -> T.StructType:
    """``schema`` plus the columns of the DDL text ``extra``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(extra).fields])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``limit`` bytes of text, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        size = np.asarray(pa.compute.binary_length(batch.column(at)).fill_null(0).cast(pa.int64()))
        piece = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def give_back() -> None:
    """Return freed memory to the system; the allocators of a worker would keep it, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``step`` over the batches of a task, after which the worker gives its freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """A list array whose rows take ``sizes`` values each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at ``starts`` and hold ``sizes`` numbers."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(first - starts, sizes)


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unite overlapping and touching ranges within each group; sorted by group and start."""
    if not len(group):
        return group, start, end
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    base = (group.astype(np.int64) - group.min()) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    fresh = np.ones(len(group), bool)
    fresh[1:] = (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(group)) - 1
    return group[first], start[first], (reach - base)[last]


# --- splitting of Latin texts ------------------------------------------------------------------------------------


def _class(kinds: str, below: int = 0x300) -> str:
    """A character class of all characters under ``below`` whose Unicode category begins with one of ``kinds``."""
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] in kinds)


#: Characters up to U+02FF have had their categories for long, so a fast pattern splits them as any library does.
NOT_LATIN = re.compile("[^\x00-˿]")
BLANK = "\t-\r \x85\xa0"
LETTER, NUMBER = _class("L"), _class("N")


def latin_pattern(contraction: str, space: str, number: str, blank: bool) -> re.Pattern:
    """Contractions, letters, numbers, other signs and, if asked for, blanks, in this order of preference."""
    parts = [contraction, f"{space}[{LETTER}]+", f"{space}[{NUMBER}]{number}", f"{space}[^{BLANK}{LETTER}{NUMBER}]+"]
    return re.compile("|".join(parts + ([f"[{BLANK}]+(?![^{BLANK}])", f"[{BLANK}]+"] if blank else [])))
