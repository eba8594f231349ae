"""Byte-level BPE by a sentencepiece model that is written down from a rank file.

The model is serialised field by field: every token is a piece whose bytes are spelt as printable letters, its score is
the negative rank, normalisation is the identity. The library then joins the neighbours whose union has the lowest
rank, the leftmost first, which is what the ranks mean. Texts are cut into pre-tokens first and each is encoded by
itself; distinct pre-tokens of a batch are encoded once and a task remembers a bounded number of them, of which nothing
stays when the task ends. Decoding takes pieces back to letters and letters back to bytes.

A pre-token that is a token itself is always that token; tokens which the merges would not give are found when the
model is made and kept in a table beside it. The classes of letters, numbers and blanks in the cutting pattern are
asked from the rank files' own library, so that both know the same characters.

Null and empty texts have no tokens and decode to no bytes. Null ids decode to no bytes. Each row is judged by itself,
so ties and repeated rows are nothing special; further columns pass through, and those named like the added ones give way.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame

from .common import extended, lists, prepared, slices, with_columns

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BATCH_BYTES = 1 << 20
MEMO = 200_000
FAR = 0x10000
_IS_FAR = re.compile(f"[^\\x00-{chr(FAR - 1)}]").search


class Model(NamedTuple):
    """All that a task needs: the serialised pieces, the pattern and the tokens that merges do not give."""

    pieces: bytes
    ranks: np.ndarray
    near: str
    far: str
    whole: dict[str, int]


# --- byte letters and the model's bytes ---------------------------------------------------------------------------


@lru_cache(1)
def letters() -> str:
    """A printable letter for each byte: itself where it has a form, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in shown else chr(next(spare)) for b in range(256))


def spell(data: bytes) -> str:
    return data.decode("latin-1").translate(letters())


@lru_cache(1)
def _back() -> dict[int, int]:
    return {ord(c): b for b, c in enumerate(letters())}


def unspell(text: str) -> bytes:
    return text.translate(_back()).encode("latin-1")


def _number(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a message: bytes and messages carry their length, scores are single floats, others plain numbers."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


# Field numbers and kinds of the model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
NAME, DUMMY_PREFIX, EXTRA_SPACES, ESCAPED_SPACES = 1, 3, 4, 5


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A BPE model whose piece k is the token of the k-th lowest rank; the unknown piece comes last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    made = [_field(1, spell(t).encode()) + _field(2, -float(ranks[t])) + _field(3, NORMAL) for t in tokens]
    made.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    plain = b"".join(_field(k, 0) for k in (DUMMY_PREFIX, EXTRA_SPACES, ESCAPED_SPACES))
    parts = [_field(PIECES, m) for m in made]
    parts += [_field(TRAINER, _field(MODEL_TYPE, BPE)), _field(NORMALIZER, _field(NAME, b"identity") + plain)]
    return b"".join(parts)


# --- cutting ------------------------------------------------------------------------------------------------------


def _ranges(kind: str, top: int) -> str:
    """The characters under ``top`` of a class as the inside of a bracket, as the ranks' own library sees them."""
    bytes_only = {bytes([b]): b for b in range(256)}
    seer = tiktoken.Encoding(f"class {kind}", pat_str=kind, mergeable_ranks=bytes_only, special_tokens={})
    held = bytes(seer.encode_ordinary("".join(map(chr, chain(range(0xD800), range(0xE000, top)))))).decode()
    codes = np.array([ord(c) for c in held])
    cuts = np.flatnonzero(np.diff(codes) > 1)
    first, last = codes[np.append(0, cuts + 1)], codes[np.append(cuts, len(codes) - 1)]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(first.tolist(), last.tolist()))


@lru_cache(4)
def plain_pattern(pattern: str, top: int) -> str:
    r"""``pattern`` with \p{L}, \p{N}, \s and \S, also inside brackets, spelt out for the standard library.

    It cuts texts of characters under ``top`` only: brackets without the higher planes are searched far faster.
    """
    inner = {kind: _ranges(kind, top) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, depth = [], 0
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in inner:
            out.append(inner[part] if depth else f"[{inner[part]}]")
        elif part == r"\S":
            out.append(f"[^{inner[chr(92) + 's']}]")
        else:
            depth += (part == "[") - (part == "]")
            out.append(part)
    return "".join(out)


# --- the operator ---------------------------------------------------------------------------------------------------


@lru_cache(2)
def load(path: str = VOCABULARY, pattern: str = PATTERN) -> Model:
    """The model of a rank file (a token in base 64 and its rank per line), made on the driver; bounded by the file."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    if max(ranks.values()) >= 1 << 24:
        raise ValueError("ranks from 2^24 on have no exact score")
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = serialise(ranks)
    found = sentencepiece.SentencePieceProcessor(model_proto=pieces).encode([spell(t) for t in tokens])
    whole = {spell(t): ranks[t] for k, t in enumerate(tokens) if found[k] != [k]}
    return Model(pieces, np.array([ranks[t] for t in tokens], np.int32), *(plain_pattern(pattern, top) for top in (FAR, 0x110000)), whole)


class Coder:
    """Encodes and decodes in one task; ``close`` lets go of everything it remembers."""

    def __init__(self, model: Model) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.pieces)
        self.near, self.far = re.compile(model.near).findall, re.compile(model.far).findall
        self.ranks, self.whole = model.ranks, model.whole
        self.memo: dict[str, bytes] = {}
        pieces = [unspell(self.library.id_to_piece(k)) for k in range(len(model.ranks))]
        self.token = dict(zip(model.ranks.tolist(), pieces))

    def _learn(self, fresh: list[str]) -> None:
        spelt = [spell(w.encode()) for w in fresh]
        found = self.library.encode(spelt)
        ends = np.cumsum([len(ids) for ids in found]) * 4
        flat = self.ranks[np.fromiter(chain.from_iterable(found), np.int64)].astype("<i4").tobytes()
        start = 0
        for word, end in zip(fresh, ends.tolist()):
            self.memo[word] = flat[start:end]
            start = end
        if self.whole:
            for word, letter_form in zip(fresh, spelt):
                if letter_form in self.whole:
                    self.memo[word] = np.array([self.whole[letter_form]], "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        split = [(self.far if _IS_FAR(t) else self.near)(t) if t else [] for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO:
            self.memo = {}
            fresh = set(chain.from_iterable(split))
        if fresh:
            self._learn(list(fresh))
        get = self.memo.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def close(self) -> None:
        self.memo, self.token, self.library = {}, {}, None


def encode(
    docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, decoded: bool = False
) -> DataFrame:
    """All columns plus _ids (array of int), and _decoded (the bytes read back from the ids) if asked for."""
    fields = "_ids array<int>" + (", _decoded binary" if decoded else "")
    docs, model = prepared(docs, fields), load(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        try:
            for batch in slices(batches, text_col, BATCH_BYTES):
                codes = coder.encode(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
                ids = np.frombuffer(b"".join(codes), "<i4")
                extra = {"_ids": lists(pa.array(ids, pa.int32()), np.array([len(c) // 4 for c in codes], np.int64))}
                if decoded:
                    back = [coder.decode(np.frombuffer(c, "<i4").tolist()) for c in codes]
                    extra["_decoded"] = pa.array(back, pa.binary())
                yield with_columns(batch, extra)
        finally:
            coder.close()

    return docs.mapInArrow(run, extended(docs.schema, fields))


def decode(encoded: DataFrame, ids_col: str = "_ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """All columns plus _decoded, the bytes of each row's ids; an id without a token is an error."""
    encoded, model = prepared(encoded, "_decoded binary"), load(vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        try:
            for batch in batches:
                rows = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
                yield with_columns(batch, {"_decoded": pa.array([coder.decode(r or []) for r in rows], pa.binary())})
        finally:
            coder.close()

    return encoded.mapInArrow(run, extended(encoded.schema, "_decoded binary"))
