"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

Texts are split as the tokenizer file says. The distinct words of a batch form a trie; a depth-first walk keeps, for
the path of bytes walked so far, the last token of each prefix's encoding. The last token of a longer prefix is the one
token that ends it and may follow the last token of what stands before it, so shared prefixes are encoded once, and a
word's tokens are read off backward along its path. A task keeps the words it has seen in a bounded memo.

Null and empty texts encode to no tokens and decode to an empty text. Rows are judged one by one; further columns pass
through.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import NOT_LATIN, extended, latin_pattern, lists, prepared, slices, tidy, with_columns

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
BATCH_BYTES = 1 << 20
MEMO = 400_000
PAIRS = 300_000


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words (bytes) with the merges of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        vocabulary = held["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.ids = {raw(token): number for token, number in vocabulary.items()}
        self.bytes = {number: token for token, number in self.ids.items()}
        self.bytes |= {number: text.encode() for text, number in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = rank, vocabulary[left + right]
        #: Rank and the two parts of each token that a merge makes.
        self.made = {token: (rank, left, right) for (left, right), (rank, token) in self.merges.items()}
        self.longest = max(map(len, self.ids))
        self.joins: dict[int, bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when they stand side by side.

        Time runs backward from the finished pair: the part at the border that was merged last is taken apart. A
        merge over the border would have come first if its rank is lower than that of the part now undone, or equal
        and the part lies to the right, as equal ranks are merged from the left.
        """
        key = left << 32 | right
        known = self.joins.get(key)
        if known is not None:
            return known
        if len(self.joins) > PAIRS:
            self.joins.clear()
        never = (1 << 60, 0)
        limit = 1 << 60
        while True:
            if self.merges.get((left, right), never)[0] < limit:
                known = False
                break
            mine, other = self.made.get(left), self.made.get(right)
            if mine is None and other is None:
                known = True
                break
            if other is None or (mine is not None and mine[0] > other[0]):
                limit, left = mine[0], mine[2]
            else:
                limit, right = other[0] + 1, other[1]
        self.joins[key] = known
        return known

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Depth-first over the trie of the words: sorted order visits it, common prefixes stay on the path."""
        out: dict[bytes, list[int]] = {}
        ids, joins, longest = self.ids.get, self.joins.get, self.longest
        last: list[int] = []  # last token of the encoding of each prefix on the path
        size: list[int] = []
        path = b""
        for word in sorted(set(words)):
            n = len(word)
            shared = 0
            most = min(len(path), n)
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, n + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):  # only one fits, and most are short
                    token = ids(word[start:end])
                    if token is None:
                        continue
                    if start:
                        before = last[start - 1]
                        fits = joins(before << 32 | token)
                        if not (self.may_follow(before, token) if fits is None else fits):
                            continue
                    last.append(token)
                    size.append(end - start)
                    break
            tokens, end = [], n
            while end:
                tokens.append(last[end - 1])
                end -= size[end - 1]
            tokens.reverse()
            out[word] = tokens
            path = word
        return out


@lru_cache(2)
def _encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


@lru_cache(2)
def _splitter(path: str):
    """The file's own splitting, for texts outside the Latin blocks."""
    return Tokenizer.from_file(path).pre_tokenizer


CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = latin_pattern(CONTRACTIONS, " ?", "+", True)


def split_words(text: str, path: str) -> list[str]:
    """Words of a text between special tokens, as byte-level splitting gives them."""
    if not NOT_LATIN.search(text):
        return _WORDS.findall(text)
    return [text[a:b] for _, (a, b) in _splitter(path).pre_tokenize_str(text)]


def _codes(texts: list[str | None], path: str, memo: dict[str, bytes]) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers."""
    encoder = _encoder(path)
    special = [s for s in encoder.special if s]
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    split: list[list[str]] = []
    for text in texts:
        if not text:
            split.append([])
        elif cut and any(s in text for s in special):
            # odd parts are special tokens; marked with a surrogate, which no text can hold
            parts = cut.split(text)
            split.append([w for k, part in enumerate(parts) if part for w in (["\ud800" + part] if k % 2 else split_words(part, path))])
        else:
            split.append(split_words(text, path))
    fresh = set(chain.from_iterable(split)).difference(memo)
    if fresh:
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = set(chain.from_iterable(split))
        plain = [w for w in fresh if w[0] != "\ud800"]
        found = encoder.encode([w.encode() for w in plain])
        for w in plain:
            memo[w] = array("I", found[w.encode()]).tobytes()
        for w in fresh:
            if w[0] == "\ud800":
                memo[w] = np.array([encoder.special[w[1:]]], "<u4").tobytes()
    get = memo.__getitem__
    return [b"".join(map(get, w)) for w in split]


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = _encoder(path).bytes
    parts = [held.get(k, b"") for k in range(max(held) + 1)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def forget() -> None:
    """Let go of what a worker holds of a vocabulary; workers outlive their tasks."""
    for held in (_encoder, _splitter, _token_bytes):
        held.cache_clear()


def decode_ids(ids: np.ndarray, bounds: np.ndarray, path: str = VOCABULARY) -> list[str]:
    """Texts of the id ranges between ``bounds``; bytes that are no UTF-8 become the replacement character."""
    data, start, size = _token_bytes(path)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = ids[a:b]
        n = size[own]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first - start[own], n)
        out.append(data[place].tobytes().decode("utf-8", "replace"))
    return out


def _encode_step(path: str, text_col: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bytes] = {}
        try:
            for batch in slices(batches, text_col, BATCH_BYTES):
                codes = _codes(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), path, memo)
                sizes = np.array([len(c) // 4 for c in codes], np.int64)
                ids = np.frombuffer(b"".join(codes), "<u4").view(np.int32)
                extra = {"_ids": lists(pa.array(ids, pa.int32()), sizes)}
                if decoded:
                    extra["_decoded"] = pa.array(decode_ids(ids, np.cumsum([0, *sizes]), path), pa.string())
                yield with_columns(batch, extra)
        finally:
            memo.clear()
            forget()

    return run


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, decoded: bool = False) -> DataFrame:
    """All columns plus _ids (array of int), and _decoded (the text read back from the ids) if asked for."""
    fields = "_ids array<int>" + (", _decoded string" if decoded else "")
    docs = prepared(docs, fields)
    return docs.mapInArrow(tidy(_encode_step(vocabulary, text_col, decoded)), extended(docs.schema, fields))


def decode(encoded: DataFrame, ids_col: str = "_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns plus _decoded, the text of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(ids_col))
                sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0))
                ids = np.asarray(column.flatten()).astype(np.int64)
                yield with_columns(batch, {"_decoded": pa.array(decode_ids(ids, np.cumsum([0, *sizes]), vocabulary), pa.string())})
        finally:
            forget()

    encoded = prepared(encoded, "_decoded string")
    return encoded.mapInArrow(tidy(run), extended(encoded.schema, "_decoded string"))
