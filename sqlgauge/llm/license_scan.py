"""License scans: exact phrases, and a fuzzy search for short notices.

A text is taken as its words with single blanks between them. A notice of n characters may differ by ``n // EDITS``
edits. It is split into one piece more than it may have edits, so one piece at least stands in any match unchanged;
all pieces of all notices are found in one pass, and around each the regex library's bounded-error matching decides and
reports the span. Of overlapping matches the one with the smallest share of edits stays, then the longer.

Null and empty texts have no words. Rows are judged one by one; further columns pass through.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, extended, lists, prepared, slices, with_columns

#: Fixed phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, as words, and their labels.
NOTICES = (
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
EDITS = 12


class Notices:
    """The pieces of all notices in one automaton, and a bounded-error pattern for each notice."""

    def __init__(self, notices=NOTICES, edits: int = EDITS) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.edits = [max(1, len(text) // edits) for text, _ in notices]
        self.patterns = [
            regex.compile(f"(?e)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={k}}}")
            for (text, _), k in zip(notices, self.edits)
        ]
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, ((text, _), k) in enumerate(zip(notices, self.edits)):
            cuts = np.linspace(0, len(text), k + 2).astype(int).tolist()
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((number, a))
        self.finder = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.finder.add_word(piece, (len(piece), places))
        self.finder.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each notice the stretches of text, united, that a match through one of its pieces may cover."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.finder.iter(text):
            for number, offset in places:
                k = self.edits[number]
                start = max(0, end + 1 - size - offset - k)
                stop = start + len(self.notices[number][0]) + 2 * k + 1
                held = found.setdefault(number, [])
                if held and start <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], stop)
                else:
                    held.append([start, stop])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """Start, end, number of the notice and edits of the matches that stay."""
        found = []
        for number, held in self.windows(text).items():
            for start, stop in held:
                for m in self.patterns[number].finditer(text, start, min(stop, len(text))):
                    found.append((sum(m.fuzzy_counts) / len(self.notices[number][0]), m.start() - m.end(), m.start(), m.end(), number, sum(m.fuzzy_counts)))
        kept: list[tuple[int, int, int, int]] = []  # by start, never overlapping
        for _, _, start, end, number, edits in sorted(found):
            at = bisect(kept, (start, end, number, edits))
            if (not at or kept[at - 1][1] <= start) and (at == len(kept) or kept[at][0] >= end):
                kept.insert(at, (start, end, number, edits))
        return kept


@lru_cache(1)
def _notices() -> Notices:
    return Notices()


def phrase_places(text: str) -> list[tuple[int, int, str]]:
    """First and last word (end exclusive) of every place of a fixed phrase; ``text`` has blanks at both ends."""
    out = []
    for phrase, label in PHRASES.items():
        at, word, counted = text.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, counted = word + text.count(" ", counted, at), at
            out.append((word, word + phrase.count(" ") + 1, label))
            at = text.find(f" {phrase} ", at + 1)
    return sorted(out)


PLACE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("score", pa.float64())])
FIELDS = (
    "_words long, _places array<struct<start: long, end: long, label: string>>, "
    "_matches array<struct<start: long, end: long, label: string, edits: long, score: double>>"
)


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    flat = [r for own in rows for r in own]
    columns = [pa.array([r[k] for r in flat], kind.field(k).type) for k in range(kind.num_fields)]
    values = pa.StructArray.from_arrays(columns, names=[kind.field(k).name for k in range(kind.num_fields)])
    return lists(values, np.array([len(own) for own in rows], np.int64))


def _step(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices = _notices()
        for batch in slices(batches, text_col, 2 << 20):
            words, places, matches = [], [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                found = WORD.findall(text.encode().lower()) if text else []
                plain = (b" " + b" ".join(found) + b" ").decode()
                words.append(len(found))
                places.append(phrase_places(plain) if found else [])
                own, word, counted = [], -1, 0
                for start, end, number, edits in notices.matches(plain) if found else ():
                    size = len(notices.notices[number][0])
                    start += plain[start:end].startswith(" ")
                    end -= plain[start:end].endswith(" ")
                    word, counted = word + plain.count(" ", counted, start), start
                    own.append((word, word + plain.count(" ", start, end) + 1, notices.notices[number][1], edits, 1 - edits / size))
                matches.append(own)
            yield with_columns(
                batch, {"_words": pa.array(words, pa.int64()), "_places": _structs(places, PLACE), "_matches": _structs(matches, MATCH)}
            )

    return run


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns plus _words, _places (fixed phrases) and _matches (notices); spans count words."""
    docs = prepared(docs, FIELDS)
    return docs.mapInArrow(_step(text_col), extended(docs.schema, FIELDS))
