import re

import pytest

from sqlgauge.llm import license_scan as L
from sqlgauge.llm.queries import QUERIES

from .helpers import doc_rows, write_tables

TEXTS = [
    None, "", "no notice at all", "The MIT License. mit-license, MIT license's", "CC-BY 4.0 and cc by cc by",
    "GNU General Public License gnu general  public\nlicense", "Apache  LICENSE apache é license apachelicense",
    "Licensed under CC BY-NC 4.0.", "word " * 30000 + "MIT license", "ÀMIT license", "mit licenseé",
]


def expected(rows):
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
        hits = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k : k + len(p)]) == p)
        starts = [k for k, _ in hits]
        out.append((i, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
    return sorted(out, key=str)


def test_base_equals_brute_force(spark, tmp_path):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[4])]
    write_tables(spark, tmp_path, documents=doc_rows(spark, rows))
    got = QUERIES["op5_license_scan"](spark, str(tmp_path))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert got.columns[:8] == [*names, "labels", "score"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == expected(rows)
    for row in got.collect():
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
        assert row["labels"] == ",".join(sorted(filter(None, set(row["labels"].split(",")))))


@pytest.mark.parametrize("text,label,edits,span", [
    ("xx released undr the mit licence yy", "mit", 2, (1, 6)),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", 0, (0, 7)),
    ("licensed  under the Apache-licens version 2.0", "apache", 1, (0, 8)),
    ("Thiswork is licensed under the GNU Generl Public License v3, version 3", "gpl", None, None),
    ("one GNU Lesser General Public License two", "lgpl", 0, (1, 6)),
    ("released in the meat locker", None, None, None),
])
def test_notices_with_edits(spark, text, label, edits, span):
    (row,) = L.scan(doc_rows(spark, [(1, text)])).collect()
    assert [m["label"] for m in row["_matches"]] == ([label] if label else [])
    if span:
        m = row["_matches"][0]
        assert (m["edits"], m["start"], m["end"]) == (edits, *span)


def test_many_notices_in_one_text(spark):
    text = "Released under the MIT License. " * 4000 + "x " + "Licensed under CC BY-SA 4.0. " * 3000
    (row,) = L.scan(doc_rows(spark, [(1, text)])).collect()
    assert [m["label"] for m in row["_matches"]] == ["mit"] * 4000 + ["cc-by-sa"] * 3000
    assert [(m["start"], m["end"]) for m in row["_matches"][3999:4001]] == [(19995, 20000), (20001, 20008)]
    assert len(row["_places"]) == 7000 and row["_places"][-1]["start"] == 20001 + 7 * 2999 + 2


def test_pieces_miss_no_match():
    import regex

    notices = L.Notices()
    text = " released uder the mt license and liCensed under cc by 4 0 permission is herby granted fre of charge to any person obtaining a copy "
    for number, (notice, _) in enumerate(notices.notices):
        whole = regex.search(f"(?:{notice}){{e<={notices.edits[number]}}}", text)
        assert bool(whole) == any(notices.patterns[number].search(text, a, b) for a, b in notices.windows(text).get(number, []))


def test_empty_table(spark, tmp_path):
    write_tables(spark, tmp_path, documents=doc_rows(spark, []))
    assert QUERIES["op5_license_scan"](spark, str(tmp_path)).count() == 0
