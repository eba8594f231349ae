"""Placeholder filling for questions and gold SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import longest_first, replace_token


def fill_tokens(text: Column, variables: Column, skip_null: bool = False) -> Column:
    """Replace whole-token placeholders, longest names first, one after the other.

    A null value becomes the text "None", or leaves its placeholder when ``skip_null`` is set.
    """
    entries = F.map_entries(variables)
    if skip_null:
        entries = F.filter(entries, lambda e: e["value"].isNotNull())
    filled = F.aggregate(
        longest_first(entries, lambda e: e["key"]),
        text,
        lambda done, e: replace_token(done, e["key"], F.coalesce(e["value"], F.lit("None"))),
    )
    return F.coalesce(filled, text)


def fill_substrings(text: Column, variables: Column) -> Column:
    """Plain substring replacement in map order."""
    filled = F.aggregate(
        F.map_entries(variables),
        text,
        lambda done, e: F.replace(done, e["key"], F.coalesce(e["value"], F.lit("None"))),
    )
    return F.coalesce(filled, text)


def merge_variables(sentence: Column, entry: Column) -> Column:
    """Sentence values win; entry examples fill the missing names; nameless entries are skipped.

    ``sentence`` is ``map<string,string>``, ``entry`` is ``array<struct<name,example>>``.
    """
    own = F.coalesce(sentence, F.create_map().cast("map<string,string>"))
    named = F.filter(
        F.coalesce(entry, F.array().cast("array<struct<name:string,example:string>>")),
        lambda v: (F.coalesce(v["name"], F.lit("")) != "") & ~F.map_contains_key(own, v["name"]),
    )
    names = F.transform(named, lambda v: v["name"])
    first = F.filter(named, lambda v, i: F.array_position(names, v["name"]) == i + 1)
    return F.map_concat(own, F.map_from_entries(first))
