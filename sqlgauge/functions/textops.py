"""Text helpers as Column expressions: quote-aware segments, token replacement, line splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A single- or double-quoted literal; doubled quotes stay inside it. Possessive runs keep long
# literals from exhausting the matcher's stack.
QUOTED = r"'[^']*+(?:''[^']*+)*'" + '|"[^"]*+(?:""[^"]*+)*"'
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
_META = r"([\\.\[\]{}()*+?^$|#&\-~])"


def strip(text: Column) -> Column:
    """Trim whitespace of any kind on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """Trimmed non-blank lines, in order; null text has none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1), strip)
    return F.filter(parts, lambda line: line != "")


def regex_literal(text: Column) -> Column:
    """Escape regex metacharacters."""
    return F.regexp_replace(text, _META, r"\\$1")


def replacement_literal(text: Column) -> Column:
    """Escape the characters that are special in a regex replacement."""
    return F.regexp_replace(text, r"([\\$])", r"\\$1")


def replace_token(text: Column, token: Column, value: Column) -> Column:
    """Replace ``token`` where it is not part of a longer ``[A-Za-z0-9_]`` run."""
    pattern = F.concat(F.lit("(?<![A-Za-z0-9_])"), regex_literal(token), F.lit("(?![A-Za-z0-9_])"))
    replaced = F.regexp_replace(text, pattern, replacement_literal(value))
    return F.when(F.contains(text, token), replaced).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, with ``value`` computed once per row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def respell_words(text: Column, words: Column, pieces: str) -> Column:
    """Replace every word that equals one of ``words`` in any letter case by that word.

    The pattern ``pieces`` cuts a text into words and what stands between them, without gaps. Of several spellings of one
    word the last one is taken.
    """
    words = F.reverse(words)

    def known(names: Column) -> Column:
        def spelled(token: Column) -> Column:
            return F.coalesce(F.get(words, F.array_position(names, F.lower(token)).cast("int") - 1), token)  # position -1 gives null

        # extracted, as a split would compile its pattern again for every row
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), spelled), "")

    return let(F.transform(words, lambda w: F.lower(w)), known)


def replace_word_any_case(text: Column, word: Column, ascii_bounds: bool) -> Column:
    """Replace whole words in any letter case with the given spelling.

    ``ascii_bounds`` uses ``[A-Za-z0-9_]`` neighbours as the boundary, otherwise the regex word boundary.
    """
    if ascii_bounds:
        pattern = F.concat(
            F.lit("(?iu)(?<![A-Za-z0-9_])"), regex_literal(word), F.lit("(?![A-Za-z0-9_])")
        )
    else:
        pattern = F.concat(F.lit(r"(?iuU)\b"), regex_literal(word), F.lit(r"\b"))
    replaced = F.regexp_replace(text, pattern, replacement_literal(word))
    return F.when(F.contains(F.lower(text), F.lower(word)), replaced).otherwise(text)


def longest_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """Order an array by descending key length, keeping the given order among equals."""
    tagged = F.transform(
        items,
        lambda item, i: F.struct((-F.length(key(item))).alias("size"), i.alias("at"), item.alias("item")),
    )
    return F.transform(F.array_sort(tagged), lambda t: t["item"])


def unquoted(text: Column) -> Column:
    """Segments outside quotes; one more than there are quoted literals."""
    return F.split(text, QUOTED, -1)


def quoted(text: Column) -> Column:
    """The quoted literals, in order."""
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))


def weave(outside: Column, between: Column) -> Column:
    """Join ``outside[0] + between[0] + outside[1] + ...``; ``outside`` is one longer."""
    pairs = F.zip_with(outside, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def map_unquoted(text: Column, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to every segment outside quotes."""
    return weave(F.transform(unquoted(text), change), quoted(text))
