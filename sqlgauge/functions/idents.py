"""Identifier tokens, a small suffix stemmer and the question stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as question tokens.
STOPWORDS = (
    "a an the all any from to of in on at for with and or is are was were be been do does did "
    "list show give get find what which who where when how many much"
).split()

# The borders inside a name.
_BORDERS = (r"([a-z])([A-Z])", r"(\D)(\d)", r"(\d)(\D)")


def split_identifier(text: Column) -> Column:
    """Alphanumeric runs after breaking at underscores, case changes and digit borders."""
    spaced = F.replace(text, F.lit("_"), F.lit(" "))
    for pattern in _BORDERS:
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    return F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), F.lit(0))


def stem(token: Column) -> Column:
    """Drop one suffix: ing, ed, es or s, the first that fits."""
    size = F.length(token)

    def without(n: int) -> Column:
        return F.substring(token, F.lit(1), size - n)

    return (
        F.when((size > 4) & F.endswith(token, F.lit("ing")), without(3))
        .when((size > 3) & F.endswith(token, F.lit("ed")), without(2))
        .when((size > 3) & F.endswith(token, F.lit("es")), without(2))
        .when((size > 2) & F.endswith(token, F.lit("s")), without(1))
        .otherwise(token)
    )


def question_tokens(text: Column) -> Column:
    """Stemmed question words in order, stopwords dropped, repeats kept."""
    words = split_identifier(F.lower(text))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOPWORDS)), stem)


def identifier_tokens(name: Column) -> Column:
    """Distinct stemmed lower-case tokens of a table or column name."""
    words = F.transform(split_identifier(name), lambda w: F.lower(w))
    return F.array_distinct(F.transform(words, stem))
