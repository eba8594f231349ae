"""Tolerant readers for booleans and numbers that logs spell in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import strip

# Accepted spellings.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]


_WORDS = "map({})".format(
    ", ".join([f"'{w}', true" for w in TRUE_WORDS] + [f"'{w}', false" for w in FALSE_WORDS])
)


def tolerant_boolean(value: Column, typed: bool = False) -> Column:
    """Boolean from its text form: a spelling from the lists in any case; other text, numbers too, is null.

    ``typed`` says that the column holds numbers: non-zero is true.
    """
    if typed:
        return value.cast("double") != 0
    text = value.cast("string")
    words = F.expr(_WORDS)
    return F.coalesce(F.try_element_at(words, text), F.try_element_at(words, F.lower(strip(text))))


def variant_set(value: Column) -> Column:
    """The record holds something other than null."""
    return value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))


def variant_boolean(value: Column) -> Column:
    """Boolean from a value that kept its JSON type: a boolean is itself, a number is true unless zero, a text is read as
    by ``tolerant_boolean``, anything else is null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), number != 0)
        .when(kind == "STRING", tolerant_boolean(F.try_variant_get(value, "$", "string")))
    )


_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$|(?i)^[+-]?inf(?:inity)?$"


def tolerant_number(value: Column) -> Column:
    """Double, or null when the text is no decimal number; NaN counts as no number."""
    text = strip(value.cast("string"))
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def true_or_false(value: Column) -> Column:
    """A flag with null read as false."""
    return F.coalesce(value, F.lit(False))
