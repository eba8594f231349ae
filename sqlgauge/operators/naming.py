"""Table names in SQL text: letter case, references, fuzzy repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import two_best_matches
from ..functions.textops import (
    QUOTED,
    let,
    longest_first,
    map_unquoted,
    replacement_literal,
    replace_word_any_case,
    respell_words,
    strip,
    weave,
)
from ..session import ship_package

# The keywords before a table name, and the form of the name.
_REFERENCE = r"\b(?:from|join|update|into|delete\s+from)\b\s+`?[A-Za-z_]\w*`?"
_QUOTED_OR_REFERENCE = f"(?iU){QUOTED}|{_REFERENCE}"
_WORDS = r"(?U)\w+|\W+"
_WORDS_OR_QUOTED = QUOTED + "|[A-Za-z0-9_]+|[^A-Za-z0-9_'\"]+|['\"]"
_LAST_NAME = r"(?U)([A-Za-z_]\w*)(`?)$"
MATCHES = "array<struct<best:string,ratio:double,second:double>>"


def _plain(tables: Column) -> Column:
    """All names are made of ASCII word characters, so whole words can be looked up instead of searched for."""
    return F.forall(tables, lambda t: t.rlike("^[A-Za-z0-9_]+$"))


def table_case_naive(sql: Column, tables: Column) -> Column:
    """Every known table name, whole word, any case, also inside quotes, to its schema spelling."""
    searched = F.aggregate(
        tables, sql, lambda done, t: replace_word_any_case(done, t, ascii_bounds=False)
    )
    return strip(F.when(_plain(tables), respell_words(sql, tables, _WORDS)).otherwise(searched))


def table_case(sql: Column, tables: Column) -> Column:
    """As above but only outside quotes, longest names first."""
    searched = map_unquoted(
        sql,
        lambda part: F.aggregate(
            longest_first(tables, lambda t: t),
            part,
            lambda done, t: replace_word_any_case(done, t, ascii_bounds=True),
        ),
    )
    return F.when(_plain(tables), respell_words(sql, tables, _WORDS_OR_QUOTED)).otherwise(searched)


def _reference_name(match: Column) -> Column:
    return F.regexp_extract(match, _LAST_NAME, 1)


def _is_reference(match: Column) -> Column:
    return ~match.rlike("^['\"]")


def table_references(sql: Column) -> Column:
    """Identifiers after FROM, JOIN, UPDATE, INTO and DELETE FROM outside quotes, in order."""
    found = F.regexp_extract_all(sql, F.lit(_QUOTED_OR_REFERENCE), F.lit(0))
    return F.transform(F.filter(found, _is_reference), _reference_name)


def exact_match(token: Column, tables: Column, lower: Column) -> Column:
    """Exact match in any case (1.0) or after one final ``s`` is dropped (0.99), else null.

    ``lower`` holds the lower-case spellings of ``tables``.
    """
    low = F.lower(token)

    def result(at: Column, ratio: float) -> Column:
        best = F.get(tables, at.cast("int") - 1)
        return F.struct(best.alias("best"), F.lit(ratio).alias("ratio"), F.lit(0.0).alias("second"))

    whole = F.array_position(lower, low)
    singular = F.array_position(lower, F.substring(low, F.lit(1), F.length(low) - 1))
    return F.when(whole > 0, result(whole, 1.0)).when(
        F.endswith(low, F.lit("s")) & (singular > 0), result(singular, 0.99)
    )


def match_tables(
    rows: DataFrame, tokens: str = "tokens", tables: str = "tables", out: str = "matches", min_ratio: float = 0.86
) -> DataFrame:
    """Add ``out``: for each token its best table, that ratio and the second-best ratio.

    Exact and plural matches stay native. Only what is left goes through the similarity function; below
    ``min_ratio`` a token stands for itself.
    """
    ship_package(rows.sparkSession)
    exact = let(
        F.transform(F.col(tables), lambda t: F.lower(t)),
        lambda lower: F.transform(F.col(tokens), lambda t: exact_match(t, F.col(tables), lower)),
    )
    rows = rows.withColumn("_exact", exact).withColumn(
        "_open",
        F.array_distinct(
            F.filter(
                F.zip_with(F.col(tokens), F.col("_exact"), lambda t, e: F.when(e.isNull(), F.lower(t))),
                lambda t: t.isNotNull(),
            )
        ),
    )
    rows = rows.withColumn(
        "_near",
        two_best_matches(F.col("_open"), F.when(F.size("_open") > 0, F.col(tables))),  # names travel only where asked for
    )

    def near(token: Column) -> Column:
        first = ((F.array_position(F.col("_open"), F.lower(token)) - 1) * 3).cast("int")
        at, ratio, second = (F.get(F.col("_near"), first + k) for k in range(3))
        best = F.when(ratio < min_ratio, token).otherwise(F.get(F.col(tables), at.cast("int")))
        return F.struct(best.alias("best"), ratio.alias("ratio"), second.alias("second"))

    matched = F.zip_with(F.col(tokens), F.col("_exact"), lambda t, e: F.coalesce(e, near(t)))
    return rows.withColumn(out, matched.cast(MATCHES)).drop("_exact", "_open", "_near")


def repair_table_names(
    rows: DataFrame,
    sql: str = "pred_sql",
    tables: str = "tables",
    out: str = "pred_sql",
    log: str = "pred_repairs",
    min_ratio: float = 0.86,
    min_gap: float = 0.03,
) -> DataFrame:
    """Replace table references by their best match and log the changes.

    A match that is neither near-exact nor clearly ahead of the second best is left alone. A reference that
    differs only in letter case is corrected without a log entry. Empty text or no tables: unchanged.
    """
    usable = (F.coalesce(F.col(sql), F.lit("")) != "") & (F.coalesce(F.size(F.col(tables)), F.lit(0)) > 0)
    rows = rows.withColumn(
        "_tokens",
        F.when(usable, table_references(F.col(sql))).otherwise(F.array().cast("array<string>")),
    )
    rows = match_tables(rows, "_tokens", tables, "_matches", min_ratio)

    def differs(token: Column, match: Column) -> Column:
        return F.lower(match["best"]) != F.lower(token)

    def unclear(match: Column) -> Column:
        return ((match["ratio"] - match["second"]) < min_gap) & (match["ratio"] < 0.99)

    fixes = F.zip_with(
        F.col("_tokens"),
        F.col("_matches"),
        lambda t, m: F.struct(
            t.alias("from"),
            F.when(differs(t, m) & unclear(m), t).otherwise(m["best"]).alias("to"),
            F.round(m["ratio"], 4).alias("ratio"),
        ),
    )
    rows = rows.withColumn("_fixes", fixes)
    found = F.regexp_extract_all(F.col(sql), F.lit(_QUOTED_OR_REFERENCE), F.lit(0))
    # Position of the n-th reference among the matches, so that it takes the n-th fix.
    at = F.filter(
        F.transform(found, lambda m, i: F.when(_is_reference(m), i)), lambda i: i.isNotNull()
    )

    def mended(match: Column, i: Column) -> Column:
        fix = F.get(F.col("_fixes"), (F.array_position(at, i) - 1).cast("int"))
        renamed = F.regexp_replace(
            match, _LAST_NAME, F.concat(replacement_literal(fix["to"]), F.lit("$2"))
        )
        return F.when(_is_reference(match), renamed).otherwise(match)

    whole = weave(F.split(F.col(sql), _QUOTED_OR_REFERENCE, -1), F.transform(found, mended))
    renamed = F.exists("_fixes", lambda x: ~x["from"].eqNullSafe(x["to"]))
    changes = F.filter(F.col("_fixes"), lambda x: F.lower(x["from"]) != F.lower(x["to"]))
    kept = [c for c in rows.columns if c not in (out, log, "_tokens", "_matches", "_fixes")]
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(usable & renamed, whole).otherwise(F.col(sql)).alias(out),
        changes.alias(log),
    )


def clean_prediction(
    rows: DataFrame, raw: str = "pred_sql_raw", tables: str = "tables", repair: bool = True
) -> DataFrame:
    """Add ``pred_sql`` and ``pred_repairs``: naive case fix, quote-aware case fix, then name repair."""
    names = F.coalesce(F.col(tables), F.array().cast("array<string>"))
    fixed = rows.withColumn("pred_sql", let(table_case_naive(F.col(raw), names), lambda sql: table_case(sql, names)))
    return repair_table_names(fixed, "pred_sql", tables) if repair else fixed


def repair_rows(rows: DataFrame, keys: list[str], log: str = "pred_repairs") -> DataFrame:
    """One row per logged repair with its position."""
    return rows.select(*keys, F.posexplode(log).alias("pos", "_r")).select(*keys, "pos", "_r.*")
