"""Features read from SQL text and model output with regular expressions; nothing is parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import let, lines, strip

# The end of the first FROM clause, and the two spellings of a schema line.
_SOURCES = (
    r"(?sU)\bFROM\b(.*?)(?:\bWHERE\b|\bGROUP\s+BY\b|\bHAVING\b|\bORDER\s+BY\b|\bLIMIT\b|\bUNION\b"
    r"|\bINTERSECT\b|\bEXCEPT\b|;|$)"
)
_PAREN_LINE = r"^([A-Za-z_]\w*)\s*\((.*)\)\s*$"
_COLON_LINE = r"^([A-Za-z_]\w*)\s*:\s*(.*)\s*$"


def from_source_count(sql: Column) -> Column:
    """Sources of the first FROM clause: comma items or joins plus one, whichever is larger."""
    upper = F.upper(sql)
    clause = F.regexp_replace(F.regexp_extract(upper, _SOURCES, 1), r"\([^()]*\)", " ")

    def counted(clause: Column) -> Column:
        commas = F.when(strip(clause) != "", F.regexp_count(clause, F.lit(",")) + 1).otherwise(0)
        joins = F.regexp_count(clause, F.lit(r"(?U)\bJOIN\b"))
        return F.greatest(commas, let(joins, lambda n: F.when(n > 0, n + 1).otherwise(0)))

    return let(clause, counted)


def sql_difficulty(sql: Column) -> Column:
    """Difficulty 1 to 4 from set operations, nested SELECTs, grouping and source count."""
    upper = F.upper(sql)
    counts = F.struct(
        (F.regexp_count(upper, F.lit(r"(?U)\bSELECT\b")) - 1).alias("nested"), from_source_count(sql).alias("sources")
    )
    set_op = F.contains(upper, F.lit("UNION")) | F.contains(upper, F.lit("INTERSECT")) | F.contains(
        upper, F.lit("EXCEPT")
    )

    def graded(n: Column) -> Column:
        nested, sources = n["nested"], n["sources"]
        return (
            F.when(set_op | (nested >= 2) | (sources >= 4), 4)
            .when((nested == 1) | F.contains(upper, F.lit("HAVING")) | (sources == 3), 3)
            .when(F.contains(upper, F.lit("GROUP BY")) | (sources == 2), 2)
            .otherwise(1)
        )

    return let(counts, graded)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping substring count."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def complexity_bucket(sql: Column) -> Column:
    """simple, medium or complex by JOIN and nested SELECT counts; empty text is unknown."""
    upper = F.upper(sql)
    joins = occurrences(upper, "JOIN")
    nested = F.greatest(occurrences(upper, "SELECT") - 1, F.lit(0.0))
    return (
        F.when(F.coalesce(sql, F.lit("")) == "", "unknown")
        .when((joins == 0) & (nested == 0), "simple")
        .when((joins <= 2) & (nested <= 1), "medium")
        .otherwise("complex")
    )


def _table_line(line: Column) -> Column:
    by_paren = line.rlike(_PAREN_LINE)
    name = F.when(by_paren, F.regexp_extract(line, _PAREN_LINE, 1)).otherwise(
        F.regexp_extract(line, _COLON_LINE, 1)
    )
    body = F.when(by_paren, F.regexp_extract(line, _PAREN_LINE, 2)).otherwise(
        F.regexp_extract(line, _COLON_LINE, 2)
    )
    return F.struct(name.alias("name"), body.alias("body"))


def schema_counts(schema: Column) -> Column:
    """``struct<tables, columns>`` of a compact schema with ``t(c, ...)`` or ``t: c, ...`` lines."""
    tables = F.filter(F.transform(lines(schema), _table_line), lambda t: t["name"] != "")

    def counted(tables: Column) -> Column:
        columns = F.transform(
            tables, lambda t: F.size(F.filter(F.split(t["body"], ","), lambda c: strip(c) != ""))
        )
        return F.struct(
            F.size(F.array_distinct(F.transform(tables, lambda t: t["name"]))).alias("tables"),
            F.aggregate(columns, F.lit(0), lambda a, b: a + b).alias("columns"),
        )

    return let(tables, counted)


def schema_tables(schema: Column) -> Column:
    """Table names of the ``name(`` lines, in order, repeats kept."""
    names = F.transform(lines(schema), lambda line: F.regexp_extract(line, r"^([A-Za-z0-9_]+)\s*\(", 1))
    return F.filter(names, lambda n: n != "")


def schema_preview(schema: Column, size: int = 200) -> Column:
    """The first characters followed by an ellipsis."""
    return F.concat(F.substring(schema, 1, size), F.lit("..."))


def extract_continuation(generated: Column) -> Column:
    """SQL from a continuation of a prompt that ends in ``SELECT ``.

    Kept up to the first semicolon, else the first blank line, else the first line break.
    """
    text = F.concat(F.lit("SELECT "), generated)
    cut = F.when(F.contains(text, F.lit(";")), F.concat(F.substring_index(text, ";", 1), F.lit(";")))
    for stop in ("\n\n", "\r\n\r\n", "\n", "\r\n"):
        cut = cut.when(F.contains(text, F.lit(stop)), F.substring_index(text, stop, 1))
    return strip(cut.otherwise(text))


def extract_answer(output: Column, prompt: Column | None = None) -> Column:
    """SQL from a chat-style answer: after the last SQL heading, out of a code fence, to the first ``;``."""
    echoed = output if prompt is None else F.replace(output, prompt, F.lit(""))
    answer = strip(
        F.when(F.contains(output, F.lit("### SQL:")), F.substring_index(output, "### SQL:", -1)).otherwise(
            echoed
        )
    )
    fence = r"(?is)```(?:sql)?\s*(.*?)\s*```"
    body = F.when(answer.rlike(fence), strip(F.regexp_extract(answer, fence, 1))).otherwise(answer)
    first = F.when(
        F.contains(body, F.lit(";")), F.concat(F.substring_index(body, ";", 1), F.lit(";"))
    ).otherwise(body)
    return strip(F.replace(first, F.lit("```"), F.lit("")))
