"""Lines that stand on too many pages of one site.

Pages are grouped by host. A line counts once per page; the pages that hold it are divided by the host's pages, and the
line is dropped from the host's pages when that ratio exceeds ``max_ratio`` and at least ``min_pages`` pages hold it.
Lines are compared without the blanks around them; blank lines are never counted and stay.

Only DataFrame functions. Lines travel as 128-bit digests and are counted before they are shuffled; the boilerplate
lines of a host are at most (lines per page / max_ratio) many. They meet the pages' lines in a join on host and line,
whose large side adaptive execution splits when one line is very common.

A null host is a host of its own. Null texts stay null and count as pages. Rows are pages, so repeated rows count.

Where near copies are known (``groups``), copies do not make a text boilerplate: pages of a group that has ``min_pages``
rows on the host, and pages that would lose all their lines, lose only lines that are above the ratio with each group
(and each other text) counted as one page. Groups may be found by a function of those pages alone that hold a line above
the ratio, as no other page loses anything; a page without such a line then counts once per distinct text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

MAX_RATIO = 0.01
MIN_PAGES = 5


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def place_pages(docs: DataFrame, host: Column, text: Column, row: Column, groups: DataFrame) -> DataFrame:
    """Columns _host, _row, _page of each row: its group by ``groups`` (_member, _page), else a hash of its text (of
    ``row`` where that is null); written once."""
    own = F.when(text.isNull(), row).otherwise(F.xxhash64(text))
    rows = docs.select(host.alias("_host"), row.alias("_row"), own.alias("_own"))
    placed = rows.join(groups, F.col("_row") == F.col("_member"), "left")
    return materialize(placed.select("_host", "_row", F.coalesce("_page", "_own").alias("_page")), "pages")


def sure_lines(
    held: DataFrame, placed: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Columns _sure_host, _sure: the lines of ``held`` (_host, _row, _line) that stay above the ratio with one page counted once."""
    totals = placed.select("_host", "_page").distinct().groupBy(F.col("_host").alias("_of")).agg(F.count(F.lit(1)).alias("_all"))
    pages = placed.select("_row", "_page").distinct().withColumnRenamed("_row", "_of_row")
    lines = held.join(pages, F.col("_row") == F.col("_of_row")).select("_host", "_line", "_page").distinct()
    counts = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
    joined = counts.join(totals, F.col("_host").eqNullSafe(F.col("_of"))).where(F.col("_n") > F.lit(max_ratio) * F.col("_all"))
    return materialize(joined.select(F.col("_host").alias("_sure_host"), F.col("_line").alias("_sure")), "sure-lines")


def boilerplate_lines(
    pages: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """Columns _host, _line (digest), _n, _pages: the lines above the ratio; written once."""
    source = pages.select(host.alias("_host"), text.alias("_text"))
    totals = source.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _digest))
    counts = (
        source.select("_host", F.explode(digests).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    joined = counts.join(totals.withColumnRenamed("_host", "_of"), F.col("_host").eqNullSafe(F.col("_of"))).drop("_of")
    return materialize(joined.where(F.col("_n") > F.lit(max_ratio) * F.col("_pages")), "boilerplate")


def drop_boilerplate(
    docs: DataFrame, host: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
    max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, row: Column | None = None,
    groups: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All columns with the lines dropped from the text, plus _lines (not blank, before) and _dropped. ``groups`` holds
    near copies: the ``row`` of each member (_member, once) and what names its group (_page); or it is a function that
    gives this for the rows of ``docs`` it gets."""
    host = F.col("source") if host is None else host
    row = F.col(id_col) if groups is None else row
    docs = docs.drop("_row_host", "_key", "_key_host", "_drop", "_some", "_copied", "_lines", "_dropped")
    boiler = boilerplate_lines(docs, host, F.col(text_col), max_ratio, min_pages)
    boiler = boiler.select(F.col("_host").alias("_bad_host"), F.col("_line").alias("_bad"))
    digests = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: F.trim(x) != ""), _digest))
    held = docs.select(row.alias("_row"), host.alias("_host"), F.explode(digests).alias("_line"))
    found = held.join(boiler, F.col("_host").eqNullSafe(F.col("_bad_host")) & (F.col("_line") == F.col("_bad")))
    sets = [F.collect_set("_line").alias("_drop")]
    if groups is not None:
        found = materialize(found.select("_row", "_host", "_line"), "boilerplate-of-rows")
        if callable(groups):
            holders = found.select(F.col("_row").alias("_holder")).distinct()
            groups = groups(materialize(docs.join(holders, row.eqNullSafe(F.col("_holder")), "left_semi"), "holders"))
        placed = place_pages(docs, host, F.col(text_col), row, groups)
        sure = sure_lines(found, placed, max_ratio, min_pages)
        large = placed.groupBy("_host", "_page").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pages)
        large = large.select(F.col("_host").alias("_at"), F.col("_page").alias("_of"))
        same = F.col("_host").eqNullSafe(F.col("_at")) & (F.col("_page") == F.col("_of"))
        copied = placed.join(large, same).select(F.col("_row").alias("_copy"), F.col("_host").alias("_copy_host")).distinct()
        found = found.join(sure, F.col("_host").eqNullSafe(F.col("_sure_host")) & (F.col("_line") == F.col("_sure")), "left")
        found = found.join(copied, (F.col("_row") == F.col("_copy")) & F.col("_host").eqNullSafe(F.col("_copy_host")), "left")
        sets += [F.collect_set("_sure").alias("_some"), F.max(F.col("_copy").isNotNull()).alias("_copied")]
    found = found.groupBy(F.col("_row").alias("_key"), F.col("_host").alias("_key_host")).agg(*sets)
    same = row.eqNullSafe(F.col("_key")) & F.col("_row_host").eqNullSafe(F.col("_key_host"))
    joined = docs.withColumn("_row_host", host).join(found, same, "left")
    lines = _lines(F.col(text_col))
    if groups is not None:
        left = F.filter(lines, lambda x: (F.trim(x) != "") & ~F.array_contains(F.col("_drop"), _digest(x)))
        spared = F.col("_copied") | (F.size(left) == 0)
        joined = joined.withColumn("_drop", F.when(spared, F.col("_some")).otherwise(F.col("_drop")))
    drops = lambda x: (F.trim(x) != "") & F.array_contains(F.col("_drop"), _digest(x))
    count = lambda a: F.coalesce(F.when(a.isNull(), F.lit(0)).otherwise(F.size(a)), F.lit(0)).cast("long")
    new = F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.filter(lines, lambda x: ~drops(x)), "\n")
    )
    columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(
        *columns,
        count(F.filter(lines, lambda x: F.trim(x) != "")).alias("_lines"),
        F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(count(F.filter(lines, drops))).alias("_dropped"),
    )
