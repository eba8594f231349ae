"""Schema catalogs as DataFrames: rendering, foreign keys, completeness.

A catalog has one row per column: ``dataset, table, col_pos, column, type, nullable, default, pk_pos``.
Foreign keys are rows ``dataset, table, fk_pos, columns, ref_table, ref_columns`` (column lists as arrays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.idents import identifier_tokens

def _in_order(position: str, *fields: Column) -> Column:
    """The fields of a group's rows as an array ordered by ``position``."""
    return F.array_sort(F.collect_list(F.struct(F.col(position).alias("_at"), *fields)))


def table_rows(catalog: DataFrame) -> DataFrame:
    """One row per table with its ordered ``columns`` array."""
    return catalog.groupBy("dataset", "table").agg(
        _in_order("col_pos", F.col("column"), F.col("type"), F.col("nullable"), F.col("default"), F.col("pk_pos"))
        .alias("columns")
    )


def render_create(catalog: DataFrame, foreign_keys: DataFrame | None = None) -> DataFrame:
    """``dataset, ddl``: CREATE TABLE statements in table-name order."""
    tables = table_rows(catalog)

    def definition(c: Column) -> Column:
        return F.concat(
            F.lit("    "), c["column"], F.lit(" "), c["type"],
            F.when(~c["nullable"], " NOT NULL").otherwise(""),
            F.when(F.coalesce(c["default"], F.lit("")) != "", F.concat(F.lit(" DEFAULT "), c["default"]))
            .otherwise(""),
        )

    keyed = F.array_sort(
        F.transform(
            F.filter(F.col("columns"), lambda c: c["pk_pos"].isNotNull()),
            lambda c: F.struct(c["pk_pos"], c["column"]),
        )
    )
    primary = F.when(
        F.size(keyed) > 0,
        F.array(
            F.concat(
                F.lit("    PRIMARY KEY ("),
                F.array_join(F.transform(keyed, lambda k: k["column"]), ", "),
                F.lit(")"),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    parts = [F.transform(F.col("columns"), definition), primary]
    if foreign_keys is not None:
        lists = foreign_keys.groupBy("dataset", "table").agg(
            _in_order("fk_pos", F.col("columns").alias("cols"), F.col("ref_table"), F.col("ref_columns"))
            .alias("_fks")
        )
        tables = tables.join(lists, ["dataset", "table"], "left")
        foreign = F.transform(
            F.col("_fks"),
            lambda k: F.concat(
                F.lit("    FOREIGN KEY ("), F.array_join(k["cols"], ", "), F.lit(") REFERENCES "),
                k["ref_table"], F.lit("("), F.array_join(k["ref_columns"], ", "), F.lit(")"),
            ),
        )
        parts.append(F.coalesce(foreign, F.array().cast("array<string>")))
    statements = tables.withColumn(
        "_ddl",
        F.concat(
            F.lit("CREATE TABLE "), F.col("table"), F.lit(" (\n"),
            F.array_join(F.concat(*parts), ",\n"), F.lit("\n);\n"),
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct("table", "_ddl")))
    return statements.groupBy("dataset").agg(
        F.array_join(F.transform(ordered, lambda t: t["_ddl"]), "\n").alias("ddl")
    )


def compact_line(table: Column, columns: Column, with_types: bool = False) -> Column:
    """``table(c1, c2)`` from the ordered columns array."""
    shown = F.transform(
        columns, lambda c: F.concat(c["column"], F.lit(" "), c["type"]) if with_types else c["column"]
    )
    return F.concat(table, F.lit("("), F.array_join(shown, ", "), F.lit(")"))


def render_compact(catalog: DataFrame, with_types: bool = False, max_tables: int | None = None) -> DataFrame:
    """``dataset, schema_compact``: one line per table in name order, optionally only the first tables."""
    lines = table_rows(catalog).select(
        "dataset", "table", compact_line(F.col("table"), F.col("columns"), with_types).alias("_line")
    )
    ordered = F.array_sort(F.collect_list(F.struct("table", "_line")))
    if max_tables is not None:
        ordered = F.slice(ordered, 1, max_tables)
    return lines.groupBy("dataset").agg(
        F.array_join(F.transform(ordered, lambda t: t["_line"]), "\n").alias("schema_compact")
    )


def fk_graph(foreign_keys: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours as distinct ``dataset, src, dst`` rows."""
    forward = foreign_keys.select("dataset", F.col("table").alias("src"), F.col("ref_table").alias("dst"))
    backward = forward.select("dataset", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.where("dst is not null").union(backward.where("src is not null")).distinct()


def dataset_tables(catalog: DataFrame) -> DataFrame:
    """``dataset, tables``: table names in name order."""
    return catalog.groupBy("dataset").agg(F.array_sort(F.collect_set("table")).alias("tables"))


def schema_profiles(
    catalog: DataFrame, graph: DataFrame | None = None, with_types: bool = False
) -> DataFrame:
    """``dataset, schema``: everything linking needs about a dataset, in one row per dataset.

    ``schema`` is an array over tables in name order: ``name, line, name_tokens, column_tokens, neighbours``.
    """
    # Tokens are made on the catalog rows, before they are grouped into tables.
    tables = (
        catalog.withColumn("_tokens", identifier_tokens(F.col("column")))
        .groupBy("dataset", "table")
        .agg(_in_order("col_pos", F.col("column"), F.col("type"), F.col("_tokens")).alias("columns"))
    )
    if graph is not None:
        near = graph.groupBy("dataset", F.col("src").alias("table")).agg(
            F.array_sort(F.collect_set("dst")).alias("neighbours")
        )
        tables = tables.join(near, ["dataset", "table"], "left")
    else:
        tables = tables.withColumn("neighbours", F.lit(None).cast("array<string>"))
    column_tokens = F.array_distinct(F.flatten(F.transform("columns", lambda c: c["_tokens"])))
    entry = F.struct(
        F.col("table").alias("name"),
        compact_line(F.col("table"), F.col("columns"), with_types).alias("line"),
        identifier_tokens(F.col("table")).alias("name_tokens"),
        column_tokens.alias("column_tokens"),
        F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"),
    )
    return tables.groupBy("dataset").agg(F.array_sort(F.collect_list(entry)).alias("schema"))


def dataset_info(expected: DataFrame, catalog: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """For each ``expected.dataset``: ``available``, its ``tables`` and ``table_count``.

    ``databases`` (column ``database``) lists what exists, so that one without tables is available, too.
    """
    found = dataset_tables(catalog)
    if databases is not None:
        exists = databases.select(F.col("database").alias("dataset")).distinct()
        found = exists.join(found, "dataset", "full").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))
    return expected.select("dataset").distinct().join(found, "dataset", "left").select(
        "dataset",
        F.col("tables").isNotNull().alias("available"),
        "tables",
        F.size("tables").alias("table_count"),
    )


def completeness(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """``dataset, table_count, min_tables, imported``: enough tables are there (default minimum 1)."""
    counts = catalog.groupBy("dataset").agg(F.count_distinct("table").alias("table_count"))
    minimum = F.coalesce("min_tables", F.lit(1))
    return expected.join(counts, "dataset", "left").select(
        "dataset",
        F.coalesce("table_count", F.lit(0)).alias("table_count"),
        minimum.alias("min_tables"),
        F.coalesce(F.col("table_count") >= minimum, F.lit(False)).alias("imported"),
    )


def corpus_profile(entries: DataFrame, raw: str = "entry") -> DataFrame:
    """``dataset, total, keys``: entry count and the sorted keys of the first entry."""
    return entries.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"),
        F.array_sort(F.json_object_keys(F.min_by(raw, "entry_pos"))).alias("keys"),
    )
