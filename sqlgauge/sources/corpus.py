"""Question corpora and dataset manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize

# Every field is first read as raw JSON text because corpora spell it as a list, an object or a scalar.
RAW_ENTRY = (
    "`query-split` string, sentences string, sql string, variables string, difficulty string, "
    "comments string, `old-name` string"
)
_VARIABLES = "struct<name:string,example:string>"
_SENTENCE = "struct<text:string,`question-split`:string,variables:string,difficulty:string>"
MANIFEST = (
    "generated_at_epoch long, datasets array<struct<name:string,url:string,description:string,"
    "file:string,mode:string,total:long,keys:array<string>>>"
)


def _stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut behind each ``}`` by Spark's own splittable reader: ``_file, _name, _range`` (start of the byte range
    that a task reads), ``_at`` (order within it) and ``_piece``, without the bracket."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_piece"),
    )


def _sum_in_range(value: str | Column, last: int) -> Column:
    """Running sum within a byte range, up to this piece (0) or the one before (-1)."""
    pieces = Window.partitionBy("_file", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, last)
    return F.coalesce(F.sum(value).over(pieces), F.lit(0))


def _scanned(pieces: DataFrame) -> DataFrame:
    """Add what a piece does: ``_quotes`` it holds and its change of depth, ``_outside`` if it begins outside a string and
    ``_inside`` if within one. No escape can be open at its start, as that follows a bracket."""
    parts = F.split(F.regexp_replace("_piece", r"(?s)\\.", ""), '"', -1)

    def depth(odd: int) -> Column:
        bare = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
        size = F.length(bare)
        opened, closed = (size - F.length(F.translate(bare, signs, "")) for signs in ("{[", "}]"))
        return opened - closed - F.when((F.size(parts) - 1) % 2 == odd, 1).otherwise(0)  # the bracket behind the piece

    scanned = pieces.withColumn("_quotes", F.size(parts) - 1).withColumn("_outside", depth(0)).withColumn("_inside", depth(1))
    return scanned.withColumn("_odd", _sum_in_range("_quotes", -1) % 2)


def _change(entered: Column) -> Column:
    """The change of depth of a piece in a range that was entered within a string (1) or not (0)."""
    return F.when((F.col("_odd") + entered) % 2 == 0, F.col("_outside")).otherwise(F.col("_inside"))


def _ends(rows: DataFrame) -> DataFrame:
    """Add ``_end``: an element of the root list ends with this piece. Needs the entry state of the range."""
    depth = F.col("_depth_in") + _sum_in_range(_change(F.col("_state_in")), 0)
    closed = (F.col("_state_in") + F.col("_odd") + F.col("_quotes")) % 2 == 0
    return rows.withColumn("_end", (closed & (depth == 1)).cast("int"))


def _ranges(pieces: DataFrame) -> DataFrame:
    """One row per range with its entry state: ``_state_in`` (1 within a string), ``_depth_in``, ``_first`` (elements that
    ended before it) and ``_all`` (elements of its file).

    Every range states its effect for both entry states; running sums over the ranges of a file give the true ones.
    """
    seen = materialize(_scanned(pieces).drop("_piece"), "corpus-brackets")
    effect = seen.groupBy("_file", "_range").agg(
        F.sum("_quotes").alias("_quotes"), F.sum(_change(F.lit(0))).alias("_d0"), F.sum(_change(F.lit(1))).alias("_d1")
    )
    of_file = Window.partitionBy("_file").orderBy("_range")
    before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    entered = effect.withColumn("_state_in", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("_state_in") == 0, F.col("_d0")).otherwise(F.col("_d1"))
    entered = entered.withColumn("_depth_in", F.coalesce(F.sum(change).over(before), F.lit(0)))
    entered = materialize(entered.select("_file", "_range", "_state_in", "_depth_in"), "corpus-entered")
    ended = _ends(seen.join(entered, ["_file", "_range"])).groupBy("_file", "_range", "_state_in", "_depth_in").agg(F.sum("_end").alias("_ended"))
    return materialize(
        ended.withColumn("_first", F.coalesce(F.sum("_ended").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_ended").over(Window.partitionBy("_file"))).drop("_ended"),
        "corpus-ranges",
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON files whose root is a list of objects: ``dataset, entry_pos`` and the raw fields.

    One file is read by many tasks, a byte range each (``spark.sql.files.maxPartitionBytes``). The brackets and quotes of
    the ranges tell where elements begin and end, whatever a range starts in; then each element is parsed by itself.
    Blank files and empty lists have no entries. A root that is no list, an element that is no object, a list that does
    not end and anything that is no JSON are errors, raised here.
    """
    pieces = _pieces(spark, path)
    placed = _ends(_scanned(pieces).join(_ranges(pieces), ["_file", "_range"]))
    number = F.col("_first") + _sum_in_range("_end", -1)
    placed = placed.withColumn("_number", number)
    # what stands behind the last element is one short piece if the file is whole, so of more only the first is kept
    rest = F.col("_number") == F.col("_all")
    text = F.when(rest, F.substring("_piece", 1, 1024)).otherwise(F.col("_piece"))
    held = placed.select("_file", "_name", "_number", rest.alias("_rest"), F.struct("_range", "_at", text.alias("_text")).alias("_part"))
    whole = held.where("NOT _rest").groupBy("_file", "_name", "_number", "_rest").agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
    whole = whole.withColumn("_count", F.size("_parts").cast("long"))
    behind = held.where("_rest").groupBy("_file", "_name", "_number", "_rest").agg(F.array(F.min("_part")).alias("_parts"), F.count(F.lit(1)).alias("_count"))
    element = F.array_join(F.transform("_parts", lambda p: p["_text"]), "}")
    first = F.col("_number") == 0
    start = F.when(first, r"^\x{feff}?\s*\[\s*").otherwise(r"^\s*,\s*")
    end = F.when(first, r"^\x{feff}?\s*(?:\[\s*\]\s*)?$").otherwise(r"^\s*\]\s*$")
    sound = F.when(F.col("_rest"), (F.col("_count") == 1) & F.rlike(element, end)).otherwise(F.rlike(element, F.concat(start, F.lit(r"\{"))))
    no_list = first & ~element.rlike(r"^\x{feff}?\s*(?:\[|$)")
    problem = F.when(no_list, "corpus root must be a list").when(~sound, "corpus list is not well formed")
    entry = F.when(sound & ~F.col("_rest"), F.concat(F.regexp_replace(element, start, F.lit("")), F.lit("}")))
    parsed = F.from_json(entry, f"{RAW_ENTRY}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    entries = whole.unionByName(behind).select(
        "_file", "_rest", problem.alias("_problem"), _stem(F.col("_name")).alias("dataset"), F.col("_number").alias("entry_pos"),
        parsed.alias("_entry"),
    )
    broken = F.when(F.col("_entry._broken").isNotNull(), "corpus list is not well formed")
    entries = materialize(entries.withColumn("_problem", F.coalesce("_problem", broken)), "corpus")
    files = entries.groupBy("_file").agg(F.min("_problem").alias("problem"), F.max("_rest").alias("ended"))
    bad = files.where("problem IS NOT NULL OR NOT ended").orderBy("_file").first()
    if bad is not None:
        raise ValueError(f"{bad['problem'] or 'corpus list does not end'}: {bad['_file']}")
    return entries.where("NOT _rest").select("dataset", "entry_pos", "_entry.*").drop("_broken")


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """The splittable form: one entry per line, each with its own ``dataset`` and ``entry_pos``."""
    return (
        spark.read.schema("dataset string, entry_pos long, " + RAW_ENTRY)
        .option("mode", "FAILFAST")
        .json(path)
    )


def entry_from_json(raw: DataFrame, column: str = "entry") -> DataFrame:
    """Replace a JSON text column by the raw entry fields."""
    return raw.withColumn("_entry", F.from_json(column, RAW_ENTRY)).select(
        *[c for c in raw.columns if c != column], "_entry.*"
    )


def _objects(raw: Column, schema: str) -> Column:
    elements = F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw), "array<string>")
    return F.transform(
        F.filter(elements, lambda e: F.startswith(F.ltrim(e), F.lit("{"))), lambda e: F.from_json(e, schema)
    )


def sql_variants(raw: Column) -> Column:
    """A list gives its items as text, a scalar one item, nothing or an empty scalar none."""
    none = F.array().cast("array<string>")
    as_list = F.from_json(F.when(F.startswith(F.ltrim(raw), F.lit("[")), raw), "array<string>")
    return F.when(as_list.isNotNull(), as_list).when(F.coalesce(raw, F.lit("")) == "", none).otherwise(
        F.array(raw)
    )


def typed_entries(entries: DataFrame) -> DataFrame:
    """Raw entry fields as typed columns; anything of the wrong shape becomes empty.

    Adds ``query_split, sql_variants, sentence_list, entry_variables`` and ``entry_difficulty``.
    """
    variables = F.coalesce(
        _objects(F.col("variables"), _VARIABLES), F.array().cast(f"array<{_VARIABLES}>")
    )
    sentences = F.coalesce(
        _objects(F.col("sentences"), _SENTENCE), F.array().cast(f"array<{_SENTENCE}>")
    )
    return entries.select(
        "dataset",
        "entry_pos",
        F.coalesce("query-split", F.lit("")).alias("query_split"),
        sql_variants(F.col("sql")).alias("sql_variants"),
        sentences.alias("sentence_list"),
        variables.alias("entry_variables"),
        F.col("difficulty").alias("entry_difficulty"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per dataset of a manifest file."""
    return manifest_rows(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def manifest_rows(manifests: DataFrame) -> DataFrame:
    """Unnest manifest documents."""
    return manifests.select(F.explode("datasets").alias("d")).select("d.*")
