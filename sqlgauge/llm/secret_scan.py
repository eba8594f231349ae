"""Secret scans with an incremental ledger of blobs.

Every text is a blob named by its SHA-256. The ledger says which rule in which version has scanned which blob and what
it found. A run scans only the pairs of blob and rule version that the ledger lacks, adds them, and joins the findings
back to every path (row) that holds the blob, so copies and unchanged versions are never scanned again.

Only DataFrame functions: matches are marked with three control characters by a regular-expression replacement, and
positions follow from the lengths of the pieces between the marks. The control characters are first replaced by
another one in the text, which changes neither lengths nor matches.

Null texts are empty texts. Rows are judged one by one, so repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path

FOUND = "array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` has two groups, what stands before the value and the value; short values are no findings."""

    name: str
    version: int
    pattern: str
    least: int


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"]))
RULES = (
    Rule("assign", 1, rf"""((?:{_KEYS})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", 1, "()(AKIA[A-Z0-9]+)", 20),
    Rule("hex", 1, "()([0-9a-f]{24,})", 24),
    Rule("github", 1, "()(gh[pousr]_[A-Za-z0-9]{36,})", 0),
    Rule("jwt", 1, r"()(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0),
    Rule("pem", 1, "()(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 0),
    Rule("slack", 1, "()(xox[abprs]-[A-Za-z0-9-]{10,})", 0),
)
BASE = ("assign", "access", "hex")


def places(text: Column, rule: Rule) -> Column:
    """Start and end (code points, end exclusive) of the rule's matches, leftmost first and not overlapping."""
    plain = F.translate(text, "\x01\x02\x03", "\x04\x04\x04")
    marked = F.regexp_replace(plain, rule.pattern, "\x01$1\x02$2\x03")
    pieces = F.split(marked, "\x01")
    zero = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(FOUND).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        match = F.substring_index(piece, "\x03", 1)
        end = state["at"] + F.length(match) - 1
        value = F.length(F.substring_index(match, "\x02", -1))
        span = F.struct(state["at"].alias("start"), end.alias("end"))
        return F.struct(
            (state["at"] + F.length(piece) - 2).alias("at"),
            F.when(value >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    rest = F.slice(pieces, F.lit(2), F.size(pieces))
    found = F.aggregate(rest, zero, step, lambda state: state["found"])
    return F.when(F.size(pieces) > 1, found).otherwise(F.array().cast(FOUND))


def scan(
    docs: DataFrame, ledger: str | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """All columns plus _blob and one column _<rule> of found places per rule.

    ``ledger`` is a folder that all executors reach; without one a new ledger is begun in the scratch folder. Each run
    adds one written table with a row per blob it has scanned.
    """
    docs = docs.drop("_blob", "_of", *(f"_{r.name}" for r in rules))
    spark = docs.sparkSession
    known = _read(spark, ledger) if ledger else None
    ledger = ledger or scratch_path(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.sha2(text, 256)
    blobs = docs.select(blob.alias("_blob"), text.alias("_text")).dropDuplicates(["_blob"])
    names = [f"{r.name}:{r.version}" for r in rules]
    if known is not None:
        done = known.groupBy("_blob").agg(F.array_distinct(F.flatten(F.collect_list("_rules"))).alias("_done"))
        blobs = blobs.join(done, "_blob", "left")
        blobs = blobs.withColumn("_todo", F.array_except(F.array(*map(F.lit, names)), F.coalesce("_done", F.array())))
        blobs = blobs.where(F.size("_todo") > 0)
    else:
        blobs = blobs.withColumn("_todo", F.array(*map(F.lit, names)))
    fresh = blobs.select(
        "_blob", F.col("_todo").alias("_rules"),
        *(
            F.when(F.array_contains("_todo", name), places(F.col("_text"), rule)).alias(f"_{rule.name}")
            for rule, name in zip(rules, names)
        ),
    )
    fresh.write.mode("append").parquet(ledger)
    held = _read(spark, ledger)
    current = lambda rule, name: F.when(F.array_contains("_rules", name), F.col(f"_{rule.name}"))
    any_found = [F.coalesce(F.size(current(r, n)), F.lit(0)) > 0 for r, n in zip(rules, names)]
    hit = any_found[0]
    for more in any_found[1:]:
        hit |= more
    findings = (
        held.where(hit)  # blobs without a finding need no row
        .groupBy("_blob").agg(*(F.first(current(r, n), ignorenulls=True).alias(f"_{r.name}") for r, n in zip(rules, names)))
    )
    paths = docs.withColumn("_blob", blob)
    joined = paths.join(findings.withColumnRenamed("_blob", "_of"), F.col("_blob") == F.col("_of"), "left")
    nothing = F.array().cast(FOUND)
    return joined.select(
        *docs.columns, "_blob", *(F.coalesce(f"_{r.name}", nothing).alias(f"_{r.name}") for r in rules)
    )


def _read(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's rows, or nothing if it has not been begun."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def spans(rules: tuple[Rule, ...] | tuple[str, ...]) -> Column:
    """kind:start:end of all places, by start and then by the order of the kinds."""
    names = [r if isinstance(r, str) else r.name for r in rules]

    def placed(order: int, name: str) -> Column:
        return F.transform(
            f"_{name}",
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(name).alias("kind")
            ),
        )

    every = F.flatten(F.array(*(placed(k, name) for k, name in enumerate(names))))
    return F.array_join(
        F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
