"""Exact order statistics per group in bounded memory.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here the
values are first counted in order-preserving cells (a bounded number per group); of the cells that hold a wanted rank
the distinct values are counted. A cell with more than ``CELL_VALUES`` of them is cut into ``PARTS`` equal parts, again
and again, until no wanted part holds more; then the few values left are ranked. No window ever sees more rows than one
of these bounds, and all scans shuffle pre-aggregated counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import null_safe_join
from .scratch import materialize

CELLS_PER_OCTAVE = 64
CELL_VALUES = 100_000
PARTS = 4096


def cell(value: Column) -> Column:
    """Monotone integer cell of a double: 64 cells per power of two, mirrored for negatives."""
    size = F.floor((F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100.0) * CELLS_PER_OCTAVE)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def nearest_rank(total: Column, q: float) -> Column:
    """1-based rank ceil(q*n), clamped to 1..n."""
    return F.greatest(F.lit(1), F.least(total, F.ceil(F.lit(float(q)) * total))).cast("long")


def _running(name: str, keys: list[str], order: str) -> Column:
    frame = Window.partitionBy(*keys).orderBy(order)
    return F.sum(name).over(frame.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _inside(rows: DataFrame, hits: DataFrame, group: list[str]) -> DataFrame:
    """The rows of cells that hold a wanted rank."""
    return null_safe_join(rows, hits.select(*group, "_cell").distinct(), [*group, "_cell"], "left_semi")


def _picked(ranked: DataFrame, hits: DataFrame, group: list[str]) -> DataFrame:
    """Each wanted rank with the row whose running count covers it."""
    upto = F.col("_upto")
    covers = (F.col("_rank") <= upto) & (F.col("_rank") > upto - F.col("_n"))
    return null_safe_join(ranked, hits, [*group, "_cell"], extra=covers)


def _refined(distinct: DataFrame, hits: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cut wanted cells until each holds at most ``CELL_VALUES`` distinct values."""
    keys = [*group, "_cell"]
    while True:
        sizes = materialize(
            distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes"
        )
        if (sizes.agg(F.max("_k")).first()[0] or 0) <= CELL_VALUES:
            return distinct, hits
        share = (F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        part = F.when(F.col("_k") > CELL_VALUES, F.floor(share * PARTS)).otherwise(F.lit(0)).cast("int")
        cut = null_safe_join(distinct, sizes, keys).withColumn("_part", part).drop("_k", "_low", "_high")
        counted = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_n")).withColumn("_upto", _running("_n", keys, "_part"))
        inner = F.concat_ws("/", "_cell", F.col("_part").cast("string"))
        found = _picked(counted, hits, group).withColumn("_rank", F.col("_rank") - (F.col("_upto") - F.col("_n")))
        hits = materialize(
            found.withColumn("_cell", inner).select(*keys, "_name", "_side", "_weight", "_rank"), "ranks"
        )
        distinct = materialize(_inside(cut.withColumn("_cell", inner).drop("_part"), hits, group), "distinct")


def order_statistics(
    df: DataFrame, keys: list[str], requests: dict[str, tuple[str, str, float]]
) -> DataFrame:
    """One row per key group with one column per request; nulls are skipped, a group without values gets none.

    ``requests`` maps an output name to ``(measure, kind, q)``: ``disc`` picks the nearest rank, ``cont``
    interpolates linearly between the two neighbouring ranks.
    """
    measures = sorted({measure for measure, _, _ in requests.values()})
    pairs = [F.struct(F.lit(m).alias("_m"), F.col(m).cast("double").alias("_v")) for m in measures]
    values = (
        df.select(*keys, F.explode(F.array(*pairs)).alias("_e"))
        .select(*keys, "_e._m", "_e._v")
        .where(F.col("_v").isNotNull())
        .withColumn("_cell", cell(F.col("_v")))
    )

    group = [*keys, "_m"]
    counted = (
        values.groupBy(*group, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", _running("_n", group, "_cell"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
    )
    total = F.col("_total")
    wanted = []
    for name, (measure, kind, q) in requests.items():
        if kind == "disc":
            ranks = [(nearest_rank(total, q), F.lit(0.0))]
        else:
            at = (total - 1) * F.lit(float(q))
            low = F.floor(at)
            ranks = [(low + 1, at - low), (F.ceil(at) + 1, at - low)]
        for side, (rank, weight) in enumerate(ranks):
            wanted.append(
                F.struct(
                    F.lit(measure).alias("m"),
                    F.lit(name).alias("_name"),
                    F.lit(side).alias("_side"),
                    rank.cast("long").alias("_rank"),
                    weight.cast("double").alias("_weight"),
                )
            )
    before = F.col("_upto") - F.col("_n")
    here = F.filter(
        F.array(*wanted),
        lambda r: (r["m"] == F.col("_m")) & (r["_rank"] > before) & (r["_rank"] <= F.col("_upto")),
    )
    hits = materialize(
        counted.select(*group, "_cell", before.alias("_before"), F.explode(here).alias("_w")).select(
            *group, "_cell", "_w._name", "_w._side", "_w._weight",
            (F.col("_w._rank") - F.col("_before")).alias("_rank"),
        ),
        "ranks",
    )

    hits = hits.withColumn("_cell", F.col("_cell").cast("string"))
    values = values.withColumn("_cell", F.col("_cell").cast("string"))
    distinct = materialize(
        _inside(values, hits, group).groupBy(*group, "_cell", "_v").agg(F.count(F.lit(1)).alias("_n")), "distinct"
    )
    distinct, hits = _refined(distinct, hits, group)
    ranked = distinct.withColumn("_upto", _running("_n", [*group, "_cell"], "_v"))
    picked = _picked(ranked, hits, group)

    def chosen(name: str, side: int, field: str) -> Column:
        return F.max(F.when((F.col("_name") == name) & (F.col("_side") == side), F.col(field)))

    columns = []
    for name, (_, kind, _) in requests.items():
        low = chosen(name, 0, "_v")
        if kind == "disc":
            columns.append(low.alias(name))
        else:
            columns.append((low + (chosen(name, 1, "_v") - low) * chosen(name, 0, "_weight")).alias(name))
    return picked.groupBy(*keys).agg(*columns)


def with_order_statistics(
    summary: DataFrame, rows: DataFrame, keys: list[str], requests: dict[str, tuple[str, str, float]]
) -> DataFrame:
    """Attach order statistics of ``rows`` to a per-key ``summary`` (null keys match null keys)."""
    stats = order_statistics(rows, keys, requests)
    return null_safe_join(summary, stats, keys, "left")
