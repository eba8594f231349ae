"""Result equality as bags, and order-free fingerprints of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINGERPRINT = "struct<columns:string,rows:bigint,sum_a:decimal(38,0),sum_b:decimal(38,0)>"


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.StringType):
        return "string"
    return dtype.simpleString()


#: Doubles are compared to this many significant digits, as a sum depends on the order of its rows.
DIGITS = 12


def _normal(value: Column, kind: T.DataType, loose_numbers: bool, digits: int | None) -> Column:
    """One spelling for equal values of a type, at any depth."""
    family = _family(kind)
    if loose_numbers and family in ("integer", "decimal"):
        family, value = "float", value.cast("double")
    if family == "float":
        number = value.cast("double") + F.lit(0.0)  # no negative zero
        number = F.when(~F.isnan(number), number)
        return number if digits is None else F.when(number.isNotNull(), F.format_string(f"%.{digits - 1}e", number))
    if family == "integer":
        return value.cast("long")
    if family == "decimal":
        # as text without trailing zeros, so every scale and precision is compared whole
        return F.regexp_replace(value.cast("string"), r"(?:\.0*|(\.\d*?)0+)$", "$1")
    if family == "string":
        # Values are compared letter by letter, whatever collation the query ran under.
        return F.collate(value, "UTF8_BINARY")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _normal(x, kind.elementType, loose_numbers, digits))
    if isinstance(kind, T.StructType):
        parts = [_normal(value.getField(f.name), f.dataType, loose_numbers, digits).alias(f"f{k}") for k, f in enumerate(kind.fields)]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(value), lambda e: _normal(e, entry, loose_numbers, digits)))
    return value


def _comparable(df: DataFrame, loose_numbers: bool, digits: int | None, plain: bool = False) -> DataFrame:
    """Columns in name order as ``c0, c1, ...``; numbers of one family share a spelling, NaN counts as null.

    With ``plain`` a column of doubles holds the doubles themselves. Columns are addressed by position, so repeated names
    do no harm.
    """
    placed = df.toDF(*[f"p{i}" for i in range(len(df.columns))])
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    kinds = [placed.schema.fields[i].dataType for i in order]
    return placed.select(
        *[
            _normal(F.col(f"p{i}"), kind, loose_numbers, None if plain and _is_float(kind, loose_numbers) else digits).alias(f"c{at}")
            for at, (i, kind) in enumerate(zip(order, kinds))
        ]
    )


def _is_float(kind: T.DataType, loose_numbers: bool) -> bool:
    return _family(kind) == "float" or (loose_numbers and _family(kind) in ("integer", "decimal"))


def _comparable_schemas(left: DataFrame, right: DataFrame, strict_types: bool) -> bool:
    names = [sorted(left.columns), sorted(right.columns)]
    if names[0] != names[1] or len(set(names[0])) != len(names[0]):
        return False
    if not strict_types:
        return True
    kinds = [{f.name: _family(f.dataType) for f in df.schema.fields} for df in (left, right)]
    return kinds[0] == kinds[1]


def compare_results(
    left: DataFrame, right: DataFrame, strict_types: bool = True, digits: int | None = DIGITS
) -> DataFrame:
    """One row ``match``: same columns (order free), same bag of rows, null equals null.

    Doubles are equal when they differ by less than ``10 ** (1 - digits)`` of the larger one; None compares bit by bit.
    With ``strict_types`` an integer column never equals a float column.

    Rows are tagged +1 and -1 and summed per distinct row, so copies collapse before they move and equal rows cancel. What
    is left of doubles is summed again by its first ``digits`` digits, and the little that still is left (sums on either side
    of a rounding border) is sorted on both sides within rows of equal other values and compared one by one. Such a group
    is sorted by one task; with several columns of doubles the first ones decide the order.
    """
    spark = left.sparkSession
    if not _comparable_schemas(left, right, strict_types):
        return spark.range(1).select(F.lit(False).alias("match"))
    if not left.columns:
        return spark.range(1).select(F.lit(True).alias("match"))
    a = _comparable(left, not strict_types, digits, plain=True)
    b = _comparable(right, not strict_types, digits, plain=True)
    tagged = a.withColumn(_TAG, F.lit(1)).unionByName(b.withColumn(_TAG, F.lit(-1)))
    uneven = tagged.groupBy(*a.columns).agg(F.sum(_TAG).alias(_TAG)).where(F.col(_TAG) != 0)
    order = sorted(range(len(left.columns)), key=lambda i: left.columns[i])
    doubles = [f"c{at}" for at, i in enumerate(order) if _is_float(left.schema.fields[i].dataType, not strict_types)]
    if doubles and digits is not None:
        uneven = _misaligned(uneven, [c for c in a.columns if c not in doubles], doubles, digits)
    return uneven.agg((F.count(F.lit(1)) == 0).alias("match"))


_TAG = "__side"


def _misaligned(uneven: DataFrame, exact: list[str], doubles: list[str], digits: int) -> DataFrame:
    """The rows that have no partner on the other side whose doubles are close; ``_TAG`` counts copies, by side."""
    cells = [F.format_string(f"%.{digits - 1}e", c).alias(f"_{c}") for c in doubles]
    cells = [F.when(F.col(c).isNotNull(), cell).alias(f"_{c}") for c, cell in zip(doubles, cells)]
    left = uneven.groupBy(*exact, *cells).agg(F.sum(_TAG).alias(_TAG), *(F.max(c).alias(c) for c in doubles)).where(F.col(_TAG) != 0)
    keys = exact + [f"_null_{c}" for c in doubles]
    left = left.withColumns({f"_null_{c}": F.col(c).isNull() for c in doubles}).withColumn("_first", F.col(_TAG) > 0)
    left = left.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs(_TAG))))
    place = F.row_number().over(Window.partitionBy(*keys, "_first").orderBy(*doubles))
    pairs = left.withColumn("_place", place).groupBy(*keys, "_place").agg(
        F.count(F.lit(1)).alias("_n"), *(f(c).alias(f"{name}{c}") for c in doubles for name, f in (("_low", F.min), ("_high", F.max)))
    )

    def apart(c: str) -> Column:
        low, high = F.col(f"_low{c}"), F.col(f"_high{c}")
        size = F.greatest(F.abs(low), F.abs(high))
        return F.coalesce((low != high) & ((size == float("inf")) | (high - low >= size * 10.0 ** (1 - digits))), F.lit(False))

    return pairs.where(reduce(lambda x, y: x | y, map(apart, doubles), F.col("_n") != 2))


def fingerprint(df: DataFrame, strict_types: bool = True, digits: int | None = DIGITS) -> DataFrame:
    """One row ``rows, fingerprint``: typed column list, row count and two sums of independent row hashes.

    The column list also states the significant digits of doubles, if there are any.

    Equal bags have equal fingerprints; needs no shuffle of the rows. A result with repeated column names has
    none, so it equals no other.
    """
    flat = _comparable(df, not strict_types, digits)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    kinds = [_family(f.dataType) for f in df.schema.fields]
    kinds = [f"{k}({digits})" if k == "float" and digits is not None else k for k in kinds]
    names = ",".join(f"{df.columns[i]}:{kinds[i]}" if strict_types else df.columns[i] for i in order)
    # A null is told from other values by its own flag; the second hash is seeded by a leading constant.
    parts: list[Column] = []
    for c in flat.columns:
        parts += [F.col(c), F.col(c).isNull()]
    first = F.xxhash64(*parts) if parts else F.lit(0).cast("long")
    second = F.xxhash64(F.lit("second"), *reversed(parts)) if parts else F.lit(0).cast("long")
    zero = F.lit(0).cast("decimal(38,0)")
    sums = flat.select(
        first.cast("decimal(28,0)").alias("_a"), second.cast("decimal(28,0)").alias("_b")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("_a").cast("decimal(38,0)"), zero).alias("a"),
        F.coalesce(F.sum("_b").cast("decimal(38,0)"), zero).alias("b"),
    )
    mark = F.struct(
        F.lit(names).alias("columns"), F.col("rows"), F.col("a").alias("sum_a"), F.col("b").alias("sum_b")
    )
    unique = len(set(df.columns)) == len(df.columns)
    return sums.select("rows", F.when(F.lit(unique), mark).alias("fingerprint"))


def match_outcomes(rows: DataFrame, pred: str = "pred", gold: str = "gold", out: str = "match") -> DataFrame:
    """Add ``out``: both outcomes succeeded with result sets and these are equal; false otherwise."""
    both = F.col(f"{pred}.success") & F.col(f"{gold}.success")
    same = F.col(f"{pred}.fingerprint") == F.col(f"{gold}.fingerprint")
    return rows.withColumn(out, F.coalesce(both & same, F.lit(False)))


def compare_engines(first: DataFrame, second: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pair two runs question by question.

    Each run has its keys and an ``outcome`` struct. When both succeeded: match, row counts, times and their
    absolute difference; otherwise the reason. The success flags are given in both cases.
    """
    left = first.select(*keys, F.col("outcome").alias("_a"))
    right = second.select(*keys, F.col("outcome").alias("_b"))
    both = F.coalesce(F.col("_a.success") & F.col("_b.success"), F.lit(False))
    same = F.coalesce(F.col("_a.fingerprint") == F.col("_b.fingerprint"), F.lit(False))

    def when_both(value: Column) -> Column:
        return F.when(both, value)

    return left.join(right, keys).select(
        *keys,
        (both & same).alias("match"),
        F.when(~both, "One or both queries failed").alias("reason"),
        F.col("_a.success").alias(f"{a}_success"),
        F.col("_b.success").alias(f"{b}_success"),
        when_both(F.col("_a.rows")).alias(f"{a}_rows"),
        when_both(F.col("_b.rows")).alias(f"{b}_rows"),
        when_both(F.col("_a.time_s")).alias(f"{a}_time"),
        when_both(F.col("_b.time_s")).alias(f"{b}_time"),
        when_both(F.abs(F.col("_a.time_s") - F.col("_b.time_s"))).alias("time_difference"),
    )


def all_matches(pairs: dict[str, tuple[DataFrame, DataFrame]], strict_types: bool = True) -> DataFrame:
    """``pair, match`` for many result pairs in one job."""
    parts = [
        compare_results(left, right, strict_types).select(F.lit(name).alias("pair"), "match")
        for name, (left, right) in pairs.items()
    ]
    return reduce(DataFrame.union, parts)
