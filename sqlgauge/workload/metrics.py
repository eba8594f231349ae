"""Queries over run logs: normalisation, summaries, chart tables, engine comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import tolerant_boolean, tolerant_number
from ..operators import metrics as M
from ..operators import plots as P
from ..operators.comparison import compare_engines
from ..operators.records import attach_predictions, flatten_outcomes
from ..operators.runlog import asymmetry, canonical_runlog, ex_given_success, question_rows
from ..sources.runlog import fill_flags
from .inputs import RUNLOG
from .registry import query, run
from .sqltext import BUCKET


def records(spark, sf) -> DataFrame:
    """The run log with its execution facts spelled in one of three ways, by record."""
    base = run(spark, sf, RUNLOG, busy="events")
    kind = F.col("id") % 3
    keep = [
        "id", "dataset", "llm", "query_split", "question_split", "question_text", "gold_sql_exec",
        "gold_sql_first", "pred_sql", "schema_compact", "gen_time_s", "prompt_tokens",
    ]
    out = [F.col(c) for c in keep] + [F.col("n_columns").alias("schema_num_columns")]
    for engine, short in (("mysql", "my"), ("mariadb", "ma")):
        for side in ("pred", "gold"):
            ok, spent = F.col(f"{short}_{side}").cast("string"), F.col(f"{short}_{side}_t")
            struct = F.struct(ok.alias("success"), spent.alias("execution_time_s"))
            out += [
                F.when(kind == 0, struct).alias(engine if side == "pred" else f"{engine}_gold"),
                F.when(kind == 1, ok).alias(f"{engine}_{side}.success"),
                F.when(kind == 1, spent).alias(f"{engine}_{side}.execution_time_s"),
                F.when(kind == 2, ok).alias(f"{engine}_{side}_success"),
                F.when(kind == 2, spent).alias(f"{engine}_{side}_time_s"),
            ]
        out.append(F.col(f"{short}_ex").cast("string").alias(f"{engine}_pred_vs_gold_match"))
    out.append(F.col("cross_match").cast("string").alias("mysql_vs_mariadb_match"))
    return base.select(*out)


def rows(spark, sf) -> DataFrame:
    return question_rows(canonical_runlog(records(spark, sf)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


# One flat row per record, straight from the recipe.
FLAT = f"""SELECT id, dataset, llm, query_split, question_split, question_text, pred_sql, gold_sql_exec,
  n_tables AS tables_in_schema_compact, n_columns AS schema_num_columns, prompt_tokens, {BUCKET} AS complexity_bucket,
  gen_time_s, my_pred AS mysql_pred_success, ma_pred AS mariadb_pred_success,
  my_gold AS mysql_gold_success, ma_gold AS mariadb_gold_success,
  my_pred_t AS mysql_pred_execution_time_s, ma_pred_t AS mariadb_pred_execution_time_s,
  my_gold_t AS mysql_gold_execution_time_s, ma_gold_t AS mariadb_gold_execution_time_s,
  my_ex AS mysql_ex, ma_ex AS mariadb_ex, CASE WHEN my_pred THEN my_ex END AS mysql_ex_given_success,
  CASE WHEN ma_pred THEN ma_ex END AS mariadb_ex_given_success, cross_match AS mysql_vs_mariadb_match,
  coalesce(my_pred AND NOT ma_pred, FALSE) AS pred_mysql_only_success,
  coalesce(ma_pred AND NOT my_pred, FALSE) AS pred_mariadb_only_success,
  coalesce(my_pred AND ma_pred, FALSE) AS pred_both_success,
  coalesce(NOT my_pred AND NOT ma_pred, FALSE) AS pred_neither_success
FROM ({RUNLOG}) r"""

_SPELLED = """CASE event_id % 13 WHEN 0 THEN 'true' WHEN 1 THEN ' T ' WHEN 2 THEN 'Yes' WHEN 3 THEN '1' WHEN 4 THEN 'FALSE'
  WHEN 5 THEN 'n' WHEN 6 THEN '0' WHEN 7 THEN CAST(value AS STRING) WHEN 8 THEN 'maybe' WHEN 9 THEN '' WHEN 10 THEN '0.0'
  WHEN 11 THEN 'nan' END"""


@query(
    "m1_tolerant_boolean",
    """SELECT event_id, CASE WHEN event_id % 13 IN (0, 1, 2, 3) THEN TRUE WHEN event_id % 13 IN (4, 5, 6) THEN FALSE END AS flag,
      floor(value) <> 0 AS typed FROM @events""",
)
def m1(spark, sf):
    texts = run(spark, sf, f"SELECT event_id, floor(value) AS number, {_SPELLED} AS text FROM @events")
    return texts.select(
        "event_id", tolerant_boolean(F.col("text")).alias("flag"), tolerant_boolean(F.col("number"), True).alias("typed")
    )


_FACTS = [
    f"{e}_{f}" for e in ("mysql", "mariadb")
    for f in ("pred_success", "gold_success", "pred_execution_time_s", "gold_execution_time_s", "ex")
] + ["mysql_vs_mariadb_match"]


@query("m2_canonical_runlog", f"SELECT id, {', '.join(_FACTS)} FROM ({FLAT}) f")
def m2(spark, sf):
    return canonical_runlog(records(spark, sf)).select("id", *_FACTS)


@query("m3_question_rows", f"SELECT *, '' AS rdbms_mode FROM ({FLAT}) f")
def m3(spark, sf):
    return rows(spark, sf)


@query("m4_conditional_ex", f"SELECT id, mysql_ex_given_success, mariadb_ex_given_success FROM ({FLAT}) f")
def m4(spark, sf):
    c = canonical_runlog(records(spark, sf))
    return c.select("id", *[
        ex_given_success(F.col(f"{e}_pred_success"), F.col(f"{e}_ex")).alias(f"{e}_ex_given_success")
        for e in ("mysql", "mariadb")
    ])


@query(
    "m5_asymmetry",
    f"""SELECT id, pred_mysql_only_success AS a_only, pred_mariadb_only_success AS b_only,
      pred_both_success AS both, pred_neither_success AS neither FROM ({FLAT}) f""".replace(" both,", ' "both",'),
)
def m5(spark, sf):
    c = canonical_runlog(records(spark, sf))
    flags = asymmetry(F.col("mysql_pred_success"), F.col("mariadb_pred_success"))
    return c.select("id", *[v.alias(k) for k, v in flags.items()])


def _share(c: str, name: str) -> str:
    return f"round(count(*) FILTER (WHERE {c}) / count(*)::DOUBLE, 6) AS {name}"


def _known_share(c: str, name: str, where: str = "TRUE") -> str:
    return (
        f"round(count(*) FILTER (WHERE {c} AND {where}) / nullif(count({c}) FILTER (WHERE {where}), 0)::DOUBLE, 6) AS {name}"
    )


_SUCCESS = [_share(f"{e}_pred_success", f"{e}_pred_success_rate") for e in ("mysql", "mariadb")]
_EX = [_share(f"{e}_ex", f"{e}_execution_accuracy_ex") for e in ("mysql", "mariadb")]
_EXGS = [_known_share(f"{e}_ex_given_success", f"{e}_ex_given_success") for e in ("mysql", "mariadb")]
_AGREE = [_known_share("mysql_vs_mariadb_match", "mysql_vs_mariadb_match_rate", "pred_both_success")]
_SIDES = [
    _share(f"pred_{s}_success", f"{s}_success_rate") for s in ("mysql_only", "mariadb_only", "both", "neither")
]


def _nearest(c: str, q: str, name: str) -> str:
    values = f"list_sort(list({c}::DOUBLE) FILTER (WHERE {c} IS NOT NULL))"
    return f"round({values}[ceil({q}::DOUBLE * count({c}))::BIGINT], 6) AS {name}"


def _mean(c: str, name: str) -> str:
    return f"round(avg({c}), 6) AS {name}"


_GEN = [
    _mean("gen_time_s", "gen_time_mean_s"), _nearest("gen_time_s", "0.5", "gen_time_median_s"),
    _nearest("gen_time_s", "0.9", "gen_time_p90_s"),
]
_EXEC = [
    part
    for e in ("mysql", "mariadb")
    for part in (
        _mean(f"{e}_pred_execution_time_s", f"{e}_exec_time_mean_s"),
        _nearest(f"{e}_pred_execution_time_s", "0.5", f"{e}_exec_time_median_s"),
    )
]
_SIZE = [
    _mean("tables_in_schema_compact", "schema_tables_mean"),
    _nearest("tables_in_schema_compact", "0.5", "schema_tables_median"),
]


def _by_dataset(parts: list[str], source: str = FLAT) -> str:
    return f"SELECT dataset, {', '.join(parts)} FROM ({source}) f GROUP BY dataset"


@query("m6_success_rate", _by_dataset(_SUCCESS))
def m6(spark, sf):
    return rounded(M.success_rates(rows(spark, sf)))


@query("m7_execution_accuracy", _by_dataset(_EX))
def m7(spark, sf):
    return rounded(M.execution_accuracy(rows(spark, sf)))


@query("m8_ex_given_success", _by_dataset(_EXGS))
def m8(spark, sf):
    return rounded(M.accuracy_given_success(rows(spark, sf)))


@query("m9_engine_agreement", _by_dataset(_AGREE))
def m9(spark, sf):
    return rounded(M.engine_agreement(rows(spark, sf)))


@query("m10_asymmetry_rates", _by_dataset(_SIDES))
def m10(spark, sf):
    return rounded(M.asymmetry_rates(rows(spark, sf)))


@query("m11_generation_time", _by_dataset(_GEN))
def m11(spark, sf):
    return rounded(M.generation_times(rows(spark, sf)))


@query("m12_execution_time", _by_dataset(_EXEC))
def m12(spark, sf):
    return rounded(M.execution_times(rows(spark, sf)))


@query("m13_schema_size", _by_dataset(_SIZE))
def m13(spark, sf):
    return rounded(M.schema_sizes(rows(spark, sf)))


@query(
    "m14_complexity_breakdown",
    f"""SELECT dataset, complexity_bucket AS bucket,
      CASE complexity_bucket WHEN 'simple' THEN 1 WHEN 'medium' THEN 2 WHEN 'complex' THEN 3 ELSE 4 END AS bucket_order,
      count(*) AS n_questions, {', '.join(_SUCCESS + _EX)} FROM ({FLAT}) f GROUP BY dataset, complexity_bucket""",
)
def m14(spark, sf):
    return rounded(M.complexity_breakdown(rows(spark, sf)))


@query(
    "m15_nearest_rank",
    f"""SELECT llm, {', '.join(_nearest('gen_time_s', q, n) for q, n in
      (('0.01', 'p01'), ('0.25', 'p25'), ('0.75', 'p75'), ('0.9', 'p90'), ('1.0', 'p100')))}
      FROM ({FLAT}) f GROUP BY llm""",
)
def m15(spark, sf):
    from ..plans.quantiles import order_statistics

    wanted = {f"p{n}": ("gen_time_s", "disc", q) for n, q in
              (("01", 0.01), ("25", 0.25), ("75", 0.75), ("90", 0.9), ("100", 1.0))}
    return rounded(order_statistics(rows(spark, sf), ["llm"], wanted))


_ALL = ["count(*) AS n_questions", *_SUCCESS, *_EX, *_EXGS, *_AGREE, *_SIDES, *_GEN, *_EXEC, *_SIZE]
_SHORT = ["count(*) AS n_questions", *_SUCCESS, *_EX]


@query(
    "m16_summary",
    f"""SELECT *, NULL AS breakdown, NULL AS bucket FROM ({_by_dataset(_ALL)}) a UNION ALL BY NAME
      SELECT dataset, complexity_bucket AS bucket, 'complexity' AS breakdown, {', '.join(_SHORT)}
      FROM ({FLAT}) f GROUP BY dataset, complexity_bucket""",
)
def m16(spark, sf):
    return rounded(M.summarize(rows(spark, sf)))


_NUMBERS = """CASE event_id % 5 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN 'n/a' WHEN 2 THEN
  CASE event_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '12d' WHEN 2 THEN '0x1p3' ELSE '' END
  WHEN 3 THEN CAST(CAST(floor(value) AS INT) AS STRING) END"""


@query(
    "p1_numeric_coercion",
    """SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN value WHEN 3 THEN floor(value) END, 6) AS number,
      NULL::DOUBLE AS absent FROM @events""",
)
def p1(spark, sf):
    texts = run(spark, sf, f"SELECT event_id, {_NUMBERS} AS text FROM @events")
    return texts.select(
        "event_id", F.round(tolerant_number(F.col("text")), 6).alias("number"),
        P.number(texts, "missing").alias("absent"),
    )


_FLAGS = ["mysql_pred_success", "mariadb_pred_success", "mysql_ex", "mariadb_ex_given_success"]


@query(
    "p2_flag_rate",
    _by_dataset([_share(c, c) for c in _FLAGS] + ["0.0::DOUBLE AS absent_flag"]),
)
def p2(spark, sf):
    return rounded(P.flag_rates(rows(spark, sf), [*_FLAGS, "absent_flag"], ["dataset"]))


# Interpolated values have more digits than their inputs; nine keep rounding away from ties.
def _nine(sql: str) -> str:
    return sql.replace(", 6) AS", ", 9) AS")


def _cont(c: str, q: str, name: str) -> str:
    return f"round(quantile_cont({c}::DOUBLE, {q}), 6) AS {name}"


@query(
    "p3_numeric_stats",
    _nine(_by_dataset([_mean("gen_time_s", "gen_time_mean"), _cont("gen_time_s", "0.5", "gen_time_median"),
                       _cont("gen_time_s", "0.95", "gen_time_p95")])),
)
def p3(spark, sf):
    return rounded(P.numeric_stats(rows(spark, sf), "gen_time_s", "gen_time", ["dataset"]), 9)


# The chart input has rows without a dataset.
_CHART = f"SELECT * REPLACE (CASE WHEN id % 23 <> 0 THEN dataset END AS dataset) FROM ({FLAT}) c"


def chart_rows(spark, sf) -> DataFrame:
    return rows(spark, sf).withColumn("dataset", F.when(F.col("id") % 23 != 0, F.col("dataset")))


def _chart_table(e: str) -> list[str]:
    pred, gold = f"{e}_pred_execution_time_s", f"{e}_gold_execution_time_s"
    return [
        "count(*) AS n",
        _share(f"{e}_pred_success", "pred_exec_rate"), _share(f"{e}_gold_success", "gold_exec_rate"),
        _share(f"{e}_ex", "ex"), _share(f"{e}_ex_given_success", "ex_and_success_rate"),
        _mean(pred, "pred_exec_time_mean_s"), _mean(gold, "gold_exec_time_mean_s"),
        _mean("gen_time_s", "gen_time_mean_s"), _mean("prompt_tokens", "prompt_size_mean"),
        _mean("tables_in_schema_compact", "schema_tables_mean"), _mean("schema_num_columns", "schema_cols_mean"),
        _cont(pred, "0.5", "pred_exec_time_median_s"), _cont(pred, "0.95", "pred_exec_time_p95_s"),
        _cont("gen_time_s", "0.5", "gen_time_median_s"), _cont("gen_time_s", "0.95", "gen_time_p95_s"),
    ]


for _engine in ("mysql", "mariadb"):

    @query(f"p4_metrics_by_dataset_{_engine}", _nine(_by_dataset(_chart_table(_engine), _CHART)))
    def p4(spark, sf, engine=_engine):
        return rounded(P.metrics_by_dataset(chart_rows(spark, sf), engine), 9)


@query(
    "p5_match_rate",
    f"""SELECT dataset, {_share('mysql_vs_mariadb_match', 'match_rate')} FROM ({_CHART}) c
      WHERE mysql_vs_mariadb_match IS NOT NULL AND dataset IS NOT NULL GROUP BY dataset""",
)
def p5(spark, sf):
    return rounded(P.match_rate(chart_rows(spark, sf)))


@query(
    "p6_rate_by_complexity",
    f"""SELECT bucket_order, bucket, coalesce(rate, 0.0) AS rate FROM
      (VALUES (0, 'simple'), (1, 'medium'), (2, 'complex')) b(bucket_order, bucket)
      LEFT JOIN (SELECT complexity_bucket, {_share('mysql_ex', 'rate')} FROM ({FLAT}) f GROUP BY 1) r
      ON complexity_bucket = bucket""",
)
def p6(spark, sf):
    return rounded(P.rate_by_complexity(rows(spark, sf), "mysql_ex"))


@query(
    "p7_ranked_series",
    f"SELECT dataset, ex AS value FROM ({_by_dataset([_share('mysql_ex', 'ex')])}) x ORDER BY value DESC, dataset",
)
def p7(spark, sf):
    table = P.flag_rates(rows(spark, sf), ["mysql_ex"], ["dataset"])
    return rounded(P.ranked_series(table, "mysql_ex"))


@query(
    "p8_schema_compactness",
    _by_dataset([_mean("tables_in_schema_compact", "mean_tables"), _mean("schema_num_columns", "mean_columns")]),
)
def p8(spark, sf):
    return rounded(P.schema_compactness(rows(spark, sf)))


_FLAG_COLUMNS = [
    f"{e}_{f}" for e in ("mysql", "mariadb") for f in ("pred_success", "gold_success", "ex", "ex_given_success")
]


@query(
    "s3_metrics_flags",
    f"SELECT id, {', '.join(f'coalesce({c}, FALSE) AS {c}' for c in _FLAG_COLUMNS)} FROM ({FLAT}) f",
)
def s3(spark, sf):
    texts = rows(spark, sf).select("id", *[F.col(c).cast("string").alias(c) for c in _FLAG_COLUMNS])
    return fill_flags(texts)


def _runs(spark, sf, engine: str) -> DataFrame:
    short = {"mysql": "my", "mariadb": "ma"}[engine]
    base = run(spark, sf, RUNLOG)
    shift = F.when((F.col("id") % 4 == 0) & F.lit(engine == "mariadb"), 1).otherwise(0)
    mark = F.struct(
        F.lit("a:integer").alias("columns"), F.col("n_rows").cast("long").alias("rows"),
        (F.col("n_rows") + shift).cast("decimal(38,0)").alias("sum_a"),
        F.lit(0).cast("decimal(38,0)").alias("sum_b"),
    )
    outcome = F.struct(
        F.col(f"{short}_pred").alias("success"), F.col("n_rows").cast("long").alias("rows"),
        F.col(f"{short}_pred_t").alias("time_s"), F.lit(None).cast("string").alias("error"),
        mark.alias("fingerprint"),
    )
    return base.select("llm", "dataset", "id", outcome.alias("outcome"))


@query(
    "x5_engine_comparison",
    f"""SELECT llm, dataset, id, coalesce(my_pred AND ma_pred, FALSE) AND id % 4 <> 0 AS match,
      CASE WHEN NOT coalesce(my_pred AND ma_pred, FALSE) THEN 'One or both queries failed' END AS reason,
      my_pred AS mysql_success, ma_pred AS mariadb_success,
      CASE WHEN my_pred AND ma_pred THEN CAST(n_rows AS BIGINT) END AS mysql_rows,
      CASE WHEN my_pred AND ma_pred THEN CAST(n_rows AS BIGINT) END AS mariadb_rows,
      round(CASE WHEN my_pred AND ma_pred THEN my_pred_t END, 6) AS mysql_time,
      round(CASE WHEN my_pred AND ma_pred THEN ma_pred_t END, 6) AS mariadb_time,
      round(CASE WHEN my_pred AND ma_pred THEN abs(my_pred_t - ma_pred_t) END, 6) AS time_difference
      FROM ({RUNLOG}) r""",
)
def x5(spark, sf):
    pair = compare_engines(
        _runs(spark, sf, "mysql"), _runs(spark, sf, "mariadb"), ["llm", "dataset", "id"], "mysql", "mariadb"
    )
    return rounded(pair)


def _outcomes(spark, sf) -> DataFrame:
    base = run(spark, sf, RUNLOG)
    tried = F.col("id") % 9 != 0
    outcome = F.struct(
        F.col("my_pred").alias("success"), F.col("id").alias("rows"), F.col("my_gold_t").alias("time_s"),
        F.when(~F.col("my_pred"), "bad column").when(F.col("my_pred"), "").alias("error"),
    )
    return base.select("id", F.when(tried, outcome).alias("o"))


@query(
    "x6_envelope_dotted",
    f"""SELECT id, coalesce(id % 9 <> 0 AND my_pred, FALSE) AS "p.success",
      round(CASE WHEN id % 9 <> 0 THEN my_gold_t END, 6) AS "p.execution_time_s",
      CASE WHEN id % 9 = 0 THEN 'NO_EXECUTION_ATTEMPT' WHEN NOT my_pred THEN 'bad column' WHEN my_pred THEN '' END AS "p.error"
      FROM ({RUNLOG}) r""",
)
def x6_dotted(spark, sf):
    flat = flatten_outcomes(_outcomes(spark, sf), {"p": "o"}, "dotted")
    return flat.withColumn("p.execution_time_s", F.round("`p.execution_time_s`", 6))


@query(
    "x6_envelope_underscored",
    f"""SELECT id, coalesce(id % 9 <> 0 AND my_pred, FALSE) AS p_success,
      round(CASE WHEN id % 9 <> 0 THEN my_gold_t ELSE 0 END, 6) AS p_time_s,
      CASE WHEN id % 9 = 0 THEN 'Not executed' WHEN NOT my_pred THEN 'bad column' END AS p_error_msg,
      CASE WHEN id % 9 = 0 THEN 0 ELSE id END AS p_rows FROM ({RUNLOG}) r""",
)
def x6_underscored(spark, sf):
    return rounded(flatten_outcomes(_outcomes(spark, sf), {"p": "o"}, "underscored"))


@query(
    "x8_attach_predictions",
    f"""SELECT llm, dataset, id, CASE WHEN id % 8 = 0 THEN 'SELECT 1;' ELSE pred_sql END AS pred_sql_raw,
      CASE WHEN id % 8 = 0 THEN 0 ELSE prompt_tokens END AS prompt_tokens,
      CASE WHEN id % 8 = 0 THEN 0 ELSE n_columns END AS completion_tokens,
      CASE WHEN id % 8 <> 0 THEN round(gen_time_s, 6) END AS gen_time_s FROM ({RUNLOG}) r""",
)
def x8(spark, sf):
    base = run(spark, sf, RUNLOG)
    made = base.where("id % 8 <> 0").select(
        "llm", "dataset", "id", F.col("pred_sql").alias("pred_sql_raw"), "prompt_tokens",
        F.col("n_columns").alias("completion_tokens"), "gen_time_s",
    )
    return attach_predictions(base.select("llm", "dataset", "id"), made, ["llm", "dataset", "id"])
