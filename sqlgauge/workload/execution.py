"""Queries that run SQL texts over the given tables and compare their results."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.comparison import all_matches, match_outcomes
from ..operators.execution import OUTCOME_STRUCT, dataset_session, execute_on_dataset, execute_texts, preview, run_pairs, run_query
from ..operators.questions import prepare_questions
from ..operators.records import assemble_records, attach_predictions
from ..plans.benchmark import evaluate_run, prepare_run, report
from ..plans.scratch import materialize, scratch_path
from ..sources.binding import bind_tables
from ..sources.corpus import typed_entries
from ..sources.introspect import CATALOG, introspect
from .inputs import QUESTIONS
from .questions import entries
from .registry import TABLES, query, run
from .sqltext import _DIFFICULTY
from .questions import _GOLD, _NAT, _SEG, _fill

# Result shapes of the workload, written the way the corpora write SQL: any letter case, "text" literals.
SHAPES = {
    "w1_filter": 'SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = "BUILDING" AND c_nationkey = 3 ;',
    "w2_distinct": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM ORDERS ;",
    "w3_comma_join": (
        "SELECT DISTINCT CUSTOMERalias0.C_CUSTKEY FROM orders AS ORDERSalias0 , customer AS CUSTOMERalias0 , "
        "nation AS NATIONalias0 , region AS REGIONalias0 WHERE ORDERSalias0.O_CUSTKEY = CUSTOMERalias0.C_CUSTKEY "
        "AND CUSTOMERalias0.C_NATIONKEY = NATIONalias0.N_NATIONKEY AND NATIONalias0.N_REGIONKEY = "
        'REGIONalias0.R_REGIONKEY AND REGIONalias0.R_NAME = "ASIA" ;'
    ),
    "w4_join": (
        "SELECT o_orderkey, c_name, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        'JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = "FURNITURE"'
    ),
    "w5_self_join": (
        "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey AS next_part FROM lineitem AS a , lineitem AS b "
        "WHERE a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
    ),
    "w6_in_subquery": (
        "SELECT c_custkey FROM customer WHERE c_custkey IN ( SELECT o_custkey FROM orders WHERE o_totalprice > 400000 )"
    ),
    "w7_nested_one": (
        "SELECT o_orderkey FROM orders WHERE o_totalprice > ( SELECT AVG(o_totalprice) FROM orders )"
    ),
    "w7_nested_two": (
        "SELECT s_suppkey FROM supplier WHERE s_suppkey IN ( SELECT l_suppkey FROM lineitem WHERE l_partkey IN "
        '( SELECT p_partkey FROM part WHERE p_type = "PROMO" ) )'
    ),
    "w8_count": "SELECT COUNT(*) AS n FROM lineitem ;",
    "w9_group_by": (
        "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem "
        "GROUP BY l_returnflag, l_linestatus"
    ),
    "w10_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "w11_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "w11_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "w11_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "w12_top": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
}


def _ansi(sql: str) -> str:
    return sql.replace('"', "'").rstrip(" ;")


def _bind(spark, sf, *texts: str) -> None:
    """Bind the given tables that the texts mention."""
    words = set(re.findall(r"\w+", " ".join(texts).lower()))
    bind_tables(spark, sf, [t for t in TABLES if t in words])


def _register(name: str, sql: str) -> None:
    check = _ansi(sql)
    if name == "w3_comma_join":
        check = check.replace("CUSTOMERalias0.C_CUSTKEY FROM", 'CUSTOMERalias0.C_CUSTKEY AS "C_CUSTKEY" FROM')

    @query(name, check)
    def shape(spark, sf):
        _bind(spark, sf, sql)
        return run_query(spark, sql)


for _name, _sql in SHAPES.items():
    _register(_name, _sql)


SHOP = ["customer", "orders", "lineitem"]

FAILING = {
    "unknown_column": "SELECT ids FROM orders WHERE id IN ( SELECT id FROM orders )",
    "unknown_table": "SELECT * FROM order_lines",
    "not_sql": "the answer is 42",
    "command": "DROP TABLE orders",
    "insert": "INSERT INTO orders SELECT * FROM orders",
    "two_statements": "SELECT 1; SELECT 2",
    "closed_early": "SELECT 1) UNION (SELECT 2",
    "bad_cast": "SELECT CAST(o_orderpriority AS INT) AS x FROM orders",
}


def _outcomes(spark, sf, texts: dict[str, str]):
    _bind(spark, sf, *texts.values())
    names = spark.createDataFrame(list(texts.items()), "name string, sql string")
    ran = execute_texts(spark, texts.values())
    return names.join(ran, "sql").select(
        "name", F.col("outcome.success").alias("success"), F.col("outcome.rows").alias("n_rows"),
        (F.col("outcome.error").isNotNull()).alias("has_error"), (F.col("outcome.time_s") > 0).alias("timed"),
    )


@query(
    "x1_execute",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, TRUE AS success, (SELECT count(*) FROM ({_ansi(s)}) q) AS n_rows, FALSE AS has_error, TRUE AS timed"
        for n, s in SHAPES.items()
    ),
)
def x1(spark, sf):
    return _outcomes(spark, sf, SHAPES)


# One text per order, about the orders of its priority and status; the six lowest bits of its key decide the spelling.
_SPELT = """SELECT o_orderpriority AS priority, o_orderstatus AS status, concat(
    CASE WHEN bits & 1 = 0 THEN 'SELECT' ELSE '  select' END, ' o_orderkey ', CASE WHEN bits & 2 = 0 THEN 'FROM' ELSE 'from  ' END,
    CASE WHEN bits & 4 = 0 THEN ' orders' ELSE ' ORDERS' END, CASE WHEN bits & 8 = 0 THEN '' ELSE ' AS o' END, ' WHERE ',
    CASE WHEN bits & 16 = 0 THEN concat(p, ' AND ', s) ELSE concat('(', s, ') AND (', p, ')') END,
    CASE WHEN bits & 32 = 0 THEN '' ELSE ' ;' END) AS sql
  FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey & 63 AS bits, concat('o_orderpriority = "', o_orderpriority, '"') AS p,
    concat('O_ORDERSTATUS = "', o_orderstatus, '"') AS s FROM @orders) x"""


@query(
    "x1_shared_plans",
    """SELECT o_orderpriority AS priority, o_orderstatus AS status, count(DISTINCT o_orderkey & 63) AS n_texts, CAST(1 AS BIGINT) AS n_runs,
      count(*) AS least_rows, count(*) AS most_rows, TRUE AS success FROM orders GROUP BY ALL""",
)
def x1_shared(spark, sf):
    """Texts of one plan are run once, and each has the whole outcome."""
    spelt = materialize(run(spark, sf, _SPELT), "spelt")
    _bind(spark, sf, "orders")
    rows = spelt.distinct().join(execute_texts(spark, spelt.select("sql")), "sql")
    return rows.groupBy("priority", "status").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_distinct("run").alias("n_runs"), F.min("outcome.rows").alias("least_rows"),
        F.max("outcome.rows").alias("most_rows"), F.every("outcome.success").alias("success"),
    )


@query(
    "w13_failures",
    " UNION ALL ".join(
        f"SELECT '{n}' AS name, FALSE AS success, CAST(0 AS BIGINT) AS n_rows, TRUE AS has_error, TRUE AS timed" for n in FAILING
    ),
)
def w13(spark, sf):
    return _outcomes(spark, sf, FAILING)


@query(
    "x2_on_dataset",
    f"""SELECT 'shop' AS dataset, TRUE AS success, count(*) AS n_rows, NULL AS error FROM ({_ansi(SHAPES['w4_join'])}) q
      UNION ALL SELECT 'absent', FALSE, 0, 'Unknown dataset: absent'""",
)
def x2(spark, sf):
    known = {"shop": (sf, SHOP)}
    parts = [execute_on_dataset(spark, known, name, SHAPES["w4_join"]) for name in ("shop", "absent")]
    return parts[0].union(parts[1]).select("dataset", "success", F.col("rows").alias("n_rows"), "error")


def _statuses(spark, sf) -> str:
    """The letters that orders have as a status."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderstatus").distinct().collect()  # one letter each
    return "".join(sorted(r[0] for r in rows if r[0] is not None))


def _by_status(spark, sf, statuses: str = "FO") -> dict:
    """Datasets with the same table names: the orders of each status."""
    root = scratch_path(spark, "datasets")
    for status in statuses:
        own = spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_orderstatus") == status)
        own.write.parquet(f"{root}/{status}/orders.parquet")
    return {f"status_{s}": (f"{root}/{s}", ["orders"]) for s in statuses}


@query(
    "x2_two_datasets",
    """SELECT 'status_' || o_orderstatus AS dataset, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_gold,
      count(*) = count(DISTINCT o_custkey) AS match FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus""",
)
def x2_two(spark, sf):
    """The same texts on two datasets have two outcomes each."""
    return _two_texts(spark, _by_status(spark, sf))


@query(
    "x2_all_statuses",
    """SELECT 'status_' || o_orderstatus AS dataset, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_gold,
      count(*) = count(DISTINCT o_custkey) AS match FROM orders GROUP BY o_orderstatus""",
)
def x2_all(spark, sf):
    """As x2_two_datasets, over every order: each status is a dataset."""
    return _two_texts(spark, _by_status(spark, sf, _statuses(spark, sf)))


def _two_texts(spark, known: dict):
    texts = [(name, "SELECT o_custkey FROM orders", "SELECT DISTINCT o_custkey FROM ORDERS ;") for name in known]
    rows = spark.createDataFrame(texts, "dataset string, pred_sql string, gold_sql_exec string")
    return match_outcomes(run_pairs(rows, datasets=known)).select(
        "dataset", F.col("pred.rows").alias("n_rows"), F.col("gold.rows").alias("n_gold"), "match"
    )


# One entry per order, in the raw form of a corpus; ids follow the order keys within each status.
_RUN_ENTRIES = """SELECT concat('status_', o_orderstatus) AS dataset, o_orderkey AS entry_pos, 'train' AS `query-split`,
  '["SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority = \\\\"prio0\\\\" ;"]' AS sql,
  concat('[{"text": "how many orders have prio0", "question-split": "test", "variables": {"prio0": "', o_orderpriority, '"}}]')
    AS sentences, '[]' AS variables, CAST(NULL AS STRING) AS difficulty
  FROM @orders WHERE o_orderstatus IN ('F', 'O')"""
_ALL_ENTRIES = _RUN_ENTRIES.replace(" WHERE o_orderstatus IN ('F', 'O')", "")


@query(
    "x0_whole_run",
    """SELECT dataset, count(*) AS n_questions, round(avg(CASE WHEN id % 4 <> 2 THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
      round(avg(CASE WHEN id % 4 IN (0, 3) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      count(*) FILTER (WHERE id % 4 = 0) AS n_repaired FROM (
        SELECT 'status_' || o_orderstatus AS dataset, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS id
        FROM orders WHERE o_orderstatus IN ('F', 'O')) q GROUP BY dataset""",
)
def x0(spark, sf):
    """A whole run over two datasets: prepare, predict, clean, run, compare, record, summarize."""
    return _whole_run(spark, sf, _by_status(spark, sf), _RUN_ENTRIES)


@query(
    "x0_all_statuses",
    """SELECT dataset, count(*) AS n_questions, round(avg(CASE WHEN id % 4 <> 2 THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
      round(avg(CASE WHEN id % 4 IN (0, 3) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
      count(*) FILTER (WHERE id % 4 = 0) AS n_repaired FROM (
        SELECT 'status_' || o_orderstatus AS dataset, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS id
        FROM orders) q GROUP BY dataset""",
)
def x0_all(spark, sf):
    """As x0_whole_run, over every order: each status is a dataset."""
    return _whole_run(spark, sf, _by_status(spark, sf, _statuses(spark, sf)), _ALL_ENTRIES)


def _whole_run(spark, sf, known: dict, recipe: str):
    parts = [introspect(dataset_session(spark, known, name), name, ["orders"]) for name in sorted(known)]
    catalog = spark.createDataFrame([tuple(r) for p in parts for r in p.collect()], CATALOG)  # a few columns per dataset
    prepared = materialize(prepare_run(typed_entries(run(spark, sf, recipe)), catalog), "prepared")
    wanted = F.concat(F.lit("SELECT COUNT(*) AS n FROM "), F.lit("{} WHERE o_orderpriority = '"), F.col("variables")["prio0"], F.lit("'"))
    kind = F.col("id") % 4
    text = (
        F.when(kind == 0, F.replace(wanted, F.lit("{}"), F.lit("order")))  # to be repaired
        .when(kind == 1, "SELECT COUNT(*) AS n FROM orders WHERE o_orderpriority = 'none'")
        .when(kind == 2, "SELECT nope FROM orders")
        .otherwise(F.replace(F.lower(wanted), F.lower(F.col("variables")["prio0"]), F.col("variables")["prio0"]))
    )
    text = F.when(kind == 3, F.replace(text, F.lit("{}"), F.lit("ORDERS"))).otherwise(text)
    made = prepared.select(
        "dataset", "id", text.alias("pred_sql_raw"), F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"),
        F.lit(0.5).alias("gen_time_s"),
    )
    records = materialize(evaluate_run(prepared, made, "alpha", "mysql", datasets=known), "records")
    summary = report(records).where("bucket IS NULL")
    repaired = records.groupBy(F.col("dataset").alias("of")).agg(
        F.count_if(F.size("pred_repairs") > 0).alias("n_repaired")
    )
    return summary.join(repaired, F.col("dataset") == F.col("of")).select(
        "dataset", "n_questions", F.round("mysql_pred_success_rate", 6).alias("success_rate"),
        F.round("mysql_execution_accuracy_ex", 6).alias("accuracy"), "n_repaired",
    )


@query("s7_binding", f"SELECT * FROM ({_ansi(SHAPES['w9_group_by'])}) q")
def s7(spark, sf):
    return run_query(dataset_session(spark, {"shop": (sf, SHOP)}, "shop"), SHAPES["w9_group_by"])


# Pairs of predicted and gold SQL; every one reads whole tables.
PAIRS = {
    "same": ("SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, o_custkey FROM orders"),
    "row_order": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM orders"),
    "column_order": ("SELECT o_custkey, o_orderkey FROM orders", "SELECT o_orderkey, o_custkey FROM orders"),
    "column_name": ("SELECT o_orderkey AS k FROM orders", "SELECT o_orderkey FROM orders"),
    "copies": ("SELECT o_custkey FROM orders", "SELECT DISTINCT o_custkey FROM orders"),
    "join_or_in": (
        "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey",
        "SELECT c_custkey FROM customer WHERE c_custkey IN ( SELECT o_custkey FROM orders )",
    ),
    "one_value": (
        "SELECT l_orderkey, CASE WHEN l_orderkey = 7 THEN 'X' ELSE l_returnflag END AS f FROM lineitem",
        "SELECT l_orderkey, l_returnflag AS f FROM lineitem",
    ),
    "nulls": (
        "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS v FROM orders",
        "SELECT CASE WHEN o_orderkey % 2 <> 1 THEN o_custkey ELSE NULL END AS v FROM orders",
    ),
    "shifted_copies": (
        "SELECT o_orderstatus FROM orders UNION ALL SELECT 'F' FROM orders",
        "SELECT o_orderstatus FROM orders UNION ALL SELECT 'O' FROM orders",
    ),
    "empty": ("SELECT o_orderkey FROM orders WHERE 1 = 0", "SELECT o_orderkey FROM orders WHERE o_orderkey < 0"),
    "sum_in_any_order": (
        "SELECT l_suppkey, SUM(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY l_suppkey",
        "SELECT l_suppkey, SUM(v) AS v FROM (SELECT l_suppkey, l_extendedprice * (1 - l_discount) AS v FROM lineitem "
        "ORDER BY l_tax, l_orderkey DESC) q GROUP BY l_suppkey",
    ),
    "small_decimals": (
        "SELECT l_orderkey, CAST(l_quantity / 1e12 AS DECIMAL(38,18)) AS v FROM lineitem",
        "SELECT l_orderkey, CAST((l_quantity + 1) / 1e12 AS DECIMAL(38,18)) AS v FROM lineitem",
    ),
    "long_decimals": (
        "SELECT CAST(o_orderkey AS DECIMAL(30,0)) * 100000000 AS v FROM orders",
        "SELECT CAST(o_orderkey AS DECIMAL(30,0)) * 100000000 AS v FROM orders",
    ),
    "comma_or_join": (
        "SELECT n_name, COUNT(*) AS n FROM customer , nation WHERE c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, COUNT(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
}
# Which pairs have the same columns and types; for the others the answer is no before any row is read.
_SAME_COLUMNS = [n for n in PAIRS if n != "column_name"]


def _named(sql: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({_ansi(sql)}) z"


def _pair_check(name: str) -> str:
    pred, gold = PAIRS[name]
    if name not in _SAME_COLUMNS:
        return f"SELECT '{name}' AS pair, FALSE AS match"
    if name == "sum_in_any_order":
        pred = gold = "SELECT l_suppkey, round(SUM(l_extendedprice * (1 - l_discount)), 2) AS v FROM lineitem GROUP BY l_suppkey"
    columns = {"same": "o_orderkey, o_custkey", "column_order": "o_orderkey, o_custkey"}.get(name, "*")
    a, b = _named(pred, columns), _named(gold, columns)
    return (
        f"SELECT '{name}' AS pair, NOT EXISTS (SELECT * FROM ({a}) p EXCEPT ALL SELECT * FROM ({b}) g) "
        f"AND NOT EXISTS (SELECT * FROM ({b}) g EXCEPT ALL SELECT * FROM ({a}) p) AS match"
    )


@query("x3_result_equality", " UNION ALL ".join(_pair_check(n) for n in PAIRS))
def x3(spark, sf):
    _bind(spark, sf, *[sql for pair in PAIRS.values() for sql in pair])
    return all_matches({n: (run_query(spark, p), run_query(spark, g)) for n, (p, g) in PAIRS.items()})


# Sums per supplier against the same a little off: by less than the tolerance in every row, by more, and in one row only.
_OFF = {"near": "1 + 2e-13", "far": "1 + 1e-9", "one_far": "CASE WHEN l_suppkey = 7 THEN 1 + 1e-9 ELSE 1 - 2e-13 END"}
_SUMS = "SELECT l_suppkey, SUM(l_extendedprice * l_tax) * ({}) AS v FROM lineitem GROUP BY l_suppkey"


@query(
    "x3_close_sums",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS pair, NOT EXISTS (SELECT * FROM ({_SUMS.format('1')}) a JOIN ({_SUMS.format(off)}) b USING (l_suppkey)
        WHERE abs(a.v - b.v) >= 1e-11 * greatest(abs(a.v), abs(b.v))) AS match"""
        for name, off in _OFF.items()
    ),
)
def x3_close(spark, sf):
    """Doubles that are close match, also on either side of a rounding border; one that is not close does not."""
    _bind(spark, sf, "lineitem")
    return all_matches({n: (run_query(spark, _SUMS.format("1")), run_query(spark, _SUMS.format(off))) for n, off in _OFF.items()})


_FAILED_PAIRS = {"bad_pred": (FAILING["unknown_column"], PAIRS["same"][1]), "bad_gold": (PAIRS["same"][0], FAILING["not_sql"])}


@query(
    "x4_pred_vs_gold",
    " UNION ALL ".join(_pair_check(n) for n in PAIRS)
    + " UNION ALL SELECT 'bad_pred', FALSE UNION ALL SELECT 'bad_gold', FALSE",
)
def x4(spark, sf):
    _bind(spark, sf, *[sql for pair in PAIRS.values() for sql in pair])
    pairs = PAIRS | _FAILED_PAIRS
    rows = spark.createDataFrame([(n, p, g) for n, (p, g) in pairs.items()], "pair string, pred_sql string, gold_sql string")
    outcomes = execute_texts(spark, [sql for pair in pairs.values() for sql in pair])
    for side in ("pred", "gold"):
        ran = outcomes.select(F.col("sql").alias(f"{side}_sql"), F.col("outcome").alias(side))
        rows = rows.join(ran, f"{side}_sql", "left")
    return match_outcomes(rows).select("pair", "match")


@query(
    "x7_records",
    f"""SELECT q.dataset, q.id, 'alpha' AS llm, 'mysql' AS rdbms, q.question_text, {_fill(_fill('question_text', 'segment0', _SEG), 'nation0', _NAT)}
      AS question_text_filled, q.gold_sql_first, {_GOLD} AS gold_sql_exec,
      CAST(CASE WHEN q.sent_pos = 1 AND q.c % 4 = 0 THEN 2 WHEN q.c % 6 = 4 THEN 3 WHEN q.c % 10 = 9 THEN 1 ELSE derived END AS BIGINT) AS difficulty,
      CASE WHEN q.entry_pos % 5 = 0 THEN 'SELECT 1;' ELSE 'SELECT ' || q.entry_pos::VARCHAR END AS pred_sql_raw,
      q.entry_pos % 3 = 0 AS pred_success, CASE WHEN q.entry_pos % 3 <> 0 THEN 'NO_EXECUTION_ATTEMPT' END AS pred_error,
      q.entry_pos % 2 = 0 AS mysql_pred_vs_gold_match
      FROM ({QUESTIONS}) q JOIN (SELECT entry_pos AS pos, derived FROM ({_DIFFICULTY}) x) d ON q.entry_pos = pos""",
)
def x7(spark, sf):
    questions = prepare_questions(entries(spark, sf))
    made = questions.where("entry_pos % 5 <> 0").select(
        "dataset", "id", F.concat(F.lit("SELECT "), F.col("entry_pos").cast("string")).alias("pred_sql_raw"),
        F.lit(10).alias("prompt_tokens"), F.lit(5).alias("completion_tokens"), F.lit(0.5).alias("gen_time_s"),
    )
    ran = F.struct(
        F.lit(True).alias("success"), F.lit(1).cast("long").alias("rows"), F.lit(0.1).alias("time_s"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("struct<columns:string,rows:bigint,sum_a:decimal(38,0),sum_b:decimal(38,0)>").alias("fingerprint"),
    ).cast(OUTCOME_STRUCT)
    rows = (
        attach_predictions(questions, made, ["dataset", "id"])
        .withColumn("pred_sql", F.col("pred_sql_raw"))
        .withColumn("schema_compact", F.lit("customer(c_custkey, c_name)"))
        .withColumn("pred", F.when(F.col("entry_pos") % 3 == 0, ran))
        .withColumn("gold", ran)
        .withColumn("match", F.col("entry_pos") % 2 == 0)
    )
    return assemble_records(rows, "alpha", "mysql").select(
        "dataset", "id", "llm", "rdbms", "question_text", "question_text_filled", "gold_sql_first", "gold_sql_exec",
        F.col("difficulty").cast("long").alias("difficulty"), "pred_sql_raw",
        F.col("`mysql_pred.success`").alias("pred_success"), F.col("`mysql_pred.error`").alias("pred_error"),
        "mysql_pred_vs_gold_match",
    )


@query("x9_preview", f"SELECT * FROM ({_ansi(SHAPES['w12_top'])}) q ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def x9(spark, sf):
    _bind(spark, sf, SHAPES["w12_top"])
    return preview(spark.sql(SHAPES["w12_top"]))
