"""Input recipes over the given tables, in SQL that Spark and the checking engine both run."""

from __future__ import annotations

# --- question corpus: one entry per customer -----------------------------------------------------------

_TEMPLATES = (
    'SELECT c_name FROM customer WHERE c_mktsegment = "segment0" ;',
    "SELECT COUNT(*) FROM CUSTOMER AS CUSTOMERalias0 , NATION AS NATIONalias0 "
    'WHERE CUSTOMERalias0.C_NATIONKEY = NATIONalias0.N_NATIONKEY AND NATIONalias0.N_NAME = "nation0" ;',
    "SELECT n_name , COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "GROUP BY n_name HAVING COUNT(*) > number0 ;",
    "SELECT c_name FROM customer WHERE c_custkey IN ( SELECT o_custkey FROM orders "
    'WHERE o_totalprice > number0 ) AND c_mktsegment = "segment0" ;',
    "SELECT c_name FROM customer UNION SELECT s_name FROM supplier ;",
    "SELECT o_orderkey FROM orders , customer , nation , region WHERE o_custkey = c_custkey "
    'AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = "region0" ;',
)
_TEMPLATE_CASE = (
    "CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEMPLATES)) + " END"
)

CORPUS_BASE = f"""
SELECT lower(c_mktsegment) AS dataset, c_custkey AS entry_pos, c_custkey AS c, n_name,
  CASE WHEN c_custkey % 11 = 0 THEN 'nation0 group' WHEN c_custkey % 9 = 0 THEN c_mktsegment || ' $1'
       ELSE c_mktsegment END AS seg,
  {_TEMPLATE_CASE} AS tmpl
FROM @customer JOIN @nation ON c_nationkey = n_nationkey
"""

_TEXT0 = "list all the customers of segment0 from nation0"
_TEXT1 = "how many nation0 and nation01 in segment0"

CORPUS = f"""
SELECT dataset, entry_pos,
  '{{' || CASE c % 3 WHEN 0 THEN '' WHEN 1 THEN '"query-split": "train", ' ELSE '"query-split": "test", ' END
  || '"sql": ' || CASE c % 10 WHEN 0 THEN '"' || replace(tmpl, '"', chr(92) || '"') || '"' WHEN 9 THEN '[]'
     ELSE '["' || replace(tmpl, '"', chr(92) || '"') || '", "SELECT 1"]' END
  || CASE WHEN c % 6 = 4 THEN ', "difficulty": 3' ELSE '' END
  || ', "sentences": ' || CASE WHEN c % 13 = 0 THEN '"none"' ELSE
     '[{{"text": "{_TEXT0}", "question-split": "dev", "variables": {{"segment0": "' || seg
     || '", "nation0": "' || n_name || '"}}}}' || CASE WHEN c % 7 = 0 THEN ', 3' ELSE '' END
     || ', {{"text": "{_TEXT1}", ' || CASE WHEN c % 4 = 0 THEN '"difficulty": 2, ' ELSE '' END
     || '"variables": ' || CASE WHEN c % 8 = 0 THEN '[]'
        ELSE '{{"segment0": null, "nation0": "' || n_name || '"}}' END || '}}]' END
  || ', "variables": ' || CASE WHEN c % 17 = 0 THEN '"bad"' ELSE
     '[{{"name": "number0", "example": "' || CAST(c % 100 AS STRING) || '"}}, {{"name": "segment0", "example": "EX"}}, '
     || '{{"example": "x"}}, 5, {{"name": "region0", "example": "ASIA"}}]' END || '}}' AS entry
FROM ({CORPUS_BASE}) base
"""

# The questions of the corpus above, derived without its JSON.
QUESTIONS = f"""
SELECT s.*, row_number() OVER (PARTITION BY dataset ORDER BY entry_pos, sent_pos) - 1 AS id,
  CASE c % 3 WHEN 0 THEN '' WHEN 1 THEN 'train' ELSE 'test' END AS query_split,
  CASE WHEN c % 10 = 9 THEN '' ELSE tmpl END AS gold_sql_first
FROM (
  SELECT b.*, 0 AS sent_pos, '{_TEXT0}' AS question_text, 'dev' AS question_split, TRUE AS has_vars,
    seg AS v_seg, n_name AS v_nat FROM ({CORPUS_BASE}) b WHERE c % 13 <> 0
  UNION ALL
  SELECT b.*, 1, '{_TEXT1}', '', c % 8 <> 0, NULL, CASE WHEN c % 8 <> 0 THEN n_name END
  FROM ({CORPUS_BASE}) b WHERE c % 13 <> 0
) s
"""

# --- model output: one per order -----------------------------------------------------------------------

CONTINUATIONS = """
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN 'c_name FROM customer WHERE c_custkey = ' || CAST(o_custkey AS STRING) || '; SELECT 2'
  WHEN 1 THEN 'c_name' || chr(10) || 'FROM customer;  trailing'
  WHEN 2 THEN 'o_orderkey FROM orders' || chr(10) || chr(10) || '### Question: next'
  WHEN 3 THEN '  COUNT(*) FROM orders' || chr(10) || 'second line'
  WHEN 4 THEN '1' || chr(13) || chr(10) || 'x' || chr(13) || chr(10) || chr(13) || chr(10) || 'y'
  WHEN 5 THEN ''
  WHEN 6 THEN '*, ' || o_orderstatus || '   '
  ELSE ';' END AS generated
FROM @orders
"""

ANSWERS = """
SELECT o_orderkey, CASE o_orderkey % 8
  WHEN 0 THEN '### SQL:' || chr(10) || 'SELECT ' || CAST(o_custkey AS STRING) || '; -- done'
  WHEN 1 THEN '### SQL: a ### SQL: ```sql' || chr(10) || 'SELECT 1 FROM orders;' || chr(10) || '```' || chr(10) || 'text'
  WHEN 2 THEN 'Sure: ```' || chr(10) || 'SELECT c_name FROM customer' || chr(10) || '``` bye'
  WHEN 3 THEN '### SQL:' || chr(10) || '```SQL SELECT 2'
  WHEN 4 THEN '  SELECT * FROM nation  '
  WHEN 5 THEN '### SQL:'
  WHEN 6 THEN '### Question: q' || chr(10) || '### SQL:' || chr(10) || 'SELECT ' || o_orderstatus || chr(10) || 'FROM orders'
  ELSE '### SQL: SELECT a; ```SELECT b;```' END AS answer
FROM @orders
"""

PREDICTIONS = """
SELECT o_orderkey, CASE o_orderkey % 10
  WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || CAST(o_custkey AS STRING)
  WHEN 1 THEN 'SELECT * FROM ORDERS JOIN Customer ON o_custkey = c_custkey '
  WHEN 2 THEN 'SELECT * FROM order WHERE ''FROM Orders'' = "Orders"'
  WHEN 3 THEN 'SELECT * FROM suppliers AS s JOIN `Nations` ON s_nationkey = n_nationkey'
  WHEN 4 THEN 'SELECT * FROM linitem WHERE x = ''it''''s from PARTS'' AND LINEITEM.l_tax > 0'
  WHEN 5 THEN 'SELECT * FROM xyz WHERE y = ' || CAST(o_custkey AS STRING)
  WHEN 6 THEN 'DELETE FROM Parts WHERE p_partkey = 1;'
  WHEN 7 THEN 'SELECT a FROM evnts , customers WHERE ORDERS.a = 1'
  WHEN 8 THEN 'SELECT * FROM (SELECT * FROM Regions) r JOIN "nation" ON 1 = 1'
  ELSE '' END AS sql
FROM @orders
"""

# --- run log: one record per event -----------------------------------------------------------------------

RUNLOG = """
SELECT event_id AS id, event_type AS dataset,
  CASE WHEN event_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS llm,
  CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS query_split,
  CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS question_split,
  'question of user ' || CAST(user_id AS STRING) AS question_text,
  CASE event_id % 6 WHEN 0 THEN 'SELECT a FROM t' WHEN 1 THEN 'SELECT a FROM t JOIN u ON t.x = u.x'
    WHEN 2 THEN 'select a from t where b in (select c from u where d in (select 1))' ELSE '' END AS gold_sql_exec,
  CASE event_id % 6 WHEN 3 THEN 'SELECT a FROM t JOIN u JOIN v JOIN w' ELSE '' END AS gold_sql_first,
  CASE event_id % 6 WHEN 4 THEN 'SELECT 1' WHEN 5 THEN '' ELSE 'SELECT x FROM y' END AS pred_sql,
  CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'orders(a, b)' WHEN 2 THEN 'orders(a, b)' || chr(10) || 'part(c)'
    ELSE 'orders(a)' || chr(10) || chr(10) || 'part: c, d' || chr(10) || 'nation (n)' || chr(10) || 'orders(z)' END AS schema_compact,
  CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS n_tables,
  CAST(user_id % 9 AS INT) AS n_columns, CAST(100 + user_id % 50 AS INT) AS prompt_tokens,
  CASE WHEN event_id % 17 <> 0 THEN round(value / 7, 6) END AS gen_time_s,
  CASE WHEN event_id % 7 = 3 THEN NULL ELSE event_id % 7 <> 0 END AS my_pred,
  CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_id % 5 <> 0 END AS ma_pred,
  event_id % 31 <> 0 AS my_gold,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id % 37 <> 0 END AS ma_gold,
  CASE WHEN event_id % 19 <> 0 THEN value / 100 END AS my_pred_t,
  CASE WHEN event_id % 23 <> 0 THEN value / 90 END AS ma_pred_t,
  value / 80 AS my_gold_t, value / 70 AS ma_gold_t,
  CASE WHEN event_id % 11 = 5 THEN NULL ELSE value > 20 END AS my_ex,
  CASE WHEN event_id % 13 = 7 THEN NULL ELSE value > 25 END AS ma_ex,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 4 <> 0 END AS cross_match,
  CAST(floor(value) AS INT) AS n_rows
FROM @events
"""

# --- schema catalog: 16 parts make one dataset, each part is a table -------------------------------------

_W1 = "split_part(p_name, ' ', 1)"
_W2 = "split_part(p_name, ' ', 2)"


def _table_name(p: str = "") -> str:
    w1, w2 = (w.replace("p_name", f"{p}p_name") for w in (_W1, _W2))
    k = f"CAST({p}p_partkey % 16 AS STRING)"
    return (
        f"CASE {p}p_partkey % 4 WHEN 1 THEN {w1} || '_' || {w2} || 's_' || {k} "
        f"WHEN 2 THEN upper(substr({w1}, 1, 1)) || substr({w1}, 2) || upper(substr({w2}, 1, 1)) || substr({w2}, 2) || {k} "
        f"ELSE {w1} || '_' || {w2} || '_' || {k} END"
    )


_COLUMNS = (
    ("part_id", "int"), ("supplierName", "varchar(25)"), ("order_date", "date"), ("unitPrice", "float(3,2)"),
    ("qty2sold", "int"), ("region_key", "int"), ("comments", "text"),
)
# Which columns a table of each width has; joined by width.
_COLUMN_ROWS = " UNION ALL ".join(
    f"SELECT {width} AS width, {i} AS col_pos, '{c}' AS col_name, '{t}' AS col_type"
    for width in range(2, 8) for i, (c, t) in enumerate(_COLUMNS[:width])
)

CATALOG = f"""
SELECT 'd' || CAST(CAST(floor(p_partkey / 16) AS BIGINT) AS STRING) AS dataset, {_table_name()} AS table_name,
  col_pos, col_name, col_type, col_pos > 0 AS is_nullable,
  CASE col_pos WHEN 4 THEN '''0''' WHEN 0 THEN '' END AS col_default,
  CASE WHEN col_pos = 0 THEN 0 WHEN col_pos = 1 AND p_partkey % 3 = 0 THEN 1 END AS pk_pos
FROM @part JOIN ({_COLUMN_ROWS}) cols ON width = 2 + p_size % 6
"""

# The first key of slots 1, 4, 7, ... points one table back, the second of slots 3, 7, 11, 15 three back.
_KEY_SLOTS = " UNION ALL ".join(
    [f"SELECT {k} AS slot, 0 AS fk_pos, 1 AS back" for k in range(1, 16, 3)]
    + [f"SELECT {k}, 1, 3" for k in range(3, 16, 4)]
)

FOREIGN_KEYS = f"""
SELECT 'd' || CAST(CAST(floor(t.p_partkey / 16) AS BIGINT) AS STRING) AS dataset, {_table_name('t.')} AS table_name,
  f.fk_pos, 'part_id' AS col_name, {_table_name('r.')} AS ref_table, 'part_id' AS ref_column
FROM @part t JOIN ({_KEY_SLOTS}) f
  ON f.slot = t.p_partkey % 16
JOIN @part r ON r.p_partkey = t.p_partkey - f.back
"""

# --- questions about that catalog: one per order ---------------------------------------------------------

LINK_QUESTIONS = """
SELECT o_orderkey AS id, 'd' || CAST(CAST(floor(o_custkey / 12) AS BIGINT) AS STRING) AS dataset,
  CASE o_orderkey % 5
  WHEN 0 THEN 'list all the red widgets with order dates in 1998'
  WHEN 1 THEN 'How many hot plates does Region_Key 7 have for ' || lower(substr(o_orderpriority, 3))
  WHEN 2 THEN 'give me unitPrices and qty2sold of large rods'
  WHEN 3 THEN 'what comments mention supplier names and small rings'
  ELSE 'zzz' END AS question
FROM @orders
"""
