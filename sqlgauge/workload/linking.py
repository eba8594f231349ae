"""Queries over schema catalogs: rendering, linking, completeness, prompts."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.idents import STOPWORDS, identifier_tokens, question_tokens
from ..functions.sqltext import schema_preview
from ..operators import catalog as C
from ..operators import linking as L
from ..operators import prompts as P
from ..operators.similarity import add_ratio
from ..plans.scratch import materialize
from ..sources.corpus import manifest_rows
from ..sources.ddl import choose_dialect, parse_columns, parse_foreign_keys, spark_type
from .inputs import CATALOG, CORPUS, FOREIGN_KEYS, LINK_QUESTIONS
from .registry import TABLES, query, run
from .sqltext import catalog as given_catalog

K = 4


def catalog(spark, sf) -> DataFrame:
    return run(spark, sf, CATALOG, busy="part").toDF(
        "dataset", "table", "col_pos", "column", "type", "nullable", "default", "pk_pos"
    )


def foreign_keys(spark, sf) -> DataFrame:
    return run(spark, sf, FOREIGN_KEYS).select(
        "dataset", F.col("table_name").alias("table"), "fk_pos", F.array("col_name").alias("columns"),
        "ref_table", F.array("ref_column").alias("ref_columns"),
    )


_DEFS = f"""SELECT dataset, table_name, 0 AS part, col_pos AS spot, '    ' || col_name || ' ' || col_type
    || CASE WHEN is_nullable THEN '' ELSE ' NOT NULL' END
    || CASE WHEN coalesce(col_default, '') <> '' THEN ' DEFAULT ' || col_default ELSE '' END AS line FROM ({CATALOG}) c
  UNION ALL SELECT dataset, table_name, 1, 0, '    PRIMARY KEY (' || string_agg(col_name, ', ' ORDER BY pk_pos) || ')'
    FROM ({CATALOG}) c WHERE pk_pos IS NOT NULL GROUP BY dataset, table_name
  UNION ALL SELECT dataset, table_name, 2, fk_pos, '    FOREIGN KEY (' || col_name || ') REFERENCES ' || ref_table
    || '(' || ref_column || ')' FROM ({FOREIGN_KEYS}) f"""


@query(
    "l1_render_create",
    f"""SELECT dataset, string_agg(ddl, chr(10) ORDER BY table_name) AS ddl FROM (
      SELECT dataset, table_name, 'CREATE TABLE ' || table_name || ' (' || chr(10)
        || string_agg(line, ',' || chr(10) ORDER BY part, spot) || chr(10) || ');' || chr(10) AS ddl
      FROM ({_DEFS}) d GROUP BY dataset, table_name) t GROUP BY dataset""",
)
def l1(spark, sf):
    return C.render_create(catalog(spark, sf), foreign_keys(spark, sf))


_LINES = f"""SELECT dataset, table_name, table_name || '(' || string_agg(col_name, ', ' ORDER BY col_pos) || ')' AS line,
  table_name || '(' || string_agg(col_name || ' ' || col_type, ', ' ORDER BY col_pos) || ')' AS typed_line
  FROM ({CATALOG}) c GROUP BY dataset, table_name"""


@query(
    "l2_render_compact",
    f"SELECT dataset, string_agg(line, chr(10) ORDER BY table_name) AS schema_compact FROM ({_LINES}) l GROUP BY dataset",
)
def l2(spark, sf):
    return C.render_compact(catalog(spark, sf))


@query(
    "l2_render_compact_typed_cap",
    f"""SELECT dataset, string_agg(typed_line, chr(10) ORDER BY table_name) AS schema_compact FROM
      (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY table_name) AS n FROM ({_LINES}) l) x
      WHERE n <= 5 GROUP BY dataset""",
)
def l2_typed(spark, sf):
    return C.render_compact(catalog(spark, sf), with_types=True, max_tables=5)


_EDGES = f"""SELECT DISTINCT dataset, src, dst FROM (
  SELECT dataset, table_name AS src, ref_table AS dst FROM ({FOREIGN_KEYS}) f
  UNION ALL SELECT dataset, ref_table, table_name FROM ({FOREIGN_KEYS}) g) e"""


@query("l3_fk_graph", _EDGES)
def l3(spark, sf):
    return C.fk_graph(foreign_keys(spark, sf))


def _split(text: str) -> str:
    for pattern in (r"([a-z])([A-Z])", r"(\D)(\d)", r"(\d)(\D)"):
        text = f"regexp_replace({text}, '{pattern}', '\\1 \\2', 'g')"
    return f"regexp_extract_all({text}, '[A-Za-z0-9]+')"


def _stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ing' THEN {t}[:-4] WHEN length({t}) > 3 AND {t} LIKE '%ed' THEN {t}[:-3] "
        f"WHEN length({t}) > 3 AND {t} LIKE '%es' THEN {t}[:-3] WHEN length({t}) > 2 AND {t} LIKE '%s' THEN {t}[:-2] ELSE {t} END"
    )


def _ident(name: str) -> str:
    words = _split(f"replace({name}, '_', ' ')")
    return f"list_transform({words}, lambda w: {_stem('lower(w)')})"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_QTOKENS = (
    "list_transform(list_filter(" + _split("replace(lower(question), '_', ' ')")
    + f", lambda w: w NOT IN ({_STOP})), lambda w: {_stem('w')})"
)


@query(
    "l4_identifier_tokens",
    f"SELECT dataset, table_name, array_to_string({_ident('table_name')}, ' ') AS tokens FROM (SELECT DISTINCT dataset, table_name FROM ({CATALOG}) c) t",
)
def l4(spark, sf):
    names = catalog(spark, sf).select("dataset", "table").distinct()
    return names.select(
        "dataset", F.col("table").alias("table_name"),
        F.array_join(identifier_tokens(F.col("table")), " ").alias("tokens"),
    )


@query(
    "l5_question_tokens",
    f"SELECT id, array_to_string({_QTOKENS}, ' ') AS tokens FROM ({LINK_QUESTIONS}) q",
)
def l5(spark, sf):
    return questions(spark, sf).select("id", F.array_join(question_tokens(F.col("question")), " ").alias("tokens"))


def questions(spark, sf) -> DataFrame:
    return run(spark, sf, LINK_QUESTIONS, busy="orders")


# The words that occur in questions and in table names, so the check can list the similarity of each pair.
_Q_WORDS = """1998 2 7 comment dat have high hot key large low me medium mention nam not order plat pric qty red
region ring rod small sold specifi supplier unit unitpric urgent widget zzz""".split()
_T_WORDS = """0 1 10 11 12 13 14 15 2 3 4 5 6 7 8 9 anvil anvils blue bolt bolts cold gear gears gizmo gizmos hot
large new old plat plate plates red ring rings rod rods small widget widgets""".split()
_RATIOS = ", ".join(
    f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()!r})" for a in _Q_WORDS for b in _T_WORDS
)
_RATIO_TABLE = f"(SELECT a, b, r::DOUBLE AS r FROM (VALUES {_RATIOS}) v(a, b, r))"
_T = f"""SELECT dataset, table_name, list_distinct({_ident('table_name')}) AS t_tokens FROM
  (SELECT DISTINCT dataset, table_name FROM ({CATALOG}) c) d"""


_NAME_WORDS = "anvil blue bolt cold gear gizmo hot large new old plate red ring rod small widget".split()
_NAMES = [f"{a} {b}" for a in _NAME_WORDS for b in _NAME_WORDS]
_TYPES = "economy promo medium standard large small".split()
_NAME_RATIOS = ", ".join(
    f"('{a}', '{b}', {SequenceMatcher(None, a, b).ratio()!r})" for a in _NAMES for b in _TYPES
)


@query(
    "l6_similarity",
    f"""SELECT p_partkey, round(r::DOUBLE, 6) AS ratio FROM @part
      JOIN (VALUES {_NAME_RATIOS}) v(a, b, r) ON a = p_name AND b = lower(p_type)""",
)
def l6(spark, sf):
    parts = run(spark, sf, "SELECT p_partkey, p_name, lower(p_type) AS kind FROM @part")
    return add_ratio(parts, "p_name", "kind").select("p_partkey", F.round("ratio", 6).alias("ratio"))


def _scores(fuzzy: bool) -> str:
    tables = f"""SELECT t.dataset, t.table_name, t.t_tokens, c.c_tokens FROM ({_T}) t JOIN (
      SELECT dataset, table_name, list_distinct(flatten(list({_ident('col_name')}))) AS c_tokens
      FROM ({CATALOG}) c GROUP BY dataset, table_name) c ON c.dataset = t.dataset AND c.table_name = t.table_name"""
    near = (
        f""" LEFT JOIN (SELECT q_key, t_key, max(r) AS best FROM (SELECT q_key, t_key, unnest(q_list) AS qw, t_list FROM pairs) x
        JOIN {_RATIO_TABLE} ON a = qw AND list_contains(t_list, b) GROUP BY q_key, t_key) n
        ON n.q_key = array_to_string(q_tokens, ' ') AND n.t_key = array_to_string(t_tokens, ' ')"""
        if fuzzy else ""
    )
    bonus = " + 0.25 * coalesce(best, 0)" if fuzzy else ""
    return f"""WITH qs AS MATERIALIZED (SELECT id, dataset, list_distinct({_QTOKENS}) AS q_tokens FROM ({LINK_QUESTIONS}) q),
      ts AS MATERIALIZED ({tables}),
      joined AS MATERIALIZED (SELECT id, dataset, q_tokens, table_name, t_tokens, c_tokens FROM qs JOIN ts USING (dataset)),
      pairs AS MATERIALIZED (SELECT DISTINCT array_to_string(q_tokens, ' ') AS q_key, array_to_string(t_tokens, ' ') AS t_key,
        q_tokens AS q_list, t_tokens AS t_list FROM joined),
      scored AS MATERIALIZED (SELECT id, dataset, table_name, 3.0::DOUBLE * len(list_intersect(q_tokens, t_tokens))
        + len(list_intersect(q_tokens, c_tokens)){bonus} AS score FROM joined{near}),
      ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, table_name) AS n FROM scored)"""


# A question whose dataset has no schema stays, without tables.
_ALL_RANKED = """SELECT qs.id, ranking FROM qs LEFT JOIN (SELECT id, string_agg(table_name || '='
  || round(score, 4)::DECIMAL(9,4)::VARCHAR, ' ' ORDER BY n) AS ranking FROM ranked GROUP BY id) r ON r.id = qs.id"""


def _ranking(rows: DataFrame) -> DataFrame:
    shown = F.transform(
        "ranked",
        lambda t: F.concat(t["table"], F.lit("="), F.round(t["score"], 4).cast("decimal(9,4)").cast("string")),
    )
    return rows.select("id", F.array_join(shown, " ").alias("ranking"))


def profiles(spark, sf) -> DataFrame:
    return materialize(C.schema_profiles(catalog(spark, sf), C.fk_graph(foreign_keys(spark, sf))), "profiles")


@query("l7_rank_overlap", f"{_scores(False)} {_ALL_RANKED}")
def l7_overlap(spark, sf):
    return _ranking(L.rank_tables(questions(spark, sf), profiles(spark, sf), "question", fuzzy_weight=0))


@query("l7_rank_tables", f"{_scores(True)} {_ALL_RANKED}")
def l7(spark, sf):
    return _ranking(L.rank_tables(questions(spark, sf), profiles(spark, sf), "question"))


def _selected(rows: DataFrame) -> DataFrame:
    names = F.array_join(F.transform("selected", lambda t: t["table"]), " ")
    return rows.select("id", names.alias("tables"))


def _top(k: int) -> str:
    return f"""picked AS MATERIALIZED (SELECT id, dataset, table_name, n FROM ranked WHERE score > 0 AND n <= {k}
      UNION ALL SELECT id, dataset, table_name, row_number() OVER (PARTITION BY id ORDER BY table_name) FROM scored
        WHERE id IN (SELECT id FROM scored GROUP BY id HAVING max(score) <= 0)
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY table_name) <= {k})"""


@query(
    "l8_select_top",
    f"""{_scores(True)}, {_top(K)} SELECT qs.id, tables FROM qs LEFT JOIN
      (SELECT id, string_agg(table_name, ' ' ORDER BY n) AS tables FROM picked GROUP BY id) p ON p.id = qs.id""",
)
def l8(spark, sf):
    rows = L.rank_tables(questions(spark, sf), profiles(spark, sf), "question")
    return _selected(L.select_top(rows, K))


@query(
    "l9_fk_expansion",
    f"""{_scores(False)}, {_top(6)}, near AS (SELECT p.id, e.dst, min(p.n * 1000 + x.r) AS first FROM picked p
      JOIN ({_EDGES}) e ON e.dataset = p.dataset AND e.src = p.table_name
      JOIN (SELECT dataset, table_name, row_number() OVER (PARTITION BY dataset ORDER BY table_name) AS r FROM ts) x
        ON x.dataset = p.dataset AND x.table_name = e.dst
      WHERE NOT EXISTS (SELECT 1 FROM picked o WHERE o.id = p.id AND o.table_name = e.dst) GROUP BY p.id, e.dst),
      both_parts AS (SELECT id, table_name, n FROM picked UNION ALL SELECT id, dst, 100000 + first FROM near)
      SELECT id, string_agg(table_name, ' ' ORDER BY n) AS tables FROM (SELECT *,
        row_number() OVER (PARTITION BY id ORDER BY n) AS m FROM both_parts) z WHERE m <= 6 GROUP BY id""",
)
def l9(spark, sf):
    rows = L.rank_tables(questions(spark, sf), profiles(spark, sf), "question", fuzzy_weight=0)
    return _selected(L.expand_neighbours(L.select_top(rows, 6), 6))


_EXPECTED = "SELECT DISTINCT 'd' || CAST(CAST(floor(o_custkey / 11) AS BIGINT) AS STRING) AS dataset FROM @orders"

_EXISTING = f"SELECT dataset FROM ({_EXPECTED}) d WHERE length(dataset) % 2 = 1"


@query(
    "l10_dataset_info",
    f"""SELECT e.dataset, t.tables IS NOT NULL OR x.dataset IS NOT NULL AS available,
      CASE WHEN x.dataset IS NOT NULL THEN coalesce(t.tables, '') ELSE t.tables END AS tables,
      CASE WHEN x.dataset IS NOT NULL THEN coalesce(t.table_count, 0) ELSE t.table_count END AS table_count
      FROM ({_EXPECTED}) e LEFT JOIN ({_EXISTING}) x ON x.dataset = e.dataset LEFT JOIN (
      SELECT dataset, string_agg(table_name, ' ' ORDER BY table_name) AS tables, count(*) AS table_count FROM (
        SELECT DISTINCT dataset, table_name FROM ({CATALOG}) c) d GROUP BY dataset) t ON t.dataset = e.dataset""",
)
def l10(spark, sf):
    exists = run(spark, sf, _EXISTING).withColumnRenamed("dataset", "database")
    info = C.dataset_info(run(spark, sf, _EXPECTED), catalog(spark, sf), exists)
    return info.withColumn("tables", F.array_join("tables", " ")).withColumn(
        "table_count", F.col("table_count").cast("long")
    )


_MINIMUM = f"SELECT dataset, CASE WHEN length(dataset) % 2 = 0 THEN 16 END AS min_tables FROM ({_EXPECTED}) e"


@query(
    "l11_completeness",
    f"""SELECT m.dataset, coalesce(t.n, 0) AS table_count, coalesce(min_tables, 1) AS min_tables,
      coalesce(t.n, 0) >= coalesce(min_tables, 1) AS imported FROM ({_MINIMUM}) m LEFT JOIN (
      SELECT dataset, count(DISTINCT table_name) AS n FROM ({CATALOG}) c GROUP BY dataset) t ON t.dataset = m.dataset""",
)
def l11(spark, sf):
    return C.completeness(run(spark, sf, _MINIMUM), catalog(spark, sf))


_ASK = "'Which texts of ' || source || ' are written in ' || lang"
_PROMPT_INPUT = f"SELECT doc_id AS id, text AS schema_compact, {_ASK} AS question FROM @documents"
_PROMPT_HEAD = """'### Database schema:' || chr(10) || schema_compact || chr(10) || chr(10) || '### Question:' || chr(10)
  || question || chr(10) || chr(10) || '### SQL:' || chr(10)"""


@query(
    "l12_prompt",
    f"SELECT id, {_PROMPT_HEAD} || 'SELECT ' AS prompt, {_PROMPT_HEAD} AS chat_prompt FROM ({_PROMPT_INPUT}) d",
)
def l12(spark, sf):
    schema, question = F.col("schema_compact"), F.col("question")
    return run(spark, sf, _PROMPT_INPUT).select(
        "id", P.build_prompt(schema, question).alias("prompt"),
        P.build_prompt(schema, question, P.ENDING_ANSWER).alias("chat_prompt"),
    )


# Documents as schema texts; every fourth question is the whole document, so that long ones are cut.
_PACK_INPUT = f"""SELECT doc_id AS id, text AS schema_compact, CASE WHEN doc_id % 4 = 0 THEN text ELSE {_ASK} END AS question
  FROM @documents"""
_CTX, _NEW = 260, 60
_BUDGET = _CTX - _NEW
_FRAME = 4 + 3 + 4


def _tok(text: str) -> str:
    return f"regexp_extract_all({text}, '\\s*\\S+|\\s+')"


_PACKED = f"""WITH d AS MATERIALIZED (SELECT id, schema_compact, {_tok('question')} AS q FROM ({_PACK_INPUT}) i),
  e AS MATERIALIZED (SELECT id, schema_compact, CASE WHEN {_FRAME} + len(q) > {_BUDGET}
      THEN q[greatest(len(q) - greatest(32, {_BUDGET} - {_FRAME}) + 1, 1):] ELSE q END AS q FROM d),
  l AS MATERIALIZED (SELECT id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (SELECT id,
      list_filter(regexp_split_to_array(schema_compact, '\\r\\n|[\\n\\r]'), lambda x: trim(x) <> '') AS parts FROM d) y),
  r AS MATERIALIZED (SELECT id, line, pos, sum(len({_tok("line || chr(10)")})) OVER (PARTITION BY id ORDER BY pos) AS used FROM l),
  k AS MATERIALIZED (SELECT e.id, array_to_string(e.q, '') AS prompt_question, len(e.q) AS q_size,
      coalesce(string_agg(r.line, chr(10) ORDER BY r.pos), '') AS prompt_schema
    FROM e LEFT JOIN r ON r.id = e.id AND r.used <= greatest(0, {_BUDGET} - {_FRAME} - len(e.q)) GROUP BY e.id, e.q)"""


def packed(spark, sf) -> DataFrame:
    return P.pack_prompts(
        run(spark, sf, _PACK_INPUT, busy="documents"), "schema_compact", "question", max_new_tokens=_NEW, context=_CTX
    )


@query("l13_budget", f"{_PACKED} SELECT id, prompt_schema, prompt_question FROM k")
def l13(spark, sf):
    return packed(spark, sf).select("id", "prompt_schema", "prompt_question")


@query(
    "l14_prompt_tokens",
    f"{_PACKED} SELECT id, CAST({_FRAME} + q_size + len({_tok('prompt_schema')}) AS BIGINT) AS prompt_tokens FROM k",
)
def l14(spark, sf):
    return packed(spark, sf).select("id", F.col("prompt_tokens").cast("long").alias("prompt_tokens"))


@query(
    "l15_dataset_profile",
    f"""SELECT dataset, count(*) AS total, array_to_string(list_sort(json_keys(arg_min(entry, entry_pos))), ' ') AS keys
      FROM ({CORPUS}) c GROUP BY dataset""",
)
def l15(spark, sf):
    return C.corpus_profile(run(spark, sf, CORPUS)).withColumn("keys", F.array_join("keys", " "))


@query("l16_schema_preview", "SELECT doc_id, substr(text, 1, 200) || '...' AS preview FROM @documents")
def l16(spark, sf):
    return run(spark, sf, "SELECT doc_id, text FROM @documents").select(
        "doc_id", schema_preview(F.col("text")).alias("preview")
    )


# --- DDL texts and manifests, written from the catalog and read back --------------------------------------

@query(
    "s4_ddl_columns",
    f"""SELECT dataset, table_name, col_pos, col_name, col_type, is_nullable,
      CASE WHEN col_default <> '' THEN col_default END AS col_default, pk_pos,
      CASE col_type WHEN 'int' THEN 'int' WHEN 'float(3,2)' THEN 'decimal(3,2)' ELSE 'string' END AS spark_type
      FROM ({CATALOG}) c""",
)
def s4(spark, sf):
    return parse_columns(_ddl(spark, sf)).select(
        "dataset", F.col("table").alias("table_name"), "col_pos", F.col("column").alias("col_name"),
        F.col("type").alias("col_type"), F.col("nullable").alias("is_nullable"),
        F.col("default").alias("col_default"), "pk_pos", spark_type(F.col("type")).alias("spark_type"),
    )


def _ddl(spark, sf) -> DataFrame:
    """Every dataset in one dialect, every third also in the other with the same text."""
    texts = C.render_create(catalog(spark, sf), foreign_keys(spark, sf))
    first = texts.select(F.lit("mysql").alias("dialect"), "*")
    second = texts.where(F.crc32("dataset") % 3 == 0).select(F.lit("mariadb").alias("dialect"), "*")
    return choose_dialect(first.union(second), "mariadb")


@query("s4_ddl_foreign_keys", f"SELECT dataset, table_name, ref_table, col_name, ref_column FROM ({FOREIGN_KEYS}) f")
def s4_keys(spark, sf):
    return parse_foreign_keys(_ddl(spark, sf)).select(
        "dataset", F.col("table").alias("table_name"), "ref_table",
        F.array_join("columns", ",").alias("col_name"), F.array_join("ref_columns", ",").alias("ref_column"),
    )


_WANTED = f"CASE o_orderkey % {len(TABLES)} {' '.join(f'WHEN {k} THEN {t!r}' for k, t in enumerate(TABLES))} END"
_INTROSPECTED = ", ".join(f"'{t}'" for t in TABLES)


@query(
    "s5_introspection",
    f"""SELECT o_orderkey, table_name, count(*) AS n_columns, string_agg(column_name, ', ' ORDER BY ordinal_position) AS columns
      FROM (SELECT DISTINCT table_name, column_name, (column_index - 1) AS ordinal_position FROM duckdb_columns()
        WHERE table_name IN ({_INTROSPECTED})) c
      JOIN (SELECT o_orderkey, {_WANTED} AS wanted FROM @orders) o ON wanted = table_name GROUP BY o_orderkey, table_name""",
)
def s5(spark, sf):
    """References of the orders resolved against the introspected schema."""
    tables = C.table_rows(given_catalog(spark, sf)).select(
        "table", F.size("columns").cast("long").alias("n_columns"),
        F.array_join(F.transform("columns", lambda c: c["column"]), ", ").alias("columns"),
    )
    wanted = run(
        spark, sf,
        f"SELECT o_orderkey, {_WANTED} AS table_name FROM @orders",
    )
    return wanted.join(tables, F.col("table_name") == F.col("table")).select(
        "o_orderkey", "table_name", "n_columns", "columns"
    )


_MANIFEST = """SELECT c_nationkey, '{"generated_at_epoch": 1, "datasets": [' || '{"name": "c' || CAST(c_custkey AS STRING)
  || '", "url": "u", "file": "f", "mode": "cached", "total": ' || CAST(c_custkey % 50 AS STRING)
  || ', "keys": ["sql", "variables"]}, {"name": "x' || CAST(c_custkey AS STRING) || '", "total": 0, "keys": []}]}' AS doc FROM @customer"""


@query(
    "s6_manifest",
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS name, c_custkey % 50 AS total, 'sql,variables' AS keys FROM @customer
      UNION ALL SELECT 'x' || CAST(c_custkey AS VARCHAR), 0, '' FROM @customer""",
)
def s6(spark, sf):
    from ..sources.corpus import MANIFEST

    docs = run(spark, sf, _MANIFEST).select(F.from_json("doc", MANIFEST).alias("m")).select("m.*")
    return manifest_rows(docs).select("name", "total", F.array_join("keys", ",").alias("keys"))
