"""The corpus operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, byte_pieces, decontamination, lexical_search, license_scan, line_dedup, merkle, ngram_join, quality, secret_scan,
    suffix_dedup, token_files, toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


@query("op1_decontaminate")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark phrases of ten words inside every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        decontamination.hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of 50-byte strings that start in an earlier document."""
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_line_dedup",
    r"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
counted AS (
  SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM pieces WHERE trim(line) <> '' GROUP BY ALL),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, c.line FROM counted c JOIN pages p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.n >= 5 AND c.n > CAST(0.01 AS DOUBLE) * p.pages),
judged AS (
  SELECT p.doc_id, p.line, p.pos, b.line IS NOT NULL AS gone
  FROM pieces p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source AND trim(p.line) = b.line),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on more than one in a hundred documents of their source; the source is the site."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    cut = line_dedup.drop_boilerplate(docs)
    return cut.select(
        "doc_id", "source", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op4_ngram_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates among all documents: class, copies and links of each."""
    found = ngram_join.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_copies", "n_links")


@query("op5_license_scan")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and fuzzy notices of every document."""
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.array_distinct(F.transform("_places", lambda p: p["label"]))
    method = F.transform("_matches", lambda m: m["label"])
    starts = F.transform("_places", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("_matches", lambda m: m["score"])), F.lit(0.0))
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, method)), ",").alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.to_json("_matches").alias("matches"),
    )


@query("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts of every document, and the perplexity bands learnt from the labels that are not held out."""
    try:
        labels = table(spark, folder, "labels").select("doc_id", "quality")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        labels = None
    judged = quality.judge(table(spark, folder, "documents").select("doc_id", "text", "lang"), labels=labels)
    names = {"_words": "n_words", "_word_chars": "word_chars", "_symbols": "n_symbols", "_dup_lines": "n_dup_lines",
             "_repeat_words": "n_repeat_words", "_base_failed": "base_failed", "_kept": "kept", "_perplexity": "perplexity"}
    return judged.select("doc_id", *(F.col(a).alias(b) for a, b in names.items()))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"),
        (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents, written in blocks and read back."""
    path = token_files.token_file_path(spark)
    token_files.write_token_files(table(spark, folder, "documents"), path)
    return token_files.read_token_files(spark, path).select(
        "doc_id", "start",
        (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.crc32("tokens").alias("ids_crc32"),
    )


def _secret_sql() -> str:
    rules = secret_scan.RULES
    marked = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind_order, '{r.name}' AS kind, {r.least} AS least, "
        f"regexp_replace(text, '{r.pattern.replace(chr(39), chr(39) * 2)}', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g') AS text FROM plain"
        for k, r in enumerate(rules)
    )
    return f"""
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS text
  FROM documents),
marked AS (SELECT * FROM ({marked}) WHERE contains(text, chr(1))),
pieces AS (
  SELECT doc_id, kind_order, kind, least, unnest(string_split(text, chr(1))) AS piece,
         generate_subscripts(string_split(text, chr(1)), 1) AS pos
  FROM marked),
placed AS (
  SELECT doc_id, kind_order, kind, least, pos, split_part(piece, chr(3), 1) AS match,
         sum(length(piece) - CASE WHEN pos > 1 THEN 2 ELSE 0 END)
           OVER (PARTITION BY doc_id, kind_order ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS start
  FROM pieces),
found AS (
  SELECT doc_id, kind_order, kind, CAST(start AS BIGINT) AS s, CAST(start + length(match) - 1 AS BIGINT) AS e
  FROM placed WHERE pos > 1 AND length(split_part(match, chr(2), 2)) >= least),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) FILTER (WHERE kind_order < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_order) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)
"""


@query("op9_secret_scan", _secret_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document by way of the ledger of its blobs."""
    found = secret_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(secret_scan.spans(secret_scan.BASE), 256).alias("base_sha256"),
        secret_scan.spans(secret_scan.RULES).alias("spans"),
    )


@query("op10_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text read back from them."""
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


@query("op11_byte_pieces")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by a sentencepiece model made from ranks, and the bytes read back from them."""
    coded = byte_pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf_sql(changed: str = "n_chars") -> str:
    values = (f"CAST({changed if c == 'n_chars' else c} AS VARCHAR)" for c in _FIELDS)
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _merkle_sql() -> str:
    level = """SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(width) + 1) // 2
  FROM {0} WHERE width > 1 GROUP BY tree, level, pos // 2"""
    # zlib's crc32 bit by bit: the remainder of each byte by shifts, over the decimal digits of the id
    crc = """SELECT id, 1 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT id, k + 1, list_reduce([xor(c, ascii(id[k]))] || [CAST(0 AS BIGINT) FOR i IN range(8)],
    lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE k <= length(id)"""
    return f"""
WITH RECURSIVE crc AS ({crc}),
checked AS (SELECT id, xor(c, 4294967295) % 7 = 0 AS hit FROM crc WHERE k = length(id) + 1),
hashed AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN c.hit THEN {_leaf_sql("n_chars + 1")} ELSE {_leaf_sql()} END AS shown
  FROM documents d LEFT JOIN checked c ON c.id = CAST(d.doc_id AS VARCHAR)),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS size,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM hashed),
nodes(tree, level, pos, h, width) AS (
  SELECT tree, 0, place, leaf, size FROM leaves UNION ALL {level.format("nodes")}),
roots AS (SELECT tree, h FROM nodes WHERE width = 1),
tops(tree, level, pos, h, width) AS (
  SELECT CAST(-1 AS BIGINT), 0, tree, h, (SELECT count(*) FROM roots) FROM roots UNION ALL {level.format("tops")}),
siblings AS (
  SELECT l.tree, l.place, n.level AS step, n.h, n.pos & 1 = 1 AS behind FROM leaves l JOIN nodes n
    ON n.tree = l.tree AND n.width > 1 AND n.pos = xor(l.place >> n.level, 1)
  UNION ALL
  SELECT l.tree, l.place, 100 + t.level, t.h, t.pos & 1 = 1 FROM leaves l JOIN tops t
    ON t.width > 1 AND t.pos = xor(l.tree >> t.level, 1)),
proofs AS (SELECT tree, place, string_agg(h, '' ORDER BY step) AS proof FROM siblings GROUP BY tree, place),
steps AS (
  SELECT tree, level AS step, level = (SELECT max(m.level) FROM nodes m WHERE m.tree = n.tree) AS last FROM (SELECT DISTINCT tree, level FROM nodes) n
  UNION ALL
  SELECT tree, 100 + level, level = (SELECT max(level) FROM tops) FROM (SELECT DISTINCT tree FROM roots) r, (SELECT DISTINCT level FROM tops) t),
folds(tree, place, step, h) AS (
  SELECT tree, place, 0, shown FROM leaves
  UNION ALL
  SELECT f.tree, f.place, CASE WHEN s.last AND f.step < 100 THEN 100 ELSE f.step + 1 END,
         CASE WHEN s.last THEN f.h WHEN b.h IS NULL THEN sha256(f.h) WHEN b.behind THEN sha256(f.h || b.h) ELSE sha256(b.h || f.h) END
  FROM folds f JOIN steps s ON s.tree = f.tree AND s.step = f.step
    LEFT JOIN siblings b ON b.tree = f.tree AND b.place = f.place AND b.step = f.step
  WHERE NOT (s.last AND f.step >= 100)),
ends AS (SELECT f.tree, f.place, f.h FROM folds f JOIN steps s ON s.tree = f.tree AND s.step = f.step WHERE s.last AND f.step >= 100)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN roots r ON r.tree = l.tree JOIN tops t ON t.width = 1
  LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.place JOIN ends e ON e.tree = l.tree AND e.place = l.place
"""


@query("op12_merkle", _merkle_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Proof of every document against the root of all, and what a changed one folds to."""
    docs = table(spark, folder, "documents").select(*_FIELDS)
    changed = [F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in _FIELDS]
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = merkle.row_digest(*map(F.col, _FIELDS))
    rows = docs.select("doc_id", "lang", leaf.alias("_leaf"), F.when(tampered, merkle.row_digest(*changed)).alias("_changed"))
    rows = rows.withColumn("_shown", F.coalesce("_changed", "_leaf")).drop("_changed")
    proved = merkle.prove(merkle.build(rows, carry=("_shown",)))
    return merkle.fold(proved, "_shown").select(
        "doc_id", F.col("_leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        F.sha2(F.concat_ws("", "_proof"), 256).alias("proof_sha256"), F.col("_folded").alias("folded_root"),
        (F.col("_folded") == F.col("_root")).alias("verified"),
    )


@query(
    "op13_lexical_search",
    """
WITH pieces AS (
  SELECT doc_id, text, row_number() OVER () AS row FROM documents),
terms AS (
  SELECT row, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM pieces),
counts AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term),
lengths AS (SELECT row, count(*) AS n FROM terms GROUP BY row),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, total GROUP BY term, docs),
items AS (SELECT item_id, row_number() OVER () AS item, text FROM benchmark),
asked AS (
  SELECT item, any_value(item_id) AS item_id, term, count(*) AS q FROM (
    SELECT item, item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM items) GROUP BY item, term),
impacts AS (
  SELECT c.row, c.doc_id, c.term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)) AS impact
  FROM counts c JOIN lengths USING (row), total),
scored AS (
  SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, CAST(sum(q * w * impact) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item, row)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that match each benchmark item best."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, folder, "benchmark").select("item_id", "text")).select("item_id", "rank", "doc_id", "score")


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    return QUERIES, ORACLES
