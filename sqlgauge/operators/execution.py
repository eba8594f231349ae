"""Running SQL texts as measured, failure-proof jobs; results stay on the executors.

A dataset is resolved in a session of its own, so texts of several datasets run side by side without seeing each
other's tables. Texts that resolve to the same plan over the same columns run once, however they are spelt. Only queries run: Spark's own grammar rule for a query must accept the text. Reading files by path and
calling JVM methods by reflection are refused.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import null_safe_join
from ..plans.scratch import scratch_path
from ..sources.binding import bind_tables
from .comparison import FINGERPRINT, fingerprint

OUTCOME = f"success boolean, rows bigint, time_s double, error string, fingerprint {FINGERPRINT}"
OUTCOME_STRUCT = (
    f"struct<success:boolean,rows:bigint,time_s:double,error:string,fingerprint:{FINGERPRINT}>"
)
# Fixed value: what is run when a model gave nothing.
FALLBACK_SQL = "SELECT 1;"
# Fixed value: seconds that a text may take.
TIME_LIMIT_S = 30.0
TIMED_OUT = "timed out"
_LITERAL_OR_COMMENT = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_REFLECTION = re.compile(r"(?:\b|`)(?:try_reflect|reflect|java_method)`?\s*\(", re.IGNORECASE)

#: Name of a dataset to its folder and tables.
Datasets = dict[str, tuple[str, list[str]]]


def query_text(spark: SparkSession, sql: str) -> str:
    """The text without its final semicolons, if it is one query; anything else is an error."""
    text = re.sub(r"[\s;]+$", "", sql)
    spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
    if _REFLECTION.search(_LITERAL_OR_COMMENT.sub("''", text)):
        raise ValueError("functions that call methods by reflection are not run")
    return text


def run_query(spark: SparkSession, sql: str) -> DataFrame:
    """The lazy result of one query text; anything but a query is an error."""
    return spark.sql(query_text(spark, sql))


def dataset_session(spark: SparkSession, datasets: Datasets, dataset: str, ignore_case: bool = False) -> SparkSession:
    """A session that sees the tables of one dataset; an unknown name is an error."""
    if dataset not in datasets:
        raise ValueError(f"Unknown dataset: {dataset}")
    folder, tables = datasets[dataset]
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    bind_tables(own, folder, tables, ignore_case)
    return own


def execute_sql(spark: SparkSession, sql: str, timeout_s: float | None = TIME_LIMIT_S) -> dict:
    """Run one text and describe the outcome; an error is part of the outcome, never raised.

    One action counts and fingerprints the result inside the timed block. Past ``timeout_s`` the jobs of the text are
    cancelled, those it would still start as well, and the error begins with ``TIMED_OUT``.
    """
    result, outcome = _resolved(spark, sql)
    return outcome if result is None else _timed(outcome, _run(result, timeout_s))


def _resolved(spark: SparkSession, sql: str) -> tuple[DataFrame | None, dict]:
    """The resolved query, or None and the failure; either way with the time it took."""
    started = time.perf_counter()
    try:
        result, error = run_query(spark, sql), None
    except Exception as failure:  # noqa: BLE001 - any failure is an outcome
        result, error = None, str(failure)
    return result, _failed(error) | {"time_s": time.perf_counter() - started}


def _run(result: DataFrame, timeout_s: float | None, pool: str | None = None) -> dict:
    """The outcome of one action over a resolved query; jobs belong to the scheduler pool of that name."""
    started = time.perf_counter()
    context = result.sparkSession.sparkContext
    group = f"sqlgauge-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context._jsc.sc().cancelJobGroupAndFutureJobs(group)

    timer = None
    try:
        context.setLocalProperty("spark.scheduler.pool", pool)
        context.setJobGroup(group, "sql text", interruptOnCancel=True)
        if timeout_s is not None:
            timer = threading.Timer(timeout_s, stop)
            timer.start()
        seen = fingerprint(result).first()
        outcome = {"success": True, "rows": seen.rows, "error": None, "fingerprint": seen.fingerprint}
    except Exception as failure:  # noqa: BLE001 - any failure is an outcome
        outcome = _failed(f"{TIMED_OUT} after {timeout_s} s" if late.is_set() else str(failure))
    finally:
        if timer is not None:
            timer.cancel()
        for name in ("spark.jobGroup.id", "spark.scheduler.pool"):
            context.setLocalProperty(name, None)
    return outcome | {"time_s": time.perf_counter() - started}


def _timed(own: dict, ran: dict) -> dict:
    """The outcome of a run, with the time its text took to resolve added."""
    return ran | {"time_s": own["time_s"] + ran["time_s"]}


_FIELDS = ("success", "rows", "time_s", "error", "fingerprint")
#: Texts side by side, as a share of the cores; a text's own tasks fill the rest.
CORES_PER_SLOT = 2
#: Plans whose run later texts may still join; a plan beyond that runs again.
PLANS_KEPT = 4096


class _Plans:
    """Runs by what they compute: dataset, column names and types, and plan.

    Plans are equal when Spark says that they have the same semantics. Names are compared too, as equal plans may name
    their columns differently and results with other names differ.
    """

    def __init__(self, kept: int) -> None:
        self.kept, self.lock, self.count = kept, threading.Lock(), 0
        self.runs: OrderedDict[tuple, list[tuple[DataFrame, int, Future]]] = OrderedDict()

    def claim(self, dataset: str | None, result: DataFrame) -> tuple[int, Future, bool]:
        """Number and future of the run for this plan, and whether the caller is to do it."""
        key = dataset, tuple(result.dtypes), result.semanticHash()
        with self.lock:
            same = self.runs.setdefault(key, [])
            self.runs.move_to_end(key)
            for held, number, future in same:
                if held.sameSemantics(result):
                    return number, future, False
            self.count += 1
            same.append((result, self.count, Future()))
            while len(self.runs) > self.kept:
                self.runs.popitem(last=False)
            return *same[-1][1:], True

    def number(self) -> int:
        """A number for a text that needs no run of a plan."""
        with self.lock:
            self.count += 1
            return self.count


class _Answer(NamedTuple):
    """A text with its own outcome so far and the run that completes it, if one is needed."""

    dataset: str | None
    sql: str
    own: dict
    run: int
    ran: Future | None

    def row(self) -> tuple:
        outcome = self.own if self.ran is None else _timed(self.own, self.ran.result())
        return (self.dataset, self.sql, *(outcome[k] for k in _FIELDS), self.run)


def slots_for(spark: SparkSession) -> int:
    """How many texts run side by side on this cluster."""
    return max(2, spark.sparkContext.defaultParallelism // CORES_PER_SLOT)


def execute_texts(
    spark: SparkSession,
    texts: DataFrame | Iterable[str],
    parallel: int | None = None,
    timeout_s: float | None = TIME_LIMIT_S,
    batch: int = 2000,
    datasets: Datasets | None = None,
    plans: int = PLANS_KEPT,
) -> DataFrame:
    """``dataset``, ``sql``, ``outcome`` and ``run`` for every distinct pair of dataset and text.

    Without ``datasets`` all texts run in the given session and the dataset is only a key. Texts are streamed to the
    driver and submitted side by side, by default as many as the cluster has room for; a slow one holds only its own
    slot. Texts of one plan share a run (``run`` numbers it): each has its outcome, with the time that resolving the text
    and the run took; they wait beside the slots, not in them. A dataset's jobs form a scheduler pool, so that where the
    session schedules fairly (``spark.scheduler.mode``) no dataset waits for another's texts. Outcomes are appended to a
    written table, ``batch`` at a time, so neither the texts nor the outcomes are held whole.
    """
    if isinstance(texts, DataFrame):
        name = F.col("dataset") if "dataset" in texts.columns else F.lit(None)
        pairs = texts.select(name.cast("string").alias("dataset"), "sql").distinct()
        stream: Iterator = ((r.dataset, r.sql) for r in pairs.toLocalIterator(prefetchPartitions=True))
    else:
        stream = ((None, text) for text in dict.fromkeys(texts))
    parallel = parallel or slots_for(spark)
    path = scratch_path(spark, "outcomes")
    schema = f"dataset string, sql string, {OUTCOME}, run bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    sessions: dict[str, SparkSession] = {}
    lock = threading.Lock()
    shared = _Plans(plans)

    def session(dataset: str | None) -> SparkSession:
        if datasets is None:
            return spark
        with lock:
            if dataset not in sessions:
                sessions[dataset] = dataset_session(spark, datasets, dataset)
            return sessions[dataset]

    def answer(dataset: str | None, sql: str) -> _Answer:
        try:
            result, own = _resolved(session(dataset), sql)
        except ValueError as unknown:
            result, own = None, _failed(str(unknown))
        if result is None:
            return _Answer(dataset, sql, own, shared.number(), None)
        number, ran, mine = shared.claim(dataset, result)
        if mine:
            try:
                ran.set_result(_run(result, timeout_s, dataset))
            except BaseException as failure:  # whoever waits for this run has to hear of it
                ran.set_exception(failure)
                raise
        return _Answer(dataset, sql, own, number, ran)

    done: list[tuple] = []
    waiting: list[_Answer] = []

    def take(ended: Iterable[Future]) -> None:
        """Keep the rows of texts whose run has ended; the others wait."""
        waiting.extend(f.result() for f in ended)
        done.extend(a.row() for a in waiting if a.ran is None or a.ran.done())
        waiting[:] = [a for a in waiting if a.ran is not None and not a.ran.done()]

    def flush() -> None:
        if done:
            spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(path)
            done.clear()

    with ThreadPoolExecutor(max_workers=parallel) as slots:
        running: set = set()
        for pair in stream:
            running.add(slots.submit(answer, *pair))
            if len(running) >= 2 * parallel:  # keep the slots busy without holding the texts
                ended, running = wait(running, return_when=FIRST_COMPLETED)
                take(ended)
            if len(done) >= batch:
                flush()
        take(running)
    done += [a.row() for a in waiting]
    flush()
    return spark.read.schema(schema).parquet(path).select("dataset", "sql", F.struct(*_FIELDS).alias("outcome"), "run")


def _failed(error: str) -> dict:
    return {"success": False, "rows": 0, "time_s": 0.0, "error": error, "fingerprint": None}


def execute_on_dataset(
    spark: SparkSession, datasets: Datasets, dataset: str, sql: str, timeout_s: float | None = TIME_LIMIT_S
) -> DataFrame:
    """Run one text on a named dataset and tag the outcome; an unknown dataset is a failed outcome."""
    try:
        outcome = execute_sql(dataset_session(spark, datasets, dataset), sql, timeout_s)
    except ValueError as unknown:
        outcome = _failed(str(unknown))
    return spark.createDataFrame([(dataset, *(outcome[k] for k in _FIELDS))], f"dataset string, {OUTCOME}")


def run_pairs(
    questions: DataFrame,
    pred: str = "pred_sql",
    gold: str = "gold_sql_exec",
    parallel: int | None = None,
    timeout_s: float | None = TIME_LIMIT_S,
    datasets: Datasets | None = None,
) -> DataFrame:
    """Add ``pred`` and ``gold`` outcomes to questions; every distinct plan of a dataset runs once.

    Only keys meet outcomes in the join on the text; a text that very many questions share is split by adaptive
    execution on the questions' side.
    """
    dataset = F.col("dataset") if "dataset" in questions.columns else F.lit(None).cast("string")
    texts = questions.select(dataset.alias("dataset"), F.col(pred).alias("sql")).union(
        questions.select(dataset.alias("dataset"), F.col(gold).alias("sql"))
    )
    outcomes = execute_texts(questions.sparkSession, texts.where("sql is not null"), parallel, timeout_s, datasets=datasets)
    rows = questions.withColumn("_dataset", dataset)
    for column, name in ((pred, "pred"), (gold, "gold")):
        ran = outcomes.select(F.col("dataset").alias("_dataset"), F.col("sql").alias("_sql"), F.col("outcome").alias(name))
        rows = null_safe_join(rows.withColumn("_sql", F.col(column)), ran, ["_dataset", "_sql"], "left").drop("_sql")
    return rows.drop("_dataset")


def preview(result: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of a result."""
    return result.limit(rows)
