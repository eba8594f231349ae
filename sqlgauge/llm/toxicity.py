"""Toxicity by a weighted finite-state grammar of clauses.

Five small transducers read a clause word by word, one behind the other: reported speech and negation lower the weight of
the insults and threats behind them, a target turns the insults and threats behind it into directed ones, and the insult
and the threat transducer weigh what arrives: a match that is not directed stays open for a few words, and a target
there directs it after all ("kill you"). Their composition is one automaton over word classes, and a clause's score is
the sum along its path: an entry's weight times the weight of the pattern it stands in. Insults are learnt: words and
word beginnings whose rate in toxic texts is far above that in clean ones. The other word lists are fixed and short. A
clause is read once, from its true start to its true end, however long it is. A document's features are the scores of
its clauses, and a logistic curve over them gives the score.

Learning uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``MAX_TRAINING`` of them (chosen by a
hash of the id). An entry of the lexicon stands in ``MIN_SHARE`` of the toxic ones at least, so there are at most
1 / ``MIN_SHARE`` times as many entries as such a text has on average, and the model needs no other bound. Every document
is scored by its whole text only. Without labels of both kinds the score is the share of toxic labels (0 with none).

Null and empty texts are scored like any text (no clause). Rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import extended, prepared, slices, tidy, with_columns

MAX_TRAINING = 20_000
MIN_SHARE = 0.02
MIN_WEIGHT = 2.0
STEMS = range(4, 9)

THREATS = "kill hurt destroy beat shoot stab burn töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()
TARGETS = "you your yours he she they them him her du dich ihr euch sie tu toi vous il elle ils tú usted ustedes vosotros él ella".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say reported quoted wrote claimed sagte schrieb zitiert dit écrit cité dijo escribió citado".split()

BORDERS = ".!?;:\n"
_CLAUSE = re.compile(f"[{BORDERS}]")
_WORD = re.compile(r"[\w']+")


#: What an insult or threat counts for in each context; a bare one counts 1.
FACTORS = {"target": 1.25, "negated": 0.5, "reported": 0.7}
#: What a match counts for in addition when a target follows it.
FOLLOWED = {"insult": 0.25, "threat": 0.5}
#: For how many words behind them targets, negations and open matches reach.
REACH = {"target": 4, "negation": 3, "insult": 4, "threat": 4}
KINDS = ("insult", "threat", "target", "negation", "report", "other")
HITS = ("insult", "threat")


class Transducer:
    """States 0..n-1. ``arcs`` maps a state and a symbol to the next state, the symbol passed on, and a weight.

    Without an arc of its own a symbol passes unchanged with weight 1, and the state falls by one (``fades``) or stays.
    """

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]], fades: bool = True) -> None:
        self.arcs, self.fades = arcs, fades

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (max(0, state - 1) if self.fades else state, symbol, 1.0))


def reported_speech() -> Transducer:
    """Lowers every match behind a reporting word, up to the clause's end."""
    return Transducer({(0, "report"): (1, "report", 1.0), **{(1, h): (1, h, FACTORS["reported"]) for h in HITS}}, fades=False)


def negation() -> Transducer:
    """Lowers the matches close behind a negation."""
    reach = REACH["negation"]
    opened = {(s, "negation"): (reach, "negation", 1.0) for s in range(reach + 1)}
    return Transducer({**opened, **{(s, h): (s - 1, h, FACTORS["negated"]) for s in range(1, reach + 1) for h in HITS}})


def target() -> Transducer:
    """Passes the matches close behind a target on as directed ones."""
    reach = REACH["target"]
    opened = {(s, "target"): (reach, "target", 1.0) for s in range(reach + 1)}
    return Transducer({**opened, **{(s, h): (s - 1, "directed " + h, 1.0) for s in range(1, reach + 1) for h in HITS}})


def match(kind: str) -> Transducer:
    """Weighs directed matches of this kind at once; others stay open until a target directs them or a further match comes."""
    reach = REACH[kind]
    arcs = {}
    for state in range(reach + 1):
        arcs[state, kind] = (reach, kind, 1.0)
        arcs[state, "directed " + kind] = (0, "directed " + kind, FACTORS["target"])
        for other in (h for h in HITS if h != kind):
            arcs[state, other] = (0, other, 1.0)
            arcs[state, "directed " + other] = (0, "directed " + other, 1.0)
        if state:
            arcs[state, "target"] = (0, "directs", FOLLOWED[kind])
    return Transducer(arcs)


class Grammar:
    """The composition of transducers: the symbols one passes on are the next one's, and the weights multiply.

    ``arcs[kind][state]`` is (next state, what happens, weight) for the states that can be reached.
    """

    OPENS, COUNTS, CLOSES, PASSES = range(4)

    def __init__(self, parts: list[Transducer]) -> None:
        does = {h: self.OPENS for h in HITS} | {"directed " + h: self.COUNTS for h in HITS} | {"directs": self.CLOSES}
        number = {(0,) * len(parts): 0}
        self.arcs: dict[str, list[tuple[int, int, float]]] = {kind: [] for kind in KINDS}
        for state in (reached := list(number)):  # grows while it is read
            for kind in KINDS:
                symbol, weight, following = kind, 1.0, []
                for part, own in zip(parts, state):
                    after, symbol, factor = part.step(own, symbol)
                    weight *= factor
                    following.append(after)
                if (following := tuple(following)) not in number:
                    number[following] = len(number)
                    reached.append(following)
                self.arcs[kind].append((number[following], does.get(symbol, self.PASSES), weight))

    def score(self, clause: Iterable[tuple[str, float]]) -> float:
        state, total, held = 0, 0.0, 0.0
        for kind, weight in clause:
            state, action, factor = self.arcs[kind][state]
            if action == self.PASSES:
                continue
            if action == self.CLOSES:
                total += held * factor
            else:
                held = weight * factor
                total += held
        return total


def grammar() -> Grammar:
    return Grammar([reported_speech(), negation(), target(), match("insult"), match("threat")])


@dataclass
class Model:
    """``words`` and ``stems`` (word beginnings) with weights, and the curve over a document's features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0, 0.0, 0.0])

    def compile(self) -> Model:
        """The automaton that finds entries, and the grammar; built where it is used."""
        import ahocorasick

        self.grammar = grammar()
        self.fixed = {w: k for k, held in zip(KINDS[2:5], (TARGETS, NEGATIONS, REPORTS)) for w in held}
        self.threats = {w: 3.0 for w in THREATS if w not in self.words}
        self.finder = ahocorasick.Automaton()
        for entry in {*self.words, *self.stems, *self.threats}:
            self.finder.add_word(entry, len(entry))
        if len(self.finder):
            self.finder.make_automaton()
        return self

    def weigh(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word, 0.0)
        for n in STEMS:
            if n <= len(word):
                weight = max(weight, self.stems.get(word[:n], 0.0))
        if weight:
            return "insult", weight
        if word in self.threats:
            return "threat", self.threats[word]
        return self.fixed.get(word, "other"), 0.0

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that hold an insult or a threat; each such clause is read once, word by word."""
        low = text.lower()
        if not len(self.finder):
            return []
        found, done = [], 0
        for spot in sorted(end - n + 1 for end, n in self.finder.iter(low)):
            if spot < done or (spot and (low[spot - 1].isalnum() or low[spot - 1] == "_")):
                continue
            start = max(low.rfind(c, done, spot) for c in BORDERS) + 1 or done
            stop = _CLAUSE.search(low, spot)
            done = stop.start() if stop else len(low)
            if score := self.grammar.score(self.weigh(w.group()) for w in _WORD.finditer(low, start, done)):
                found.append(score)
        return found

    def features(self, text: str | None) -> list[float]:
        return self.measures(self.clauses(text) if text else [], len(text or ""))

    def measures(self, scores: list[float], length: int) -> list[float]:
        """What the curve reads of a text of this length whose clauses have these scores."""
        total = math.log1p(sum(scores))
        return [1.0, total, math.log1p(len(scores)), max(scores, default=0.0) / 5, total * math.log1p(length / 1000)]

    def probability(self, features: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.curve, features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _count_step(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, docs, held = (Counter(), Counter()), (Counter(), Counter()), [0, 0]

        def rows() -> pa.RecordBatch:
            names = [*{*docs[0], *docs[1]}]
            sizes = [("", sum(tokens_total), *tokens_total, *held)]
            out = [(n, 0, tokens[0][n], tokens[1][n], docs[0][n], docs[1][n]) for n in names] + sizes
            return pa.RecordBatch.from_pydict(
                {"entry": [r[0] for r in out], "t0": [r[2] for r in out], "t1": [r[3] for r in out], "d0": [r[4] for r in out], "d1": [r[5] for r in out]}
            )

        tokens_total = [0, 0]
        for batch in batches:
            for text, toxic in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_col, "toxic"))):
                count = Counter(_WORD.findall((text or "").lower()))
                tokens_total[toxic] += sum(count.values())
                held[toxic] += 1
                seen = set()
                for word, n in count.items():
                    for entry in ["=" + word, *("^" + word[:k] for k in STEMS if k <= len(word))]:
                        tokens[toxic][entry] += n
                        seen.add(entry)
                docs[toxic].update(seen)
            if len(docs[0]) + len(docs[1]) > 60_000:  # so many entries take some 30 MB
                yield rows()
                for c in (*tokens, *docs):
                    c.clear()
                held[:], tokens_total[:] = [0, 0], [0, 0]
        yield rows()

    return run


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Texts and labels of the training rows; equal texts once."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rows = known.orderBy(F.xxhash64("_label_id"), "_label_id").limit(most).collect()
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(known.schema.fields)]
    chosen = spark.createDataFrame(pa.Table.from_arrays(columns, known.columns), known.schema)  # a list would start Python workers
    joined = prepared(docs).select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_label_id"))  # at most MAX_TRAINING rows
    return joined.select(F.col(text_col).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropDuplicates()


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_TRAINING
) -> Model:
    """Learn the lexicon and the curve."""
    from ..plans.scratch import materialize

    sample = materialize(_sample(docs, labels, id_col, text_col, most), "toxic-sample")
    counted = sample.mapInArrow(tidy(_count_step("text")), "entry string, t0 long, t1 long, d0 long, d1 long")
    counted = counted.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "d0", "d1")))
    counted = materialize(counted, "toxic-counts")
    sizes = counted.where("entry = ''").first()
    model = Model()
    if sizes is None or not sizes["d0"] or not sizes["d1"]:
        share = 0.0 if sizes is None or not sizes["d1"] else 1.0
        model.curve = [40.0 if share else -40.0, 0.0, 0.0, 0.0, 0.0]
        return model
    weight = F.log((F.col("t1") + 0.5) / (sizes["t1"] + 1)) - F.log((F.col("t0") + 0.5) / (sizes["t0"] + 1))
    least = max(5, math.ceil(MIN_SHARE * sizes["d1"]))
    top = (
        counted.where((F.col("entry") != "") & (F.col("d1") >= least)).withColumn("weight", weight)
        .where(F.col("weight") >= MIN_WEIGHT).orderBy(F.desc(F.col("weight") * F.sqrt("d1")), "entry")
    )
    rows = top.collect()
    longest: dict[tuple, str] = {}  # of beginnings that stand for the same words, the longest
    for row in sorted(rows, key=lambda r: len(r["entry"])):
        if row["entry"][0] == "=":
            model.words[row["entry"][1:]] = round(row["weight"], 4)
        else:
            key = row["entry"][1 : STEMS.start + 1], row["t0"], row["t1"], row["d0"], row["d1"]
            if key in longest and row["entry"][1:].startswith(longest[key]):
                del model.stems[longest[key]]
            longest[key] = row["entry"][1:]
            model.stems[row["entry"][1:]] = round(row["weight"], 4)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.compile()
        for batch in batches:
            values = [own.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    rows = sample.mapInArrow(tidy(measure), "x array<double>, toxic int").collect()  # at most MAX_TRAINING short rows
    x = np.array([r["x"] for r in rows])
    y = np.array([r["toxic"] for r in rows], float)
    order = np.lexsort((*x.T, y))
    model.curve = _logistic(x[order], y[order]).tolist()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps for a logistic curve with a small penalty on all but the constant."""
    curve = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -40, 40)))
        slope = x.T @ (y - p) - penalty @ curve
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, slope)
        curve = curve + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return curve


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns plus _toxicity (0 to 1) and _clauses (scores of the matched clauses)."""

    docs = prepared(docs, "_toxicity double, _clauses array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.compile()
        for batch in slices(batches, text_col, 2 << 20):
            values, clauses = [], []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                clauses.append(own.clauses(text) if text else [])
                values.append(own.probability(own.measures(clauses[-1], len(text or ""))))
            yield with_columns(
                batch, {"_toxicity": pa.array(values, pa.float64()), "_clauses": pa.array(clauses, pa.list_(pa.float64()))}
            )

    return docs.mapInArrow(tidy(run), extended(docs.schema, "_toxicity double, _clauses array<double>"))
