"""Toxic clauses by a weighted finite-state grammar.

A lexical transducer tags the words of a clause: insult, threat, target, negation, report, or none of them. A transducer
that reads the clause from its end marks insults and threats with a target after them; three that read it from its
beginning are composed into one, which says what is negated, reported or has a target before it. Matches add up by kind with
the weights of their words, and the kinds' weights make the score: a threat counts only with a target after it, and what is
negated or reported never counts more than half of a plain insult, nor a directed one less than it. Insults and their weights
are learned, as whole words and as word beginnings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, MapType, StringType, StructField

from pricelens.llm.common import append, labelled_sample, remainder, slices, texts, written

# Fixed word lists of the grammar, in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself he him she her they them these those du dich dir dein deine ihr euch sie "
    "tu te toi ton ta vous votre il elle ils elles usted ustedes tú ti él ella ellos ellas".split()
)
NEGATIONS = frozenset(
    "not no never nobody isn aren wasn weren don doesn didn nicht kein keine keiner nie niemals "
    "pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split()
)
REPORTS = frozenset(
    "said says say wrote writes claimed claims reported reports quoted quotes called sagte sagt schrieb behauptet "
    "dit disait écrit affirme dijo dice escribió afirma".split()
)
THREATS = frozenset(
    "kill hurt destroy beat shoot burn stab töten umbringen schlagen erschießen tuer frapper détruire "
    "matar golpear destruir".split()
)
INSULTS = frozenset(
    "idiot moron loser scum trash stupid worthless pathetic disgusting trottel idiotin abschaum dummkopf "
    "imbécile crétin connard idiota imbécil estúpido".split()
)

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "X", "T", "N", "R", "o"
#: What a match counts as after composition.
KINDS = ("insult", "directed", "negated", "reported", "threat")
#: The weights of a kind's matches count up to this sum, in steps of STEP.
MOST, STEP = 12.0, 0.25
#: Words that a cue reaches.
REACH = 3
#: From parts, of which all but the last are 0 or more, to the kinds' weights with the intercept last: an insult's weight, what
#: a target adds to it, what a negation and a report take from its half, and what a threat has beyond it.
PARTS = np.array([
    [1.0, 0, 0, 0, 0, 0], [1.0, 1, 0, 0, 0, 0], [0.5, 0, -1, 0, 0, 0], [0.5, 0, 0, -1, 0, 0], [1.0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1],
])
#: The parts before any label is seen.
PRIOR = np.array([1.0, 0.2, 0.0, 0.0, 0.0, -3.0])
#: The weight of a fixed insult that no label speaks of, and of a threat.
FIXED_WEIGHT = 3.0
#: How many times more often than others toxic texts hold a term that is learned, and the likelihood ratio it needs (both as logarithms).
LEAST_WEIGHT, LEAST_EVIDENCE = 1.0, 14.0

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that can be learned.
BEGINNINGS = range(6, 9)


@dataclass
class Machine:
    """A sequential transducer over tags. `step` gives the next state and the tag that goes out."""

    start: object
    step: object


def _ahead(state, tag):
    """Read from the clause's end: a target's reach backwards."""
    if tag == TARGET:
        return REACH, tag
    return max(0, state - 1), f"t{tag}" if state and tag in (INSULT, THREAT) else tag


def _negation(state, tag):
    if tag == NEGATION:
        return REACH, tag
    return max(0, state - 1), f"n{tag}" if state and tag[-1] in (INSULT, THREAT) else tag


def _report(state, tag):
    if tag == REPORT:
        return 1, tag
    return state, f"r{tag.removeprefix('n')}" if state and tag[-1] in (INSULT, THREAT) else tag


def _target(state, tag):
    if tag == TARGET:
        return REACH, tag
    return max(0, state - 1), f"t{tag}" if state and tag == INSULT else tag


def compose(machines: list[Machine], tags: list[str]) -> tuple[list[dict[str, tuple[int, str]]], list[str]]:
    """The transducer that runs the machines one on the other's output: a table of states, state 0 first."""
    first = tuple(m.start for m in machines)
    numbers, table, todo = {first: 0}, [], [first]
    for state in todo:
        row = {}
        for tag in tags:
            out, following = tag, []
            for machine, s in zip(machines, state):
                s, out = machine.step(s, out)
                following.append(s)
            following = tuple(following)
            if following not in numbers:
                numbers[following] = len(numbers)
                todo.append(following)
            row[tag] = numbers[following], out
        table.append(row)
    return table, todo


TAGS = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER]
#: From the end of a clause, and then from its beginning.
BACKWARD = compose([Machine(0, _ahead)], TAGS)[0]
FORWARD = compose([Machine(0, _negation), Machine(0, _report), Machine(0, _target)], [*TAGS, f"t{INSULT}", f"t{THREAT}"])[0]

#: The kinds of matches; a threat without a target after it is none.
_KIND = {"I": 0, "tI": 1, "nI": 2, "ntI": 2, "ntX": 2, "rI": 3, "rtI": 3, "rtX": 3, "tX": 4}


@dataclass
class Lexicon:
    """The lexical transducer: a word becomes a tag with a weight. Insults go by their longest known beginning."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, FIXED_WEIGHT))
    beginnings: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[str, float]] = field(default_factory=dict)

    def tag(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[word] = self._tag(word)
        return found

    def _tag(self, word: str) -> tuple[str, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in reversed(BEGINNINGS):
            if len(word) > n and word[:n] in self.beginnings:
                return INSULT, self.beginnings[word[:n]]
        if word in THREATS:
            return THREAT, FIXED_WEIGHT
        cues = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT))
        return next((tag for words, tag in cues if word in words), OTHER), 0.0


def matches(text: str, lexicon: Lexicon) -> list[float]:
    """The weights of each kind's matches, over all clauses of the whole text. A word counts once for a kind."""
    low = text.lower()
    tag = lexicon.tag
    sums = [0.0] * len(KINDS)
    cues = {w for w in set(_WORD.findall(low)) if tag(w)[0] in (INSULT, THREAT)}
    if not cues:
        return sums  # no clause can match
    seen = set()
    for clause in _CLAUSE.split(low):
        found = _WORD.findall(clause)
        if cues.isdisjoint(found):
            continue
        marks, state = [], 0
        for word in reversed(found):
            state, out = BACKWARD[state][tag(word)[0]]
            marks.append(out)
        state = 0
        for word, mark in zip(found, reversed(marks)):
            state, out = FORWARD[state][mark]
            kind = _KIND.get(out)
            if kind is not None and (kind, word) not in seen:
                seen.add((kind, word))
                sums[kind] += tag(word)[1]
    return [min(x, MOST) // STEP * STEP for x in sums]


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, sums: list[float]) -> float:
        x = np.append(sums, 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50))))


#: Words of labelled texts that a task counts before it hands the counts on.
_HELD = 400_000
#: Labelled documents of each label that the model learns from, at most; taken by the order of the ids' hash.
MOST_LABELLED = 40_000
#: Tasks that the sample, which is bounded, is dealt to.
_TASKS = 64


def _term_counts(labelled: DataFrame) -> DataFrame:
    """(term, kind, n, toxic) over the texts: in how many, and in how many toxic ones, a word or beginning stands."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            keys, counts = list(held), list(held.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[1:] for k in keys]),
                    pa.array([k[0] == "b" for k in keys]),
                    pa.array([c[0] for c in counts], pa.int64()),
                    pa.array([c[1] for c in counts], pa.int64()),
                ],
                names=["term", "beginning", "n", "toxic"],
            )

    def run(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, toxic in zip(texts(part, "text"), part.column("toxic").to_pylist()):
                    found = {f"w{w}" for w in set(_WORD.findall(text.lower()))}
                    found |= {f"b{w[1 : n + 1]}" for w in found for n in BEGINNINGS if len(w) > n}
                    for term in found:
                        c = held.get(term)
                        if c is None:
                            held[term] = [1, toxic]
                        else:
                            c[0] += 1
                            c[1] += toxic
                    if len(held) > _HELD:
                        yield from flush(held)
                        held = {}
        yield from flush(held)

    counts = labelled.mapInArrow(run, "term string, beginning boolean, n long, toxic long")
    return counts.groupBy("term", "beginning").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    held_out: int = 0,
    most: int = MOST_LABELLED,
) -> Model:
    """Learns from labelled documents whose crc32(id as text) modulo 5 is not `held_out`, at most `most` of each label.

    Of texts that are equal one counts, so that copies lend a word no weight. A term is learned as an insult if toxic
    texts hold it clearly more often (LEAST_WEIGHT, LEAST_EVIDENCE); all such terms are kept, and as each stands in many toxic texts
    of the sample, the sample's bound bounds them. The kinds' weights are a ridge regression around PRIOR in the order that
    PARTS sets, its intercept moved to the share of toxic labels before the bound; a kind that no labelled text holds
    keeps what PRIOR and the insult's weight give it. Threats, targets, negations and reports are fixed lists. Rows without a label, with a null id or without a text teach nothing. An id labelled twice is
    toxic if one label says so. Without labels the fixed words and PRIOR are the model."""
    others = tuple(r for r in range(5) if r != held_out)
    labelled = written(
        labelled_sample(docs, labels, label, doc_id=doc_id, text=text, remainders=others, most=most).withColumnRenamed(
            "label", "toxic"
        ).repartition(_TASKS),
        "labelled",
    )
    n, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    lexicon = Lexicon()
    if 0 < toxic < n:
        # of toxic and of other texts, the part that holds the term; both smoothed
        here, there = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("n") - F.col("toxic") + 0.5) / (n - toxic + 1)
        part, share = F.col("toxic") / F.col("n"), toxic / n
        evidence = F.col("toxic") * F.log(part / share) + F.when(
            part < 1, (F.col("n") - F.col("toxic")) * F.log((1 - part) / (1 - share))
        ).otherwise(0.0)
        terms = (
            _term_counts(labelled)
            .where("toxic > 0")
            .select("term", "beginning", F.log(here / there).alias("weight"), evidence.alias("evidence"))
            .where((F.col("weight") >= LEAST_WEIGHT) & (F.col("evidence") >= LEAST_EVIDENCE))
            .collect()
        )
        for t in terms:
            (lexicon.beginnings if t["beginning"] else lexicon.words)[t["term"]] = t["weight"]
    counted = append(labelled, "text", [_COUNTS], _counter(labelled.sparkSession.sparkContext.broadcast(lexicon)))
    sums = [F.col("matches")[k].alias(k) for k in KINDS]
    # no more rows than labelled texts, which `most` bounds
    table = counted.select("toxic", *sums).groupBy(*KINDS).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()
    weights = _weights(np.array([[*(r[k] for k in KINDS), r["n"], r["toxic"]] for r in table], float))
    if 0 < toxic < n:
        marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("toxic")).dropna()
        of = marks.where(remainder("_id") != held_out).agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
        weights[-1] += np.log(of[1] / (of[0] - of[1])) - np.log(toxic / (n - toxic))
    return Model(lexicon, weights)


def _weights(table: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights; rows of sums by kind, then texts and toxic texts. Newton steps over the parts that are free: one at 0
    that would fall below stays."""
    parts = PRIOR.copy()
    if not len(table):
        return PARTS @ parts
    x = np.column_stack([table[:, :-2], np.ones(len(table))]) @ PARTS
    n, toxic = table[:, -2], table[:, -1]
    least = np.append(np.zeros(len(parts) - 1), -np.inf)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ parts, -50, 50)))
        gradient = x.T @ (toxic - n * p) - ridge * (parts - PRIOR)
        free = (parts > least) | (gradient > 0)
        curve = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(parts))
        step = np.zeros(len(parts))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        before, parts = parts, np.maximum(parts + np.clip(step, -1, 1), least)
        if np.abs(parts - before).max() < 1e-9:
            break
    return PARTS @ parts


#: The matches column.
_COUNTS = StructField("matches", MapType(StringType(), DoubleType()))


def _counter(lexicon):
    def make():
        known = Lexicon(lexicon.value.words, lexicon.value.beginnings)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            rows = [[*zip(KINDS, matches(t, known))] for t in texts(part, "text")]
            return [pa.array(rows, pa.map_(pa.string(), pa.float64()))]

        return work

    return make


def scores(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds score (double, 0 to 1), predicted (int, 1 from 0.5 on) and matches (map from kind to its sum of weights).

    A null or empty text matches nothing and gets the score of that. Scores come from the text alone, whole. Repeated
    rows stay. Other columns stay; one named like a new one is replaced. The model's lexicon is bounded by the sample it is
    learned from (MOST_LABELLED) and is sent to the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = Lexicon(sent.value.lexicon.words, sent.value.lexicon.beginnings)
        weigh = sent.value.score

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            found = [matches(t, known) for t in texts(part, text)]
            seen = {c: weigh(list(c)) for c in set(map(tuple, found))}
            score = [seen[tuple(c)] for c in found]
            return [
                pa.array(score, pa.float64()),
                pa.array([int(s >= 0.5) for s in score], pa.int32()),
                pa.array([[*zip(KINDS, c)] for c in found], pa.map_(pa.string(), pa.float64())),
            ]

        return work

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), _COUNTS]
    return append(docs, text, fields, make)
