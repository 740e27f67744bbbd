"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause (text between sentence marks or line ends) is the input of five weighted transducers,
composed: insults (words to marks, by a lexicon of words and beginnings of words), threats (a
verb with a target within SCOPE words before or after it), negation (what stands in its scope
is denied), reported speech (what follows it, or stands in quotes, is quoted) and targets (an
insult in a clause with a target is aimed).  Arcs have weights, which add up along a path; as an
insult may be aimed at what only follows, the target machine guesses, and paths whose guess is not
met do not count.  A clause's score is the weight of its best path, with the marks on it.

A text's score is a logistic function of what its matched clauses give: sums of weights by mark,
sum and greatest of the paths' weights, number of different marked words and of matched clauses, and
their density.  Clauses without an insult or a threat count for nothing, so common words don't score.

Learning: words and beginnings of words that mark toxic rows of a bounded sample join the given
insults, with weights by their log odds; counts are taken on the executors.  So are the features
of the sampled rows, with the lexicon of the half of the sample they are not in; the driver gets
numbers only, however long the texts are.

A text that is null or empty, or has no match, gets the score of a text without any match.
If labels of one kind are missing, the given insults and fixed weights are used.  A row with several
labels counts as toxic if one says so.  Rows are scored one by one from their text alone, whole
texts are read however long, equal texts get equal scores, so ties and repeated rows do not
matter.  An empty table gives an empty result.  Extra columns pass through; an earlier column
named toxicity is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.common import drawn, slices, stored

#: Labelled rows the lexicon and the weights are learned from, at most about this many.
SAMPLE = 8_000
PREFIXES = (4, 5, 6, 7)
MIN_TOXIC, MIN_LOG_ODDS = 4, 2.0

INSULTS = "idiot moron stupid pathetic worthless disgusting scum trash loser clown imbecile cretin fool dumb connard salaud abruti crétin débile idiota imbécil estúpido basura asqueroso trottel dummkopf abschaum widerlich erbärmlich blöd".split()
THREATS = "kill hurt destroy beat stab shoot burn strangle tuer frapper détruire matar golpear destruir töten schlagen umbringen".split()
TARGETS = "you your you're yours u they them he she tu toi vous votre ton te usted ustedes tú vosotros du dich dir ihr euch sie".split()
NEGATIONS = "not no never isn't aren't don't doesn't won't wouldn't without ne pas jamais sans nunca jamás sin nicht kein keine nie ohne".split()
REPORTS = "said says wrote writes called quoted reported according alleged claimed dit disait écrit selon dijo escribió según sagte schrieb laut".split()

_CLAUSE = re.compile(r"[.!?;\n\r]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]")
_WORD_START = re.compile(r"[^\W\d_]")
_QUOTES = "\"“”«»"


# -- weighted transducers ----------------------------------------------------------------------
Arc = tuple[object, str, float]  # next state, output, weight


@dataclass
class Transducer:
    """Weighted, from symbols to symbols; ``arcs(state, symbol)`` are the ways on, ``final(state)`` says where a path may end."""

    start: object
    arcs: Callable[[object, str], Iterable[Arc]]
    final: Callable[[object], bool] = lambda _: True

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: this one's output is the other's input; weights add up."""
        known: dict[tuple, list[Arc]] = {}

        def arcs(state: tuple, symbol: str) -> list[Arc]:
            if (state, symbol) not in known:
                known[state, symbol] = [((a, b), out, v + w) for a, mid, v in self.arcs(state[0], symbol) for b, out, w in other.arcs(state[1], mid)]
            return known[state, symbol]

        return Transducer((self.start, other.start), arcs, lambda s: self.final(s[0]) and other.final(s[1]))

    def best(self, symbols: Iterable[str]) -> tuple[float, list[tuple[str, float]]]:
        """Weight of the best path and its (output, weight) for each symbol; minus infinity if there is no path."""
        at: dict[object, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol in symbols:
            on: dict[object, tuple[float, tuple | None]] = {}
            for state, (total, path) in at.items():
                for state2, out, w in self.arcs(state, symbol):
                    if state2 not in on or total + w > on[state2][0]:
                        on[state2] = (total + w, (path, out, w))
            at = on
        ends = [v for state, v in at.items() if self.final(state)]
        if not ends:
            return -np.inf, []
        total, path = max(ends, key=lambda v: v[0])
        out = []
        while path is not None:
            path, symbol, w = path
            out.append((symbol, w))
        return total, out[::-1]


SCOPE = 4  # words that a negation or a threat reaches
#: Weights of the grammar's arcs; an insult's own is that of its word.
BARE_THREAT, THREAT, DENIED, QUOTED, AIMED = 0.25, 1.5, -1.5, -1.0, 0.5
MARKS = ("I", "Iy", "In", "Ir", "t", "T", "Tn", "Tr")


def insults(weight_of: Callable[[str], float], classes: dict[str, str]) -> Transducer:
    """Words to marks: I with the word's weight, and classes of other words (V verb of a threat, Y target, N negation, R report, a quotation mark)."""

    def arcs(state: int, word: str) -> list[Arc]:
        w = weight_of(word)
        return [(state, "I", w)] if w > 0 else [(state, '"' if word in _QUOTES else classes.get(word, "-"), 0.0)]

    return Transducer(0, arcs)


def _threats(state: tuple[int, int], s: str) -> list[Arc]:
    """State: for how many words a target before, and a verb before, still count."""
    target, verb = max(0, state[0] - 1), max(0, state[1] - 1)
    if s == "V":
        return [((target, 0), "T", THREAT)] if state[0] else [((target, SCOPE), "t", BARE_THREAT)]
    if s == "Y":
        return [((SCOPE, 0), "T", THREAT - BARE_THREAT)] if state[1] else [((SCOPE, verb), s, 0.0)]
    return [((target, verb), s, 0.0)]


def _negation(left: int, s: str) -> list[Arc]:
    if s == "N":
        return [(SCOPE, s, 0.0)]
    denied = left and s in ("I", "T", "t")
    return [(max(0, left - 1), ("I" if s == "I" else "T") + "n", DENIED)] if denied else [(max(0, left - 1), s, 0.0)]


def _reported(state: str, s: str) -> list[Arc]:
    if s == '"':
        return [("" if state == "quote" else "quote", s, 0.0)]
    if s == "R" and state != "quote":
        return [("report", s, 0.0)]
    if state and s in ("I", "T", "t"):
        return [(state, ("I" if s == "I" else "T") + "r", QUOTED)]
    return [(state, s, 0.0)]


def _targets(state: str, s: str) -> list[Arc]:
    """States: none seen, one seen, one guessed to follow."""
    if s in ("Y", "T", "Tn", "Tr"):
        return [("seen", s, 0.0)]
    if s == "I":
        return [("seen", "Iy", AIMED)] if state == "seen" else [("guessed", "Iy", AIMED), *([(state, s, 0.0)] if state == "none" else [])]
    return [(state, s, 0.0)]


PATTERNS = Transducer((0, 0), _threats) @ Transducer(0, _negation) @ Transducer("", _reported) @ Transducer("none", _targets, lambda s: s != "guessed")


# -- lexicon and model -------------------------------------------------------------------------
@dataclass
class Model:
    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 1.0))
    prefixes: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 2.0, -0.5, -0.5, 0.5, 3.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5, 0.0]))
    _made: tuple | None = None

    def __post_init__(self) -> None:
        self.classes = {w: c for c, ws in (("V", THREATS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _made=None)

    def insult(self, word: str) -> float:
        """The weight of a word as an insult, by itself or by its beginning."""
        if (w := self.words.get(word)) is not None:
            return w
        return max((self.prefixes.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n), default=0.0) if self.prefixes else 0.0

    def made(self) -> tuple:
        """The grammar composed with this lexicon, and a search for where an insult or a threat may stand; only such clauses are parsed."""
        if self._made is None:
            search = ahocorasick.Automaton()
            for w in {*self.words, *self.prefixes, *THREATS}:
                search.add_word(w, len(w))
            search.make_automaton()
            words = insults(self.insult, self.classes)
            # the lexicon's arcs are made anew, as words are without number; those of the patterns are remembered
            grammar = Transducer((words.start, PATTERNS.start), lambda s, x: [((a, b), out, v + w) for a, mid, v in words.arcs(s[0], x) for b, out, w in PATTERNS.arcs(s[1], mid)], lambda s: PATTERNS.final(s[1]))
            self._made = grammar, search
        return self._made

    def clauses(self, text: str) -> Iterator[tuple[float, list[tuple[str, str, float]]]]:
        """Weight of the best path and (word, mark, weight) of the marked words, of each clause with a match."""
        low = text.lower()
        grammar, search = self.made()
        done = -1
        for end, n in search.iter(low) if len(search) else ():
            at = end - n + 1
            if at < done or (at and _WORD_START.match(low[at - 1])):
                continue
            begin = max(low.rfind(c, max(done, 0), at) for c in ".!?;\n\r") + 1 or max(done, 0)
            m = _CLAUSE.search(low, at)
            done = m.start() if m else len(low)
            tokens = _WORD.findall(low, begin, done)
            total, path = grammar.best(tokens)
            marked = [(t, o, w) for t, (o, w) in zip(tokens, path, strict=True) if o in MARKS]
            if marked:
                yield total, marked

    def features(self, text: str | None) -> np.ndarray:
        """Bias; of matched clauses: weights by mark, their sum and the greatest, different words, clauses (logarithmic), and density.

        Repeated words and equal clauses count by the logarithm of their number, so a repeated line is not many insults.
        """
        words, found = Counter(), Counter()
        for total, marked in self.clauses(text or ""):
            words.update((word, mark) for word, mark, _ in marked)
            found[max(total, 0.0), tuple(word for word, *_ in marked)] += 1
        sums = dict.fromkeys(MARKS, 0.0)
        for (word, mark), n in words.items():
            sums[mark] += (self.insult(word) or 1.0) * (1 + np.log(n))
        totals = [total * (1 + np.log(n)) for (total, _), n in found.items()]
        total, lexemes = sum(sums.values()), len({word for word, mark in words if mark[0] == "I"})
        return np.array([1.0, *(np.log1p(sums[o]) for o in MARKS), np.log1p(sum(totals)), max((t for t, _ in found), default=0.0), np.log1p(lexemes), np.log1p(len(found)), 1000 * total / (len(text) + 500) if total else 0.0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


# -- learning ----------------------------------------------------------------------------------
def marks_of(counts: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Terms whose presence marks toxic rows, with weights from 0 to 1 by log odds; counts: (toxic rows, other rows) that hold each."""
    out = {}
    for w, (a, c) in counts.items():
        if a >= max(MIN_TOXIC, 0.004 * n1):
            odds = np.log((a + 0.5) / (n1 + 1)) - np.log((c + 0.5) / (n0 + 1))
            # one standard error below, so that rare marks need a cleaner record
            odds -= np.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) if c else np.sqrt(1 / (a + 0.5))
            if odds >= MIN_LOG_ODDS:
                out[w] = float(min(1.0, odds / 4))
    return out


def presence(rows: DataFrame) -> DataFrame:
    """(term, is_prefix, c00, c01, c10, c11): rows of (text, half, toxic) that hold each word or beginning of a word, by half and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in (x for batch in batches for x in slices(batch)):
            for text, half, toxic in zip(*(b.column(c).to_pylist() for c in ("text", "half", "toxic")), strict=True):
                found = set(_WORD.findall((text or "").lower()))
                terms = {(w, False) for w in found if len(w) > 2} | {(w[:n], True) for w in found for n in PREFIXES if len(w) >= n}
                counts.update((t, p, 2 * half + toxic) for t, p in terms)
        columns = zip(*((*k, n) for k, n in counts.items()), strict=True) if counts else [()] * 4
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int32(), pa.int64()), strict=True)], names=["term", "is_prefix", "cell", "n"])

    cells = rows.select("text", "half", "toxic").mapInArrow(run, "term string, is_prefix boolean, cell int, n long")
    return cells.groupBy("term", "is_prefix").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == i, F.col("n"))), F.lit(0)).alias(f"c{i:02b}") for i in range(4)])


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-3] + [0.02 * len(y) ** 0.5] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), g)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """A model from labelled rows for which ``learn`` (of doc_id) holds, on at most about ``sample`` of them."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(learn)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    # half of the sample may be toxic rows, which are rare
    share = F.when(F.col("toxic") == 1, min(1.0, sample / 2 / counts[1])).otherwise(min(1.0, sample / 2 / counts[0]))
    picked = known.filter(drawn("doc_id", 5) < share).withColumn("half", (drawn("doc_id", 6) < 0.5).cast("int"))
    # ids and labels of the sample, which its parameter bounds, are sent to every task
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "labelled")
    n = {(r.half, r.toxic): r.n for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = {(h, y): n.get((h, y), 0) for h in (0, 1) for y in (0, 1)}
    if not (n[0, 0] + n[1, 0] and n[0, 1] + n[1, 1]):
        return Model()
    terms = presence(rows).filter(F.col("c01") + F.col("c11") >= MIN_TOXIC).collect()

    def lexicon(halves: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
        of = [{r.term: tuple(sum(r[f"c{h}{y}"] for h in halves) for y in (1, 0)) for r in terms if r.is_prefix == p} for p in (False, True)]
        n1, n0 = (sum(n[h, y] for h in halves) for y in (1, 0))
        return dict.fromkeys(INSULTS, 1.0) | marks_of(of[0], n1, n0), marks_of(of[1], n1, n0)

    # features by the lexicon that a row had no part in
    other = [Model(*lexicon((1,))), Model(*lexicon((0,)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch)):
            found = [other[h].features(t).tolist() for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(found, pa.list_(pa.float64())), b.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(run, "x array<double>, toxic int").toArrow()
    both = np.column_stack([np.array(got["x"].to_pylist()), np.array(got["toxic"].to_pylist(), float)])
    both = both[np.lexsort(both.T)]  # sums in the same order, however the rows arrive; here, as Spark would make the features twice to sort them
    x, y = both[:, :-1], both[:, -1]
    model = Model(*lexicon((0, 1)), regression(x, y))
    # toxic rows are more frequent in the sample than among the labels
    model.weights[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` (but an own earlier one of this name), and toxicity."""
    docs = docs.drop("toxicity")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, text_col)):
            yield pa.record_batch([*b.columns, pa.array([shared.value.score(t) for t in b.column(text_col).to_pylist()], pa.float64())], names=[*names, "toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))
