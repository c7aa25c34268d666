"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults and threats with weights, targets (who is addressed), negations, verbs
of saying, others. Over these symbols run small transducers: negation marks insults and threats a
few words behind it, reported speech those to the end of the clause, a target those a few words from
it on either side; the insult and the threat transducer read the marks and write each match on a
tape: aimed, plain, negated, reported or threat. They are composed into two machines, one that reads
a clause forward and one that reads what the first wrote backward. A clause scores on each tape by
its strongest match, a document by its clauses' weights through a logistic function, so a negated or
quoted insult may count for less than an aimed one, as far as the labels say.

Insults and their weights are learned from labelled rows, as are the tapes' coefficients. The rows
for that are a sample of at most ``max_train`` documents in hash order; near copies share one
vote. Scoring reads every word of every text, inside tasks that hold the fitted grammar only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UPPER, materialize, shingle_hashes, words

# Words that the grammar knows without labels.
INSULTS = "idiot moron stupid loser scum worthless pathetic disgusting trash clown dumb fool jerk coward pig".split()
THREATS = "kill hurt destroy beat punish crush burn shoot stab hunt".split()
TARGETS = "you your yours he she him her they them his their du dich dir ihr euch tu toi vous te usted ustedes".split()
NEGATIONS = "not never no isn aren wasn don doesn nicht kein keine nie pas jamais nunca tampoco".split()
SAYING = "said says say wrote writes claimed quoted called sagte schrieb dit dijo escribió".split()

INSULT_WEIGHT = 3.0
REACH = 3
TAPES = ("aimed", "plain", "negated", "reported", "threat")
#: What a match on a tape counts beside a plain one, before labels say more.
FACTORS = np.array([1.2, 1.0, 0.5, 0.5, 0.8])
#: Coefficients without labels: intercept, all tapes by their factors, each tape besides, log length of a
#: text with a match. With labels they are where the fit starts and is drawn to, by ``RIDGE``.
PRIOR = np.array([-4.0, 2.6, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
RIDGE = np.array([0.3, 0.03, 0.5, 0.5, 0.5, 0.5, 0.5, 0.3])
INPUTS = (*TAPES, "length")
PREFIXES = (4, 5, 6)
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[.!?;:|\n]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())


# Symbols: i insult, t threat, y target, n negation, s saying, o other; a mark is put behind an i or t.
SYMBOLS = "ityns" + "o"
NEGATED, REPORTED, AIMED = "-~@"


class Transducer:
    """A sequential transducer: ``table[state][symbol]`` is the next state and the symbol written."""

    def __init__(self, start, step, symbols):
        """Tabulates ``step(state, symbol)`` over all states that ``symbols`` lead to."""
        self.start, self.table = start, {}
        waiting = [start]
        while waiting:
            state = waiting.pop()
            if state not in self.table:
                self.table[state] = {x: step(state, x) for x in symbols}
                waiting += [to for to, _ in self.table[state].values()]

    def writes(self) -> set[str]:
        return {out for arcs in self.table.values() for _, out in arcs.values()}

    def then(self, make) -> Transducer:
        """Composition with ``make(symbols)``, the transducer that reads what this one writes."""
        symbols = sorted(next(iter(self.table.values())))
        other = make(sorted(self.writes()))

        def step(state, x):
            a, y = self.table[state[0]][x]
            b, z = other.table[state[1]][y]
            return (a, b), z

        return Transducer((self.start, other.start), step, symbols)

    def run(self, symbols) -> list[str]:
        state, table, out = self.start, self.table, []
        for x in symbols:
            state, y = table[state][x]
            out.append(y)
        return out


def _marking(opens: str, mark: str, reach: int | None):
    """Marks insults and threats up to ``reach`` words behind an ``opens``; with None, all that follow."""

    def step(left: int, x: str) -> tuple[int, str]:
        out = x + mark if left and x[0] in "it" and mark not in x else x
        return (reach or 1) if x == opens else max(left - 1, 0) if reach else left, out

    return lambda symbols: Transducer(0, step, symbols)


negation = _marking("n", NEGATED, REACH)
reported_speech = _marking("s", REPORTED, None)
target = _marking("y", AIMED, REACH)


def insult(symbols) -> Transducer:
    """Insults to tapes: negated before reported before aimed."""
    tape = lambda x: "negated" if NEGATED in x else "reported" if REPORTED in x else "aimed" if AIMED in x else "plain"
    return Transducer(0, lambda q, x: (q, tape(x) if x[0] == "i" else x), symbols)


def threat(symbols) -> Transducer:
    """Threats at a target, neither negated nor reported, to their tape; the rest writes nothing."""

    def step(q: int, x: str) -> tuple[int, str]:
        return q, "threat" if x[0] == "t" and x[1:] == AIMED else x if x in TAPES else ""

    return Transducer(0, step, symbols)


FORWARD = negation(list(SYMBOLS)).then(reported_speech).then(target)
BACKWARD = target(sorted(FORWARD.writes())).then(insult).then(threat)
_TAPE = {x: i for i, x in enumerate(TAPES)}


def tapes_of_clause(symbols: list[str]) -> list[str]:
    """For each word of a clause the tape it is a match on, or nothing."""
    return BACKWARD.run(FORWARD.run(symbols)[::-1])[::-1]


_CLASS = {w: x for x, ws in (("t", THREATS), ("y", TARGETS), ("n", NEGATIONS), ("s", SAYING)) for w in ws}


@dataclass
class Grammar:
    """The insults' words and stems with weights, and the coefficients."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, INSULT_WEIGHT))
    stems: dict[str, float] = field(default_factory=dict)
    coef: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def insult(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in PREFIXES))

    def tapes(self, text: str, dull: set[str]) -> list[float]:
        """Weight matched on each tape, and the text's length if any is: in a long text a match by
        chance means less. ``dull``: words known to start no match, kept between texts."""
        text = text.translate(LOWER)
        found = WORD.findall(text)
        new = set(found).difference(dull)
        hot = {w: self.insult(w) for w in new}
        hot = {w: v or 1.0 for w, v in hot.items() if v or _CLASS.get(w) == "t"}
        if len(dull) > 300_000:
            dull.clear()
        dull |= new - hot.keys()
        out = [0.0] * len(INPUTS)
        if not hot:
            return out
        clause: list[str] = []
        for token in TOKEN.findall(text):
            if token in ".!?;:|\n":
                self._clause(clause, hot, out)
                clause = []
            else:
                clause.append(token)
        self._clause(clause, hot, out)
        if any(out):
            out[-1] = len(found)
        return [math.log1p(x) for x in out]

    def _clause(self, clause: list[str], hot: dict[str, float], out: list[float]) -> None:
        if hot.keys().isdisjoint(clause):
            return
        best = [0.0] * len(TAPES)
        symbols = [_CLASS.get(w, "i") if w in hot else _CLASS.get(w, "o") for w in clause]
        for word, tape in zip(clause, tapes_of_clause(symbols)):
            if tape:
                best[_TAPE[tape]] = max(best[_TAPE[tape]], hot[word])
        for i, weight in enumerate(best):
            out[i] += weight

    def tape_weights(self) -> np.ndarray:
        """What each tape counts."""
        return self.coef[1] * FACTORS + self.coef[2:-1]

    def score(self, tapes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(tapes) @ self.coef, -30, 30)))


def _inputs(tapes: np.ndarray) -> np.ndarray:
    """Columns of the coefficients: one, all tapes by their factors, each tape, length."""
    return np.hstack([np.ones((len(tapes), 1)), tapes[:, :-1] @ FACTORS[:, None], tapes])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """``text, toxic, weight``: labelled documents not held out, at most ``max_train``; of several texts with
    one id one is taken. Documents with the same least shingle, mostly near copies, share a weight of 1."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.select("text", "toxic", words(F.col("text")).alias("w"))
    rows = materialize(rows.select("text", "toxic", F.array_min(shingle_hashes("w", 4)).alias("mh")), "op8-train")
    copies = materialize(rows.groupBy("mh").agg(F.count("*").alias("n")), "op8-copies")
    return rows.join(copies, "mh").select("text", "toxic", (1 / F.col("n")).alias("weight"))


def _count_features(batches):
    """Weighted numbers of toxic and clean documents with each word and stem, a batch at a time."""
    for pdf in batches:
        toxic, clean = Counter(), Counter()
        for text, label, weight in zip(pdf["text"], pdf["toxic"], pdf["weight"]):
            own = set(WORD.findall(text.translate(LOWER)))
            feats = own | {f"{w[:n]}*" for w in own for n in PREFIXES if len(w) >= n}
            counter = toxic if label == 1 else clean
            for f in feats:
                counter[f] += weight
        keys = list(toxic.keys() | clean.keys())
        yield pd.DataFrame({"f": keys, "t": [float(toxic[k]) for k in keys], "c": [float(clean[k]) for k in keys]})


def fit_grammar(
    docs: DataFrame, labels: DataFrame, max_train: int = 20_000, least_g: float = 15.1, least_odds: float = 2.0
) -> Grammar:
    """Learn the grammar from labelled rows whose crc32(doc_id) mod 3 is not 1.

    A word or stem is an insult if toxic documents have it more than clean ones by a log-likelihood
    ratio of ``least_g`` (15.1: one in 10,000 by chance) and by log odds of ``least_odds``. Without both kinds of labels the fixed words and
    coefficients stay.
    """
    g = Grammar()
    rows = _training_rows(docs, labels, max_train)
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    n_t, n_c = float(size.get(1) or 0), float(sum(v for k, v in size.items() if k != 1))
    if not n_t or not n_c:
        return g
    counts = rows.mapInPandas(_count_features, "f string, t double, c double").groupBy("f").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")
    )
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    t, c = F.col("t"), F.col("c")
    of_all = (t + c) / (n_t + n_c)
    llr = 2 * (
        part(t, of_all * n_t) + part(c, of_all * n_c)
        + part(n_t - t, (1 - of_all) * n_t) + part(n_c - c, (1 - of_all) * n_c)
    )
    odds = F.log((t + 0.5) / (n_t + 1)) - F.log((c + 0.5) / (n_c + 1))
    best = counts.withColumn("g", llr).withColumn("odds", odds).where((F.col("g") >= least_g) & (F.col("odds") >= least_odds))
    found = {r.f: (r.t, float(r.odds)) for r in best.orderBy("f").collect()}
    begun: dict[str, list[tuple[float, str]]] = {}
    for f, (t_f, _) in found.items():
        for n in PREFIXES:
            begun.setdefault(f.rstrip("*")[:n], []).append((t_f, f))
    for f, (t_f, odds_f) in found.items():
        # A stem counts if it has more to it than one of the longer entries it begins.
        longer = (t for t, x in begun[f.rstrip("*")[: PREFIXES[-1]]] if x != f)
        if not f.endswith("*"):
            g.words[f] = odds_f
        elif t_f * 0.8 > max(longer, default=0.0):
            g.stems[f[:-1]] = odds_f

    def tapes_of(batches):
        dull: set[str] = set()
        for pdf in batches:
            x = pd.DataFrame([g.tapes(s, dull) for s in pdf["text"]], columns=INPUTS)
            yield x.assign(y=(pdf["toxic"] == 1).astype("int32").values, weight=pdf["weight"].values)

    schema = ", ".join(f"{c} double" for c in INPUTS) + ", y int, weight double"
    # Equal rows combine: most documents match nothing.
    x = rows.mapInPandas(tapes_of, schema).groupBy(*INPUTS, "y").agg(F.sum("weight").alias("weight")).toPandas()
    g.coef = _logistic(x[list(INPUTS)].to_numpy(), x["y"].to_numpy(), x["weight"].to_numpy())
    return g


def _logistic(tapes: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60) -> np.ndarray:
    """Projected Newton steps, halved until the penalised loss falls. The penalty pulls to the prior;
    matches never count against toxicity, length never for it."""
    x = _inputs(tapes)
    low = np.array([-np.inf, 0.1] + [-0.04] * len(TAPES) + [-np.inf])
    high = np.array([np.inf] * (2 + len(TAPES)) + [0.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(w @ (np.logaddexp(0, z) - y * z)) + float(RIDGE @ (b - PRIOR) ** 2) / 2

    b, now = PRIOR.copy(), loss(PRIOR)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - y)) + RIDGE * (b - PRIOR)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(RIDGE)
        free = ~(((b <= low) & (grad > 0)) | ((b >= high) & (grad < 0)))
        step = np.zeros(len(b))
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        size = 1.0
        while size > 1e-6 and loss(trial := np.clip(b - size * step, low, high)) > now:
            size /= 2
        if size <= 1e-6 or now - loss(trial) < 1e-9:
            break
        b, now = trial, loss(trial)
    return b


def toxicity_score(text: Column, g: Grammar) -> Column:
    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dull: set[str] = set()
        for batch in texts:
            tapes = np.array([g.tapes(t or "", dull) for t in batch]).reshape(len(batch), len(INPUTS))
            yield pd.Series(g.score(tapes))

    return of(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """Per document: ``doc_id, held_out`` (crc32 of the id as text mod 3 is 1: not learned from),
    ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only the text is scored. Null and wordless texts score like one without any match; repeated
    rows all come back; a null doc_id is not held out. Labels that are null, or of ids that are
    null or unknown, are ignored; of several for an id the highest holds. With empty labels
    the fixed grammar scores.
    """
    g = fit_grammar(docs, labels, **fit)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), g).alias("score"))
    return scored.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
