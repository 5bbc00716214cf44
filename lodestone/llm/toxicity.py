"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. Each word of a clause is read as one symbol: insult, threat, target (whom it is aimed at),
negation, reporting (speech of others), or other. Transducers run over the symbols of a clause, each a small table of
(state, symbol) -> (state, weight): the insult transducer raises what it has matched when a target stands near, the threat
transducer needs a threat followed by a target, negation turns the next match off, reporting discounts the rest of the
clause. Their composition gives a clause its weight; a text's score is a calibrated function of the weights of its matched
clauses, not of isolated words.

The insult and threat lexicons start from listed words and grow by words and stems whose documents are far more often labelled toxic
than others, weighed by log odds (labels do not tell the kind, so what is learned is read as an insult); the calibration is a logistic regression on the grammar's features. Both learn only from
labelled training rows, about ``max_rows`` of them, chosen by a hash. Features come from the text alone.

Null and empty texts have no clauses and get the score of none. Very long texts are read whole, word by word. Repeated rows
score alike, as do rows without an id. Ties and order of rows play no part. Further columns stay but for those named like a result
(score, predicted); to keep such columns too, pass rows in a struct. Without labelled
rows of both kinds the listed words and fixed weights decide. Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import remainder, written
from lodestone.llm.units import held

INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown fool dumb imbecile pig vermin bastard jerk".split()
THREATS = "kill hurt destroy beat smash punish crush burn hang shoot stab".split()
TARGETS = "you your yours he she they them him her thou these those this who people everyone tu vous ihr du sie".split()
NEGATIONS = "not no never nobody none isn't aren't wasn't don't nicht kein pas jamais nunca".split()
REPORTS = "said says wrote quoted reported called claimed according told".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Insult transducer: states 0 nothing, 1 negated, 2 target seen, 3 negated with target, 4 an insult waits for its target.
# (state, symbol) -> (state, factor of the word's weight). Half an insult's weight comes with its target, before or after it.
INSULT_MOVES = {
    (0, TARGET): (2, 0), (0, NEGATION): (1, 0), (0, INSULT): (4, 0.5), (1, INSULT): (0, 0.2), (1, TARGET): (3, 0), (2, INSULT): (2, 1.3), (2, NEGATION): (3, 0),
    (3, INSULT): (2, 0.25), (4, TARGET): (2, 0.5), (4, INSULT): (4, 1.0), (4, NEGATION): (1, 0),
}
# Threat transducer: 0 nothing, 1 a threat waits for its target, 2 negated.
THREAT_MOVES = {(0, THREAT): (1, 0.1), (0, NEGATION): (2, 0), (1, TARGET): (0, 1.0), (1, NEGATION): (2, 0), (2, THREAT): (0, 0), (1, THREAT): (1, 0.2)}
#: A reporting verb discounts what follows in its clause.
REPORTED = 0.7
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
HEADS = (INSULT, THREAT)
#: Lengths of stems, longest first.
STEMS = (6, 5, 4)
FEATURES = ("_grammar_clauses", "_grammar_weight", "_grammar_strongest", "_grammar_density")


class Grammar:
    """Symbols and weights by word or by stem (a word's beginning), and the composed transducers."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.symbol = {w: (s, 1.0) for s, ws in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.stems = {w[:-1]: (INSULT, x) for w, x in (weights or {}).items() if w.endswith("*")}
        for w, x in (weights or {}).items():
            if self.symbol.get(w, (INSULT,))[0] == INSULT:
                self.symbol[w] = (INSULT, x)
        self.read = Symbols(self)

    def look_up(self, word: str) -> tuple[int, float] | None:
        got = self.symbol.get(word)
        if got is None:
            for n in STEMS:
                if len(word) > n and (got := self.stems.get(word[:n])) is not None:
                    break
        return got

    def clause(self, symbols: list) -> float:
        """Weight of one clause: both transducers and the reporting discount, composed symbol by symbol."""
        insult = threat = 0
        factor, total = 1.0, 0.0
        for got in symbols:
            if got is None:
                continue
            s, x = got
            insult, a = INSULT_MOVES.get((insult, s), (insult, 0))
            threat, b = THREAT_MOVES.get((threat, s), (threat, 0))
            if s == REPORT:
                factor = REPORTED
            total += factor * (a + b) * x
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Matched clauses, their weight, the strongest, and weight by length, each damped."""
        low, read = text.lower() if text else "", self.read
        words = WORD.findall(low)
        if not any(got is not None and got[0] in HEADS for got in set(map(read.__getitem__, words))):
            return 0.0, 0.0, 0.0, 0.0
        n, total, most = 0, 0.0, 0.0
        for part in CLAUSE.split(low):
            symbols = list(map(read.__getitem__, WORD.findall(part)))
            if any(got is not None and got[0] in HEADS for got in symbols) and (x := self.clause(symbols)) > 0:
                n, total, most = n + 1, total + x, max(most, x)
        return math.log1p(n), math.log1p(total), most, math.log1p(100 * total / len(words))


class Symbols(dict):
    """What the grammar reads a word as, remembered; emptied when large."""

    def __init__(self, grammar: Grammar):
        super().__init__()
        self.grammar = grammar

    def __missing__(self, word: str):
        if len(self) > 300_000:
            self.clear()
        got = self.grammar.look_up(word)
        if len(word) <= 40:  # longer ones are read each time anew
            self[word] = got
        return got


def learn_words(rows: DataFrame, least_docs: int = 6, least_ratio: float = 20.0) -> dict[str, float]:
    """Words and stems (ending in *) far likelier in toxic training texts, with weights up to 1.5; rows: text, label.

    All words of all rows count, and all that are found stay; the rows' number (``max_rows`` of training_rows) bounds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                for w in words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}:
                    counts.setdefault(w, [0, 0])[y] += 1
            if len(counts) > 500_000:
                yield out(counts)
                counts = {}
        yield out(counts)

    def out(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["word", "toxic", "clean"])

    n = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not n.toxic or not n.clean:
        return {}
    counts = rows.select("text", F.col("label").cast("long")).mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / n.toxic) / ((F.col("clean") + 0.5) / n.clean)
    found = counts.where(F.col("toxic") >= least_docs).withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio)
    found = found.collect()
    stems = {r.word[:-1] for r in found if r.word.endswith("*")}
    # A longer stem or a word adds nothing to a stem that it begins with.
    covered = lambda w: any(w[:n] in stems for n in STEMS if n < len(w.rstrip("*")))
    return {r.word: min(1.5, math.log(r.ratio) / 4) for r in found if not covered(r.word)}


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method: weights of the features, then the intercept."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


#: Weights where nothing can be learned.
FIXED = np.array([0.0, 3.0, 1.5, 0.0, -3.5])


def fit(rows: DataFrame) -> tuple[dict[str, float], list[float]]:
    """(lexicon, calibration) from rows of text, label: words from two thirds, by a hash of the text, calibration from the rest."""
    part = F.pmod(F.xxhash64("text"), F.lit(3))
    lexicon = learn_words(rows.where(part > 0))
    found = featured(rows.where(part == 0), lexicon).groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if found["label"].nunique() < 2:
        return lexicon, FIXED.tolist()
    at = np.repeat(np.arange(len(found)), found.n)
    return lexicon, calibrate(found[list(FEATURES)].to_numpy()[at], found["label"].to_numpy()[at].astype(float)).tolist()


def featured(df: DataFrame, lexicon: dict[str, float], text: str = "text", keep_text: bool = False) -> DataFrame:
    """df, with its text if asked for, and the grammar's features; a map over rows."""
    keep = [c for c in df.columns if (c != text or keep_text) and c not in FEATURES]
    schema = df.select(keep).schema
    for name in FEATURES:
        schema = schema.add(name, "double")
    key = hash(frozenset(lexicon.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = held(("toxicity", key), lambda: Grammar(lexicon))
        for b in (x.slice(at, 500) for x in batches for at in range(0, x.num_rows, 500)):
            cols = list(zip(*map(grammar.features, b.column(len(keep)).to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, pa.float64()) for c in cols)], names=[*keep, *FEATURES])

    return df.select(*keep, F.col(text).cast("string").alias("_read")).mapInArrow(run, schema)


def score(df: DataFrame, lexicon: dict[str, float], weights: list[float], threshold: float = 0.7, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df, with its text if asked for, with score and predicted (1 where score >= threshold)."""
    out = featured(df.drop("score", "predicted"), lexicon, text, keep_text)
    z = F.lit(weights[-1])
    for name, w in zip(FEATURES, weights, strict=False):
        z = z + w * F.col(name)
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).drop(*FEATURES)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """text, label of about max_rows labelled documents, chosen by a hash, whose crc32 remainder by 3 is not 1.

    The bound makes the chosen labels small enough to broadcast, so no text is shuffled.
    """
    mine = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)").where(remainder("doc_id", 3) != 1)
    share = min(1.0, max_rows / max(1, mine.count()))
    mine = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).dropDuplicates()
    return written(docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").select("text", "label"), "labelled")
