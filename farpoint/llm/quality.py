"""Quality classifier from weak labels: agreeing heuristics teach a hashed linear scorer."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.arrow import map_texts, texts

GOOD, BAD, ABSTAIN = 1, 0, 2
# Rows that the scorer is fitted on, chosen by hash; label accuracies are estimated on all rows.
TRAIN_ROWS = 8_000
BUCKETS = 1 << 14
# Words by which shares are damped, so that a text of few words stays near the share of good texts.
DAMPING = 20
ROUNDS = 60
STEPS = 150
# Words that a task remembers, some hundred bytes each; it starts anew when they are full.
REMEMBERED = 300_000

SYMBOLS = b"#&$%*|<>{}[]\\^~=_+@"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
# Frequent function words of a few languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on was with be this are by from at as an or not"
    b" de la le les et en un une des du que qui pour dans par sur est au"
    b" der die das und ist von mit den ein eine zu im sich nicht auf"
    b" el los las por con para se y".split()
)


def _vote(value: float, good: float, bad: float) -> int:
    """GOOD on the good side of ``good``, BAD on the bad side of ``bad``, else abstain."""
    if good <= bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


def votes(raw: bytes) -> list[int]:
    """What each labeller says about a text; all abstain on texts of fewer than five words."""
    words = raw.split()
    n = len(words)
    if n < 5:
        return [ABSTAIN] * LABELLERS
    letters = len(raw) - len(raw.translate(None, LETTERS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    common = max(counts.values()) / n
    repeated = sum(map(eq, words, words[1:])) / n
    function = sum(counts[w] for w in FUNCTION_WORDS if w in counts) / n
    ends = sum(c for w, c in counts.items() if w[-1] in b".!?") / n
    bare = sum(c for w, c in counts.items() if len(w) <= 3 and not w.isalnum() and w.isascii()) / n
    return [
        _vote(symbols / n, 0.05, 0.3),
        _vote(upper / max(letters, 1), 0.15, 0.4),
        _vote(common, 0.12, 0.25) if n >= 20 else ABSTAIN,
        _vote(repeated, 0.03, 0.15),
        _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4) if len(lines) >= 4 else ABSTAIN,
        _vote(function, 0.12, 0.03) if n >= 20 else ABSTAIN,
        _vote(ends, 0.25, 0.5),
        _vote(bare, 0.06, 0.2),
        _vote(len(counts) / n, 0.3, 0.12) if n <= 2000 else ABSTAIN,
    ]


LABELLERS = 9


@dataclass(frozen=True)
class LabelModel:
    """Share of good rows, and per class, labeller and vote the chance of that vote."""

    prior: float
    chances: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """Chance that rows with these votes are good."""
        each = np.arange(table.shape[1])
        logs = [np.log(self.chances[c][each, table]).sum(axis=1) for c in (BAD, GOOD)]
        gap = np.log(self.prior) - np.log1p(-self.prior) + logs[GOOD] - logs[BAD]
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))


def estimate(table: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Accuracies of the labellers by expectation maximisation over vote patterns and their counts.

    Starts from the majority of the votes; without any votes all rows count as good.
    """
    good, bad = (table == GOOD).sum(axis=1), (table == BAD).sum(axis=1)
    share = (good + 1.0) / (good + bad + 1.5)
    model = LabelModel(0.5, np.full((2, table.shape[1], 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - share), counts * share])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        votes_of = np.stack([np.stack([(table == v).T @ w for v in range(3)], axis=1) for w in weight]) + 0.5
        model = LabelModel(float(prior), votes_of / votes_of.sum(axis=2, keepdims=True))
        share = model.posterior(table)
    return model


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Vote pattern of each row as a number with one base-3 place per labeller."""
    places = 3 ** np.arange(LABELLERS)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([votes(t) for t in texts(batch.column(0))], dtype=np.int64).reshape(-1, LABELLERS)
        return pa.RecordBatch.from_arrays([pa.array(found @ places)], names=["pattern"])

    return map_texts(docs.select(F.col(f"`{text}`")), work, "pattern bigint")


def _bucket(feature: bytes) -> int:
    return 3 + crc32(feature) % (BUCKETS - 3)


_SHAPES = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1")]


def _shape(word: bytes) -> bytes:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:8]


class WordBuckets(dict):
    """Buckets of a word: the word in lower case, and its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = (_bucket(b"w" + word.lower()), _bucket(b"s" + _shape(word)))
        return found


def features(raw: bytes, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a text: shares of words and shapes, of repeated neighbours and of words seen before."""
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    pairs = [(b, c) for w, c in counts.items() for b in buckets[w]]
    index = np.array([0, 1, 2, *(b for b, _ in pairs)], dtype=np.int32)
    shares = np.array([sum(map(eq, words, words[1:])), _seen(n, len(counts)), *(c for _, c in pairs)], dtype=np.float32)
    return index, np.concatenate([np.ones(1, dtype=np.float32), shares / (n + DAMPING)])


def _seen(words: int, distinct: int) -> float:
    """Words seen before beyond what a text of this length is likely to repeat."""
    return float(max(0, words - distinct - 0.7 * words))


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    """Logistic regression on posterior labels by full-batch gradient steps with momentum and scaling."""
    index = np.frombuffer(b"".join(pdf["index"]), dtype=np.int32)
    value = np.frombuffer(b"".join(pdf["value"]), dtype=np.float32)
    row = np.repeat(np.arange(len(pdf)), [len(x) // 4 for x in pdf["index"]])
    target = pdf["target"].to_numpy()
    w, m, v = (np.zeros(BUCKETS) for _ in range(3))
    # The first weight stands for the share of good texts and is not trained.
    share = (target.sum() + 1) / (len(target) + 2)
    w[0] = np.log(share / (1 - share))
    for step in range(1, STEPS + 1):
        margin = np.bincount(row, weights=w[index] * value, minlength=len(pdf))
        error = 1 / (1 + np.exp(-margin)) - target
        slope = np.bincount(index, weights=value * error[row], minlength=BUCKETS) / len(pdf) + 1e-5 * w
        slope[0] = 0
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return pd.DataFrame({"weights": [w.astype(np.float32).tobytes()]})


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, text: str = "text", id_column: str = "doc_id", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Label accuracies from all rows; the scorer from about ``train_rows`` rows chosen by hash.

    Only counts of vote patterns, whose number is fixed, and the weights come to the driver. No hand-made label
    is used. NULL text counts as empty. An empty table gives a scorer that calls every text good.
    """
    counted = vote_patterns(docs, text).groupBy("pattern").count().collect()
    patterns = np.array([r["pattern"] for r in counted], dtype=np.int64)
    counts = np.array([r["count"] for r in counted], dtype=np.float64)
    labels = estimate(patterns[:, None] // 3 ** np.arange(LABELLERS) % 3, counts)
    rows = int(counts.sum())
    cut = min(1 << 32, -(-(1 << 32) * train_rows // max(rows, 1)))
    chosen = docs.select(F.col(f"`{text}`").alias("_text"), F.pmod(F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text}`")), F.lit(1 << 32)).alias("_h"))
    # The limit only bounds the sample of tables whose rows repeat.
    chosen = chosen.where(F.col("_h") < cut).select("_text").limit(2 * train_rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, raws = WordBuckets(), texts(batch.column(0))
        found = [features(t, buckets) for t in raws]
        target = labels.posterior(np.array([votes(t) for t in raws], dtype=np.int64).reshape(-1, LABELLERS))
        columns = [pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(target)], names=["index", "value", "target"])

    hashed = map_texts(chosen, work, "index binary, value binary, target double")
    trained = hashed.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_train, "weights binary").collect()
    weights = np.frombuffer(trained[0]["weights"], dtype=np.float32).astype(np.float64) if trained else np.eye(1, BUCKETS)[0]
    return QualityModel(labels, weights)


def score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with ``name``: the scorer's chance that the text is good."""
    weights = model.weights

    class Weights(dict):
        def __missing__(self, word: bytes) -> float:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = found = weights[_bucket(b"w" + word.lower())] + weights[_bucket(b"s" + _shape(word))]
            return found

    kept = Weights()

    def margin(raw: bytes) -> float:
        words = raw.split()
        n = len(words)
        if not n:
            return float(weights[0])
        distinct = len(set(words))
        total = sum(map(kept.__getitem__, words))
        return float(weights[0] + (weights[1] * sum(map(eq, words, words[1:])) + weights[2] * _seen(n, distinct) + total) / (n + DAMPING))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        margins = np.array([margin(t) for t in texts(batch.column(0))], dtype=np.float64)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(margins, -50, 50))))], names=["_row", "_score"])

    held = docs.select(F.col(f"`{text}`").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    done = map_texts(held, work, f"_row {held.schema['_row'].dataType.simpleString()}, _score double")
    others = [c for c in docs.columns if c != name]
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in others], F.col("_score").alias(name))


def classify(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``quality`` and ``keep`` (quality at least ``threshold``), fitted on the same rows.

    NULL and empty texts and texts of few words give labellers nothing to say and are scored by the features they
    have, mostly by the prior, so they stay in a corpus that is mostly good. Repeated rows get equal scores. Columns called ``quality`` or ``keep`` are replaced;
    others pass through. An empty table gives an empty table.
    """
    scored = score(docs, fit(docs, text, id_column, train_rows), text)
    return scored.withColumn("keep", F.col("quality") >= F.lit(threshold))
