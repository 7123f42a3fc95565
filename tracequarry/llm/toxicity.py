"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Words and their beginnings get log-odds of toxic against clean labelled texts under an
informative Dirichlet prior; only those that differ clearly are kept. In a text, a token
scores the log-odds of its word, or else of the word's longest kept beginning, which
meets inflected forms; every other token scores a small loss. A linear-time scan finds
all maximal segments. A segment's expected number in clean text of that length follows from
Karlin-Altschul statistics; the most surprising segment and the count of significant
ones give the score by a logistic curve fitted on the labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize

#: At most about so many labelled texts of each class are learnt from, chosen by a hash of the key.
MOST_LABELLED = 6_000
CLEAR = 3.0  # standard deviations
PRIOR = 0.1  # pseudo-counts, as a share of a token's count, dealt to the classes by their size
SIGNIFICANT = 0.05
LOSS = -0.1
STEMS = range(8, 3, -1)  # letters of a word's beginning, which is written with a * after it
REPEATS = 4  # a token counts so often in a text at most
MEMORY = 100_000  # words whose score a task remembers
FOLDS, LEFT_OUT = 3, 1

letters = re.compile(r"[^\W\d_]+").findall


def words(text: str | None) -> list[str]:
    return letters(text.lower()) if isinstance(text, str) else []


def forms(word: str) -> list[str]:
    """The word and its beginnings, longest first."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


def maximal_segments(scores: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """(first token, last token, score) of every maximal scoring segment, in text order.

    ``scores`` are (position, score) of the tokens that don't score ``loss``, by
    position. A segment is maximal if no part of it that it could drop or neighbour
    that it could take in would raise its score. Each token is looked at once; a
    candidate's search for the next smaller left sum follows links, so the whole is
    linear in the number of scored tokens.
    """
    found: list[list[float]] = []  # start, end, sum left of it, sum at its end, candidate before with a smaller left sum
    total, before = 0.0, -1
    for at, score in scores:
        total += loss * (at - before - 1)
        before = at
        if score <= 0:
            total += score
            continue
        start, left, right = at, total, total + score
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= right:
                found.append([start, at, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(int(s), int(e), right - left) for s, e, left, right, _ in found]


def karlin_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1; 1 if there is none."""
    if not len(scores) or scores.max() <= 0 or (scores * share).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    total = lambda x: float((share * np.exp(np.minimum(x * scores, 500))).sum())
    while total(high) < 1.0 and high < 1e6:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1.0 else (low, middle)
    return high


@dataclass(frozen=True)
class Toxicity:
    """The fitted model: token log-odds, extreme-value parameters, logistic weights."""

    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] = (-50.0, 0.0, 0.0)
    seen: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def token_score(self, word: str) -> float:
        """The word's log-odds, or 0 if neither it nor a beginning has been kept."""
        score = self.seen.get(word)
        if score is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            score = self.seen[word] = next((self.odds[f] for f in forms(word) if f in self.odds), 0.0)
        return score

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Maximal segments as (first token, last token, score, expected number), and how many tokens there are."""
        tokens = words(text)
        known, score = self.seen.get, self.token_score
        hits = []
        for k, w in enumerate(tokens):
            x = known(w)
            x = score(w) if x is None else x
            if x:
                hits.append((k, x))
        n = len(tokens)
        return [(s, e, x, self.scale * n * math.exp(-self.rate * x)) for s, e, x in maximal_segments(hits)], n

    def judged(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """(score, significant passages) of a text, by one scan."""
        found = self.passages(text)[0]
        significant = [p for p in found if p[3] < SIGNIFICANT]
        a, b, c = self.weights
        x, y = features(min((p[3] for p in found), default=None), len(significant))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y)))), significant


def features(least: float | None, significant: int) -> tuple[float, float]:
    """Of the most surprising segment, -log10 of the chance that clean text holds one like it; log(1 + the number of significant ones)."""
    if least is None:
        return 0.0, 0.0
    return min(30.0, -math.log10(max(-math.expm1(-least), 1e-30))), math.log1p(significant)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic curve, the constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    pull = np.diag([0.0, *[ridge * len(x) / 100] * (x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(``id``, ``text``, ``y``) of at most about ``most`` labelled texts of each class, outside the left-out fold."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    known = known.where(fold(F.col("id")) != LEFT_OUT)
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("id", F.lit("label")), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (chance < min(1.0, most / n)))
    known = materialize(known.where(keep))  # about 2 * most rows, a few bytes each
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> Toxicity:
    """Fit on a bounded sample of labelled texts (``labelled``). Without both classes nothing is toxic."""
    sample = materialize(labelled(docs, labels, key, text, label, most))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, t in zip(batch["y"], batch["text"]):
                tokens = words(t)
                marks = sorted({xxhash.xxh3_64_intdigest(" ".join(tokens[k : k + 5])) >> 1 for k in range(max(1, len(tokens) - 4))})[:2]
                out.append((y, marks[0], marks[-1], tokens))
            yield pd.DataFrame(out, columns=["y", "m0", "m1", "tokens"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, list[float]] = {}
            for y, w, tokens in zip(batch["y"], batch["w"], batch["tokens"]):
                own = Counter(f for word in tokens for f in forms(word))
                for f, n in own.items():
                    sums.setdefault(f, [0.0, 0.0])[y] += w * min(n, REPEATS)
            yield pd.DataFrame([(f, t, c) for f, (c, t) in sums.items()], columns=["token", "t", "c"])

    # near copies share their smallest marks; together they count as one text
    texts = materialize(sample.mapInPandas(read, "y int, m0 bigint, m1 bigint, tokens array<string>"))
    for m in ("m0", "m1"):
        texts = texts.join(F.broadcast(texts.groupBy(m).agg(F.count("*").alias(f"n_{m}"))), m)  # as many rows as the sample at most
    texts = texts.select("y", "tokens", (F.lit(1.0) / F.greatest("n_m0", "n_m1")).alias("w"))
    counts = texts.mapInPandas(count, "token string, t double, c double").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = materialize(counts)
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    if not sums[0] or not sums[1]:
        return Toxicity()
    n_t, n_c = sums
    share_t = n_t / (n_t + n_c)
    prior = F.lit(PRIOR) * (F.col("t") + F.col("c"))
    t, c = F.col("t") + prior * share_t, F.col("c") + prior * (1 - share_t)
    delta = F.log(t / (F.lit(n_t + PRIOR * (n_t + n_c) * share_t) - t)) - F.log(c / (F.lit(n_c + PRIOR * (n_t + n_c) * (1 - share_t)) - c))
    scored = counts.select("token", "t", "c", delta.alias("d"), (delta / F.sqrt(F.lit(1.0) / t + F.lit(1.0) / c)).alias("z"))
    clear = scored.where(F.abs("z") >= CLEAR).select("token", "d").collect()  # of the bounded sample's tokens those that differ clearly
    odds = {r["token"]: r["d"] for r in clear}

    # extreme values: the scores of clean text, and its best segments
    plain = Toxicity(odds)

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = Counter(plain.token_score(w) or LOSS for t in batch["text"] for w in words(t))
            yield pd.DataFrame(list(own.items()), columns=["score", "n"])

    shares = sample.where("y = 0").select("text").mapInPandas(histogram, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toPandas()
    total = max(1, int(shares["n"].sum()))  # at most one row for each kept token
    rate = karlin_lambda(shares["score"].to_numpy(float), shares["n"].to_numpy(float) / total)
    raw = Toxicity(odds, rate, 1.0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, t in zip(batch["y"], batch["text"]):
                found, n = raw.passages(t)
                expected = [e for *_, e in found]
                out.append((y, min(expected, default=float(n)), expected))
            yield pd.DataFrame(out, columns=["y", "least", "expected"])

    seen = materialize(sample.select("y", "text").mapInPandas(measure, "y int, least double, expected array<double>"))
    clean = seen.where("y = 0").select("least").toPandas()["least"]  # at most about `most` rows
    # scale * least is exponential with mean 1 in clean text; the median is not moved by a few toxic ones among them
    scale = math.log(2) / max(float(np.median(clean)), 1e-12)
    found = F.size(F.filter("expected", lambda e: e * F.lit(scale) < SIGNIFICANT))
    seen = seen.select("y", F.when(F.size("expected") > 0, F.col("least") * F.lit(scale)).alias("least"), found.alias("found")).toPandas()  # the bounded sample
    x = [features(None if math.isnan(least) else least, found) for least, found in zip(seen["least"], seen["found"])]
    weights = fit_logistic(np.array(x), seen["y"].to_numpy(float))
    return Toxicity(odds, rate, scale, tuple(float(w) for w in weights))


def score_toxicity(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text", limit: float = 0.7, prefix: str = "") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages``, their names after ``prefix``; columns of these names are replaced.

    ``passages`` are the significant segments as (first token, last token, score,
    expected number), tokens being runs of letters. Null and empty texts have no
    segments and the score of one without any; very long ones are scanned whole, once.
    Repeated rows and null keys score like any other; an empty table gives no rows.
    """
    names = [f"{prefix}{c}" for c in ("score", "predicted", "passages")]
    kinds = f"`{names[0]}` double, `{names[1]}` int, `{names[2]}` array<struct<first: bigint, last: bigint, score: double, expected: double>>"
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    full = StructType(base.schema.fields + StructType.fromDDL(kinds).fields)
    at = base.columns.index(text)
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [model.judged(t) for t in batch.column(at).to_pylist()]
            scores = pa.array([s for s, _ in judged], pa.float64())
            predicted = pa.array([int(s >= limit) for s, _ in judged], pa.int32())
            passages = pa.array([[dict(zip(("first", "last", "score", "expected"), p)) for p in found] for _, found in judged], pa.list_(passage))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, predicted, passages], names=full.names)

    return base.mapInArrow(run, full)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: float = 0.7) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``score``, ``predicted``, ``passages``, after fitting on ``labels``.

    Labels other than 0 and 1 and those without a key are left out; of several for one
    key the highest counts. Without labels of both classes nothing is toxic. Null and
    empty texts score like texts without segments; a null key is in fold crc32('') mod 3.
    Repeated rows give repeated results, an empty table none; other columns aren't
    looked at, whatever their names.
    """
    model = train(docs, labels, key, text, label)
    scored = score_toxicity(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), model, "id", "text", limit)
    return scored.select(F.col("id").alias(key), (fold(F.col("id")) == LEFT_OUT).alias("held_out"), "score", "predicted", "passages")
