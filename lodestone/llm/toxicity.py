"""Toxic passages by maximum-scoring segments over token log-odds.

A token (a lower-cased word, and the first letters of a longer one) has the log-odds of
occurring in toxic against other documents, under a Dirichlet prior in proportion to
its overall frequency. A linear scan over a text's token scores (Ruzzo and Tompa's
all-maximal-segments scan) finds every maximal segment. Under no toxicity the best
segment's score grows with the logarithm of the length and follows a Gumbel law; its
tail gives each segment a significance, and a logistic fit on rows that the log-odds
did not see turns the best significance, the number of significant passages and
their total into a probability.

Models are learnt from a bounded sample of labelled rows (``most_labelled`` a class, those with
the least hash of the id; the fit's intercept is put back to the classes' shares among all
usable labels), so what is sent to the executors is bounded by the tokens of that sample, whatever
the corpus's size; every document is scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import slices
from lodestone.llm.common import materialise

TOKEN = re.compile(r"[^\W_]+")
#: Words longer than this also count by their first so many letters.
STEM = 6
#: Taken from each token's score, so that a text of neutral tokens has a falling sum.
DRIFT = 0.75
#: Scores are held within these bounds.
LOW, HIGH = -1.5, 6.0
#: A passage is significant if chance gives a better one in fewer than this share of clean texts.
SIGNIFICANT = 0.01


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    slope: float = 0.0  # of the Gumbel law's location in ln(tokens)
    location: float = 0.0
    scale: float = 1.0
    weights: list[float] = field(default_factory=lambda: [-12.0, 0.0, 0.0, 0.0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Scorer:
    """Token scores with a bounded cache, and the scan."""

    def __init__(self, model: Model, cached: int = 300_000):
        self.model, self.cached, self.known = model, cached, {}

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        known, scores = self.known, self.model.scores
        if len(known) > self.cached:
            known.clear()
        for t in set(tokens).difference(known):
            own, stem = scores.get(t), scores.get("^" + t[:STEM]) if len(t) > STEM else None
            best = max(own, stem) if own is not None and stem is not None else own if own is not None else stem
            known[t] = min(HIGH, max(LOW, (best or 0.0) - DRIFT))
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.float64, count=len(tokens))

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal segments (first token, end, score), and the number of tokens."""
        tokens = TOKEN.findall(text.lower())
        if not tokens:
            return [], 0
        return maximal_segments(self.token_scores(tokens)), len(tokens)

    def tail(self, score: float, n: int) -> float:
        """Minus the logarithm of the chance that a clean text of n tokens has a segment of this score."""
        z = (score - self.model.location - self.model.slope * math.log(max(n, 1))) / self.model.scale
        rate = math.exp(min(700.0, -z))
        return -math.log(-math.expm1(-rate)) if rate > 1e-12 else z

    def features(self, text: str) -> tuple[list[tuple[int, int, float]], list[float]]:
        """Significant passages, and the inputs of the logistic fit."""
        found, n = self.passages(text)
        tails = [(self.tail(s, n), a, b, s) for a, b, s in found]
        clear = [t for t in tails if t[0] > -math.log(SIGNIFICANT)]
        best = max((t[0] for t in tails), default=0.0)
        return [(a, b, s) for _, a, b, s in clear], [1.0, min(best, 40.0), math.log1p(len(clear)), math.log1p(sum(t[0] for t in clear))]

    def probability(self, x: list[float]) -> float:
        z = sum(w * v for w, v in zip(self.model.weights, x))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's maximal segments; only positive scores start work, so mostly neutral texts cost little."""
    cum = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # first, end, sum before it, sum at its end
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, low, high = i, i + 1, cum[i], cum[i + 1]
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= high:
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append([first, end, low, high])
    return [(a, b, float(h - l)) for a, b, l, h in stack]


def fit_gumbel(scores: np.ndarray, lengths: np.ndarray) -> tuple[float, float, float]:
    """Slope in ln(length), location and scale of best scores of clean texts, by moments."""
    if len(scores) < 8:
        return 0.0, 1.0, 1.0
    x = np.log(np.maximum(lengths, 1))
    slope = max(0.0, float(np.cov(x, scores)[0, 1] / max(x.var(), 1e-9)))
    rest = scores - slope * x
    cut = np.quantile(rest, 0.98)  # mislabelled rows must not widen the law
    rest = np.minimum(rest, cut)
    scale = max(0.25, float(rest.std() * math.sqrt(6) / math.pi))
    return slope, float(rest.mean() - 0.5772156649 * scale), scale


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000, prior: float = 200.0) -> Model:
    """Model from the labelled rows outside the holdout; two thirds give the log-odds, one third the calibration."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    mix = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    chosen = one.filter("toxic = 1").orderBy(mix).limit(most_labelled).unionByName(one.filter("toxic = 0").orderBy(mix).limit(most_labelled))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = materialise(
        texts.join(F.broadcast(chosen), "doc_id")  # 2 * most_labelled rows at most
        .groupBy("text")  # copies of a text count once
        .agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
        .select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) < 2).alias("learns")),
        "toxic-sample",
    )

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = set(TOKEN.findall(text.lower()))
                own |= {"^" + t[:STEM] for t in own if len(t) > STEM}
                out[0].extend(own)
                out[1].extend([toxic] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["token", "toxic"])

    learners = sample.filter("learns").withColumn("toxic", F.col("toxic").cast("int"))
    n = {r["toxic"]: r["count"] for r in learners.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    counts = learners.select("text", "toxic").mapInArrow(tokens, "token string, toxic int").groupBy("token").agg(
        F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0")
    )
    a = (F.col("y1") + F.col("y0")) * prior / (n[0] + n[1])
    up, base = F.col("y1") + a * n[1] / (n[0] + n[1]) + 0.01, F.col("y0") + a * n[0] / (n[0] + n[1]) + 0.01
    total1, total0 = n[1] + prior * n[1] / (n[0] + n[1]), n[0] + prior * n[0] / (n[0] + n[1])
    odds = F.log(up / F.greatest(total1 - up, F.lit(0.5))) - F.log(base / F.greatest(total0 - base, F.lit(0.5)))
    z = odds / F.sqrt(1 / up + 1 / base)
    strong = counts.filter("y1 + y0 >= 3").select("token", odds.alias("odds"), z.alias("z")).filter("abs(z) > 2")  # of the sample's tokens
    model = Model({r["token"]: r["odds"] for r in strong.collect()})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = [scorer.passages(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([[float(s) for _, _, s in f] for f, _ in got], pa.list_(pa.float64())),
                    pa.array([m for _, m in got], pa.int64()),
                    batch.column("toxic").cast(pa.int32()),
                ],
                names=["scores", "n", "toxic"],
            )

    seen = sample.filter("NOT learns").select("text", "toxic").mapInArrow(best, "scores array<double>, n bigint, toxic int").collect()  # bounded by the sample
    clean = [r for r in seen if not r["toxic"]]
    model.slope, model.location, model.scale = fit_gumbel(
        np.array([max(r["scores"], default=0.0) for r in clean]), np.array([r["n"] for r in clean])
    )
    scorer, rows = Scorer(model), []
    for r in seen:
        tails = [scorer.tail(s, r["n"]) for s in r["scores"]]
        clear = [t for t in tails if t > -math.log(SIGNIFICANT)]
        rows.append([1.0, min(max(tails, default=0.0), 40.0), math.log1p(len(clear)), math.log1p(sum(clear))])
    if rows:
        model.weights = fit_logistic(np.array(rows), np.array([r["toxic"] for r in seen], dtype=float))
        # The cap changes the classes' shares; the intercept goes back to those of all usable labels, so a score means the same at every size.
        taken = {c: min(k, most_labelled) for c, k in total.items()}
        model.weights[0] += math.log(total[1] / total[0]) - math.log(taken[1] / taken[0])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **learning) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, passages (token ranges with scores).

    Null and empty texts have no passages and get the score of such; without labels of
    both classes every score is near 0. Null ids count as not held out and are never
    learnt from; repeated rows are scored each; other columns are ignored.
    """
    model = learn(docs, labels, **learning)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            got = [scorer.features(t or "") for t in batch.column("text").to_pylist()]
            passages = pa.array(
                [[{"first": a, "end": b, "score": s} for a, b, s in p] for p, _ in got],
                pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])),
            )
            score = pa.array([scorer.probability(x) for _, x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), score, passages], names=["doc_id", "score", "passages"])

    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, score double, passages array<struct<first: int, end: int, score: double>>"
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages"
    )
