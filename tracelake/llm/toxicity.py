"""Toxicity by maximum-scoring segments of token log-odds.

*Training.* From a bounded sample of labelled rows (MAX_LABELLED, chosen by a hash; held-out rows never), toxic and other
documents are counted for each token. A token's log-odds of the two counts are those under a Dirichlet prior with PRIOR times the
token's count in both, plus FLOOR, drawn Z standard errors towards zero. Tokens of toxic texts score what is left of them; all others, and those
that the sample doesn't know, cost DRIFT, and tokens of clean texts what is left of theirs besides. Tokens of fewer than LEAST
documents of the sample are unknown.

*Segments.* The Ruzzo-Tompa scan, linear in the text, finds all maximal scoring segments. By extreme-value (Karlin-Altschul)
statistics a segment of score S in a clean text of n tokens has E = K n exp(-L S). L comes from the scores' frequencies in clean texts, K
from the clean texts themselves: the best segments of N of them have their greatest likelihood at K = N / sum(n exp(-L S)). Segments with
E <= SIGNIFICANT are significant.

*Scores.* The segments of a text are taken together by Karlin and Altschul's sum statistic: P(r) = exp(-T) T ** (r - 1) / (r! (r - 1)!) for the r best,
with T the sum of their L S - ln(K n), at a price of ln 2 for each segment after the first. A logistic curve over the least -ln P is
fitted to the sample's labels. It and K are fitted across folds: each half of the sample is measured by the tokens of the other, so that they
hold for new texts.

Defined cases: an empty or null text has no segment and so the lowest score. Labels that are null are ignored. Repeated label rows count
each; of documents with one doc_id the least text is the labelled one. Without labelled rows of both kinds, or where they don't tell
toxic texts apart (no token scores above zero, the mean score of clean texts isn't below it, or the curve doesn't rise), every score is
0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, held_out, table
from ._common import share as broadcast_value
from .decontaminate import words_of

MAX_LABELLED = 20_000
PRIOR, FLOOR, Z, LEAST = 0.1, 0.5, 2.0, 3
DRIFT, SIGNIFICANT, THRESHOLD = -0.5, 0.01, 0.7
LN2 = math.log(2)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), by the scan of Ruzzo and Tompa over runs of equal sign."""
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    turn = np.concatenate([[0], np.flatnonzero(positive[1:] != positive[:-1]) + 1])
    sums, ends = np.add.reduceat(scores, turn).tolist(), np.append(turn[1:], len(scores)).tolist()
    found: list[list] = []  # left cumulative sum, right cumulative sum, start, end
    total = 0.0
    for x, s, e in zip(sums, turn.tolist(), ends):
        if x <= 0:
            total += x
            continue
        new = [total, total + x, s, e]
        total += x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new[0], new[2] = found[j][0], found[j][2]
            del found[j:]
    return [(r - l, s, e) for l, r, s, e in found]


class Model:
    def __init__(self, scores: dict[bytes, float], rate: float):
        self.scores, self.rate, self.scale, self.slope, self.offset = scores, rate, 0.1, 1.0, 0.0

    def segments(self, text: str | None) -> tuple[list[tuple[float, int, int]], int]:
        """The maximal scoring segments (L S, first word, end), and the number of words, 1 at least."""
        words, get = words_of(text), self.scores.get
        found = segments(np.fromiter((get(w, DRIFT) for w in words), np.float64, len(words)))
        return [(self.rate * x, s, e) for x, s, e in found], max(1, len(words))

    def evidence(self, found: list[tuple[float, int, int]], n: int) -> float:
        """The least -ln P of the r best segments; ln(1 / E) of none, held above -10, without any."""
        space = math.log(self.scale * n)
        best, total = max(-space, -10.0), 0.0
        for r, x in enumerate(sorted((x - space for x, _, _ in found), reverse=True), 1):
            if r > 1 and x <= 0:
                break
            total += x
            p = total if r == 1 else total - (r - 1) * (math.log(max(total, 1e-9)) + LN2) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, p)
        return best

    def measured(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The evidence, and the significant segments (first word, end, E)."""
        found, n = self.segments(text)
        space = math.log(self.scale * n)
        return self.evidence(found, n), [(s, e, math.exp(space - x)) for x, s, e in found if space - x <= math.log(SIGNIFICANT)]

    def score(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * x + self.offset))))


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """L > 0 with sum of shares * exp(L * scores) = 1."""
    low, high = 1e-6, 1.0
    total = lambda x: float(np.sum(shares * np.exp(np.minimum(600, x * scores)))) - 1
    while total(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge; both kinds weigh the same in full."""
    a, b = 0.1, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([np.sum((y - p) * x) - 1e-3 * a, np.sum(y - p)])
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -5, 5))
    return a, b


def _token_counts(batches):
    for b in batches:
        rows = list(zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("fold").to_pylist()))
        for toxic, fold in ((0, 0), (0, 1), (1, 0), (1, 1)):
            texts = [t for t, y, f in rows if (y, f) == (toxic, fold)]
            n, d = Counter(), Counter()
            for t in texts:
                words = words_of(t)
                n.update(words)
                d.update(set(words))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array([toxic] * len(n), pa.int32()), pa.array([fold] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64()), pa.array([d[w] for w in n], pa.int64())], ["token", "y", "fold", "n", "d"])


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled rows that aren't held out, chosen by a hash.

    Of documents with one doc_id the least text counts, so that repeated rows add nothing.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("_id"), F.col(target).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(known.select("_id").distinct()), F.col("doc_id") == F.col("_id"), "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")


def fit(tokens: DataFrame, folds: tuple[int, ...]) -> Model | None:
    """A model, not yet calibrated, from the tokens (token, y, fold, n, d) of the given folds."""
    tokens = tokens.filter(F.col("fold").isin(*folds)).groupBy("token").agg(*(F.sum(F.when(F.col("y") == y, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("n", "d") for y in (0, 1)))
    all0, docs0, docs1 = tokens.agg(F.sum("n0"), F.sum("d0"), F.sum("d1")).first()
    if not docs0 or not docs1:
        return None
    share = PRIOR * (F.col("d0") + F.col("d1")) + FLOOR
    whole = PRIOR * (docs0 + docs1) + FLOOR
    odds = lambda n, total: F.log((F.col(n) + share) / (F.lit(total) + whole - F.col(n) - share))
    raw = odds("d1", docs1) - odds("d0", docs0)
    sure = F.greatest(F.lit(0.0), F.abs(raw) - Z * F.sqrt(1 / (F.col("d1") + share) + 1 / (F.col("d0") + share)))
    kept = tokens.filter(F.col("d0") + F.col("d1") >= LEAST).withColumn("score", F.when(raw > 0, sure).otherwise(DRIFT - sure)).filter(sure > 0)
    rows = kept.select("token", "score", "n0").collect()
    scores = {bytes(r.token): float(r.score) for r in rows}
    values = np.array([DRIFT, *scores.values()])
    seen = np.array([max(0, all0 - sum(r.n0 for r in rows)), *(r.n0 for r in rows)]) + FLOOR
    seen /= seen.sum()
    if values.max() <= 0 or float(np.sum(values * seen)) >= 0:
        return None
    return Model(scores, _rate(values, seen))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    sample = labelled(docs, labels, "toxic", limit).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    sample = cut(sample)
    tokens = cut(sample.mapInArrow(_token_counts, "token binary, y int, fold int, n long, d long").groupBy("token", "y", "fold").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    model = fit(tokens, (0, 1))
    if model is None:
        return None
    halves = [fit(tokens, (1,)), fit(tokens, (0,))]
    measures = halves if all(halves) else [model, model]  # a half of one kind only measures nothing

    def measure(batches):
        span = pa.list_(pa.float64())
        for b in batches:
            found = [measures[f].segments(t) for t, f in zip(b.column("text").to_pylist(), b.column("fold").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([[x for x, _, _ in s] for s, _ in found], span), pa.array([n for _, n in found], pa.int64()), b.column("y")], ["x", "n", "y"])

    points = sample.mapInArrow(measure, "x array<double>, n long, y int").collect()
    calibrate(model, [(list(r.x), r.n) for r in points], np.array([r.y for r in points], np.float64))
    return model if model.slope > 0 else None


def calibrate(model: Model, texts: list[tuple[list[float], int]], toxic: np.ndarray) -> None:
    """K from the clean texts' best segments, then the curve."""
    clean = [n * math.exp(-max(x, default=0.0)) for (x, n), y in zip(texts, toxic) if not y]
    model.scale = min(1.0, len(clean) / max(sum(clean), 1e-9)) if clean else model.scale
    model.slope, model.offset = _logistic(np.array([model.evidence([(v, 0, 0) for v in x], n) for x, n in texts]), toxic)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score, spans): spans are the significant segments (start, end, e) in words."""
    shared = broadcast_value(docs.sparkSession, model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e", pa.float64())]))

    def run(batches):
        m = shared()
        for b in batches:
            found = [m.measured(t) if m else (0.0, []) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([m.score(x) if m else 0.0 for x, _ in found], pa.float64()), pa.array([[{"start": s, "end": e, "e": p} for s, e, p in spans] for _, spans in found], span)], ["doc_id", "score", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,e:double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
