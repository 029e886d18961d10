"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words (lower-cased), the shapes of its words (letters as a or A, digits as 0, runs as one, other characters as they
are) and three counts of what repeats: words equal to the word before, lines equal to the line before, and words missing from the
n ** 0.8 / 2 different ones that a text of n words has at least (words of invented and of natural prose grow faster). Terms are hashed
into BUCKETS buckets and weigh the square root of their share times the inverse document frequency.

A truncated singular value decomposition of at most MAX_LABELLED labelled texts (chosen by a hash; held-out rows never) gives DIMENSIONS
latent dimensions, in one task; the driver only gets the result. The labelled vectors, at most MAX_LABELLED x DIMENSIONS float32, and
the projection, BUCKETS x DIMENSIONS, are broadcast. Every document's exact cosines with all of them are computed in blocks, and the
NEIGHBOURS nearest vote with their labels, each with its cosine as weight. Buckets of fewer than LEAST labelled texts weigh nothing.

Defined cases: null and empty texts have no terms, a zero vector and so the share of good labels as score; so has everything if no
labels are known (0.5). Null labels are ignored. Repeated label rows count each; of documents with one doc_id the least text is the
labelled one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, held_out, share, table
from .toxicity import labelled

MAX_LABELLED, BUCKETS, DIMENSIONS, NEIGHBOURS, LEAST, THRESHOLD = 6_000, 65_536, 32, 25, 3, 0.5
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
RUNS = re.compile(rb"([aA0])\1+")
CHUNK = 50_000


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's terms, sorted, and the square roots of their shares."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, counts, h = len(words), Counter(), xxhash.xxh3_64_intdigest
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    for kind, found in ((0, RUNS.sub(rb"\1", data.translate(SHAPE)).split()), (1, data.translate(LOWER).split())):
        for t, c in Counter(found).items():
            counts[h(t, kind) % BUCKETS] += c
    lines = data.split(b"\n")
    repeats = sum(map(eq, words, words[1:])), sum(len(a.split()) for a, b in zip(lines, lines[1:]) if a == b), max(0, int(n ** 0.8) // 2 - len(set(words)))
    for k, c in enumerate(repeats):
        counts[h(b"repeats", k) % BUCKETS] += c
    at = np.fromiter(counts, np.int32, len(counts))
    weight = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)) / np.float32(n))
    order = np.argsort(at)
    return at[order], weight[order]


def _product(keys: np.ndarray, others: np.ndarray, values: np.ndarray, y: np.ndarray, rows: int) -> np.ndarray:
    """The sums of values * y[others] by keys, which are sorted."""
    out = np.zeros((rows, y.shape[1]), np.float32)
    for i in range(0, len(keys), CHUNK):
        k = keys[i : i + CHUNK]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[starts]] += np.add.reduceat(values[i : i + CHUNK, None] * y[others[i : i + CHUNK]], starts)
    return out


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]]):
        self.prior = (sum(y for *_, y in rows) / len(rows)) if rows else 0.5
        self.labels = np.array([y for *_, y in rows], np.float32)
        at = np.concatenate([np.empty(0, np.int32), *(t for t, _, _ in rows)])
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _, _ in rows])
        seen = np.bincount(at, minlength=BUCKETS)
        self.idf = np.where(seen >= LEAST, 1 + np.log(max(1, len(rows)) / np.maximum(seen, 1)), 0).astype(np.float32)
        weight = np.concatenate([np.empty(0, np.float32), *(w for _, w, _ in rows)]) * self.idf[at]
        norm = np.sqrt(np.bincount(doc, weight * weight, minlength=len(rows))).astype(np.float32)
        weight /= np.maximum(norm, 1e-12)[doc]
        by_term = np.argsort(at, kind="stable")
        times = lambda y: _product(doc, at, weight, y, len(rows))
        back = lambda y: _product(at[by_term], doc[by_term], weight[by_term], y, BUCKETS)
        k = min(DIMENSIONS, len(rows), int((seen >= LEAST).sum()))
        self.projection = None
        if not k:
            return
        basis = np.random.default_rng(0).standard_normal((BUCKETS, min(k + 16, len(rows)))).astype(np.float32)
        for _ in range(4):  # subspace iteration
            basis, _ = np.linalg.qr(back(times(basis)))
        _, _, v = np.linalg.svd(times(basis), full_matrices=False)
        self.projection = np.ascontiguousarray((basis @ v.T)[:, :k], np.float32)
        self.vectors = _unit(times(self.projection))

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.projection is None:
            return np.full(len(texts), self.prior)
        latent = np.stack([(w * self.idf[t]) @ self.projection[t] for t, w in texts])
        near = _unit(latent) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, at, axis=1), 0).astype(np.float64)
        total = weight.sum(1)
        return np.clip(np.where(total > 1e-9, (weight * self.labels[at]).sum(1) / np.maximum(total, 1e-9), self.prior), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """The model of at most limit labelled texts, made by one task: the decomposition takes some 200 MB that a driver may not have."""

    def run(batches):
        for b in batches:
            found = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["doc_id", "y", "t", "w"])

    def fit(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
        model = Model([(np.frombuffer(t, np.int32), np.frombuffer(w, np.float32), y) for _, y, t, w in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["model"])

    sample = labelled(docs, labels, "quality", limit).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    found = sample.mapInArrow(run, "doc_id long, y int, t binary, w binary").repartition(1).mapInArrow(fit, "model binary").collect()
    model = Model([])
    if found:
        vars(model).update(pickle.loads(found[0].model))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score)."""
    get = share(docs.sparkSession, model)

    def run(batches):
        m = get()
        for b in batches:
            found = [terms(t) for t in b.column("text").to_pylist()]
            scores = [m.scores(found[i : i + 256]) for i in range(0, len(found), 256)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; one pass, no shuffle."""
    get, schema = share(docs.sparkSession, model), docs.schema

    def run(batches):
        m = get()
        for b in batches:
            found = [terms(t) for t in b.column("text").to_pylist()]
            good = [m.scores(found[i : i + 256]) >= threshold for i in range(0, len(found), 256)]
            yield b.filter(pa.array(np.concatenate(good) if good else [], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
