"""Quality scores by compression with dictionaries of good and bad text.

One zstandard dictionary is trained on texts labelled good, one on texts labelled bad. A text that
compresses better with the first is likelier to be good. The difference of the two compressed sizes over
their sum, with the compression ratio and the length as context (a text of one repeated word compresses
alike under both), goes through a logistic curve fitted on labelled texts that trained no dictionary.

Only the fit uses a sample, of bounded size; every whole text is scored, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from prefrank.llm.common import tidy


@dataclass
class QualityModel:
    """Two dictionaries and a calibration. Without both classes only `base` is used, for every text."""

    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    base: float = 0.5
    piece: int = 65536
    mean: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))
    weights: np.ndarray | None = None

    def sizes(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return tuple(zstandard.ZstdCompressor(level=self.level, dict_data=prepared(d, self.level), write_content_size=False) for d in (self.good, self.bad))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each whole text. One longer than those of the fit is compressed in equal pieces, whose sizes add up."""
        good, bad = self.sizes()
        rows = []
        for t in texts:
            k = max(1, -(-len(t) // self.piece))
            step = -(-len(t) // k) or 1
            parts = [t[i:i + step] for i in range(0, len(t), step)] if k > 1 else [t]
            rows.append((sum(len(good.compress(x)) for x in parts), sum(len(bad.compress(x)) for x in parts), len(t), k))
        g, b, n, k = np.array(rows, dtype="float64").reshape(-1, 4).T
        return np.column_stack([(b - g) / (b + g), np.log((g + b + k) / (n + 16 * k)), np.log(n / k + 16)])

    def terms(self, features: np.ndarray) -> np.ndarray:
        """The difference, its context, and their squares and products, standardised and within 6 deviations."""
        z = np.clip((features - self.mean) / self.scale, -6, 6)
        d, r, n = z.T
        return np.column_stack([np.ones(len(z)), z, z**2, d * r, d * n, r * n])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(self.terms(self.features(texts)) @ self.weights, -30, 30)))


def prepared(content: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=level)
    return d


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights of a ridge logistic regression. A Newton step is halved until it lowers the loss, so that

    classes which separate cannot drive the weights apart: the loss is convex and falls at every step.
    """
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * v @ v)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-12:
            size /= 2
        if now - new <= 1e-12 * max(1.0, abs(now)):
            break
        w, now = w + size * step, new
    return w


def fit(good: list[bytes], bad: list[bytes], dictionary_texts: int, dictionary_bytes: int, level: int, piece: int = 65536) -> QualityModel:
    """Fit on texts of both classes; half of each, at most `dictionary_texts`, goes to its dictionary."""
    model = QualityModel(level=level, piece=piece, base=(len(good) + 1) / (len(good) + len(bad) + 2))
    if min(len(good), len(bad)) < 2:
        return model
    cut = [min(dictionary_texts, len(x) // 2) for x in (good, bad)]
    model.good, model.bad = (dictionary(x[:n], dictionary_bytes) for x, n in zip((good, bad), cut))
    texts = good[cut[0]:] + bad[cut[1]:]
    y = np.array([1.0] * (len(good) - cut[0]) + [0.0] * (len(bad) - cut[1]))
    features = model.features(texts)
    model.mean, model.scale = features.mean(0), np.where(features.std(0) > 1e-9, features.std(0), 1.0)
    model.weights = logistic(model.terms(features), y)
    return model


def held_out(doc_id: F.Column | str = "doc_id") -> F.Column:
    """A quarter of the documents, by crc32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 65536, dictionary_texts: int = 500, dictionary_bytes: int = 32768, level: int = 3) -> QualityModel:
    """Fit on a bounded sample of labelled documents that are not held out.

    At most `per_class` labelled ids of each class are taken, in order of a hash of the id, and of their
    documents those of at most `longest` bytes: so the driver receives 2 * per_class * longest bytes at
    most. Ids with labels of both classes, null labels, null ids and null texts are left out.
    """
    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__most")).where(F.col("quality") == F.col("__most")))
    wanted = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "quality") for q in (1, 0)]
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(wanted[0].unionAll(wanted[1])), "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    rows = {q: [r["text"].encode() for r in texts.where(F.col("quality") == q).select("doc_id", "text").orderBy(*order).limit(per_class).collect()] for q in (1, 0)}
    return fit(rows[1], rows[0], dictionary_texts, dictionary_bytes, level, longest)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1) of the whole text and predicted (1 if score >= `threshold`, else 0).

    A text longer than those of the fit is scored by all its pieces, so its length alone decides nothing.
    A null text scores as an empty one. Columns of `docs` with these names are replaced; rows are never
    dropped, and equal texts get equal scores. Only the text enters the score.
    """

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scored(texts)

    @tidy
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            values = [model.scores([(t or "").encode() for t in s.iloc[i:i + 512]]) for i in range(0, len(s), 512)]
            yield pd.Series(np.concatenate([np.zeros(0), *values]))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*kept, scores("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
