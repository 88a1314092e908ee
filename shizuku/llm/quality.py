"""Quality of texts by Bradley-Terry pairwise ranking.

Every text has a vector of features: rates of its characters, words and lines, and the shares of its words by hash. Labelled texts give
preference pairs, a better one over a worse one; the weights minimise the logistic loss of the pairs' feature
differences. The weighted sum is the text's strength. A threshold is set at the quantile of the labelled strengths that
parts the labels' shares, and strengths are mapped to 0..1 by a logistic curve that passes through `CUT` there.

The model is fitted on at most `most` labelled rows (those with the smallest hash of their id) and `PAIRS` pairs of them.

Defined cases: null and empty texts have the features of a text without words and so one common score; without labels of
both kinds all scores are 0.5; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows, pairs and steps of a fit at most; the score at the threshold.
MOST, PAIRS, STEPS, CUT = 20_000, 60_000, 400, 0.3
#: Words whose hashes a worker keeps.
KEPT = 100_000
RAW, HASHED = 17, 256
_BYTE = {c: ord(c) for c in "|!.?,"}
_SPECIAL = [ord(c) for c in "|*#$%&!@=<>{}[]\\~^_+"]


def hashed(counts: dict[str, int], kept: dict[str, int]) -> np.ndarray:
    """Roots of the shares of a text's words by hash, HASHED of them."""
    out = np.zeros(HASHED)
    for word, n in counts.items():
        at = kept.get(word)
        if at is None:
            if len(kept) > KEPT:
                kept.clear()
            at = kept[word] = zlib.crc32(word.encode("utf-8", "replace")) % HASHED
        out[at] += n
    return np.sqrt(out / max(1, sum(counts.values())))


def features(text: str | None, kept: dict[str, int] | None = None) -> list[float]:
    """Shares and lengths of a whole text, RAW of them, and of its words by hash."""
    if not text:
        return [0.0] * (RAW + HASHED)
    n = len(text)
    words = text.split()
    m = max(1, len(words))
    folded = text.lower().split()
    counts = Counter(folded)
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    repeats = sum(map(str.__eq__, folded, folded[1:]))
    pairs = len(set(zip(folded, folded[1:], strict=False)))
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).tolist()
    per = {c: byte[i] / m for c, i in _BYTE.items()}
    return [
        math.log1p(n), math.log1p(len(words)), sum(byte[i] for i in _SPECIAL) / n, sum(byte[48:58]) / n, sum(byte[65:91]) / n,
        per["|"], per["!"], per["."] + per["?"], per[","],
        len(counts) / m, max(counts.values(), default=0) / m, repeats / m, pairs / m, len(set(lines)) / k,
        sum(map(len, words)) / m / 10, math.log1p(m / k), sum(map(str.isupper, words)) / m,
        *hashed(counts, {} if kept is None else kept).tolist(),
    ]


@dataclass
class Model:
    edges: np.ndarray  # quantiles of each raw feature
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, raw: np.ndarray) -> np.ndarray:
        return (expand(raw, self.edges) - self.mean) / self.scale @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(raw), 0.5)
        z = np.clip(self.slope * (self.strength(raw) - self.threshold) + math.log(CUT / (1 - CUT)), -40, 40)
        return 1 / (1 + np.exp(-z))


def expand(raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """All features and, for each that isn't hashed, a step at every edge: strengths needn't be straight lines of a feature."""
    steps = raw[:, :RAW, None] > edges[None, :, :]
    return np.hstack([raw, steps.reshape(len(raw), -1).astype(np.float64)])


def fit(raw: np.ndarray, label: np.ndarray, seed: int = 7, pairs: int = PAIRS, steps: int = STEPS) -> Model:
    """Bradley-Terry strengths from preference pairs of label 1 over label 0."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros((RAW, 0)), np.zeros(0), np.ones(0), np.zeros(0), 0.0, 1.0)
    edges = np.quantile(raw[np.concatenate([good, bad]), :RAW], [0.02, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.98], axis=0).T
    x = expand(raw, edges)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    a, b = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        part = rng.integers(0, pairs, min(pairs, 4096))
        diff = x[a[part]] - x[b[part]]
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    s = (x @ w).astype(np.float64)
    threshold = float(np.quantile(s, len(bad) / (len(bad) + len(good))))
    y, z = (label == 1).astype(float), s - threshold
    slope = min((float(np.mean(np.logaddexp(0, c * z + math.log(CUT / (1 - CUT))) - y * (c * z))), c) for c in np.geomspace(0.05, 20, 60))[1]
    return Model(edges, mean, scale, w.astype(np.float64), threshold, slope)


def train(labelled: DataFrame, text_col: str, label_col: str, id_col: str, most: int = MOST) -> Model:
    """A model of at most `most` different rows whose label is 0 or 1; only their features come to the driver. Rows that are equal in id, text and label count once."""
    usable = labelled.filter(F.col(label_col).isin(0, 1))
    named = usable.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__h"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    own = ["__id", "__h", "label"]
    chosen = named.select(*own).distinct().orderBy(F.xxhash64("__id"), *own).limit(most)
    rows = named.join(F.broadcast(chosen), own, "left_semi").dropDuplicates(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(x, kept) for x in batch.column(1).to_pylist()], pa.list_(pa.float64())), batch.column(2), batch.column(0).cast(pa.string()), batch.column(3)], names=["raw", "label", "id", "h"])

    got = rows.select("__id", "text", "label", "__h").mapInArrow(run, "raw array<double>, label int, id string, h long").toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("h", "ascending")])
    raw = np.array(got["raw"].to_pylist(), np.float64).reshape(-1, RAW + HASHED)
    return fit(raw, got["label"].to_numpy())


def rank(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all but the text by default) with quality_score, 0 to 1."""
    keep = [c for c in docs.columns if c not in (text_col, "quality_score")] if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    kept = docs.select(*keep, F.col(text_col).alias("__sz_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            raw = np.array([features(x, kept) for x in batch.column(batch.num_columns - 1).to_pylist()], np.float64).reshape(-1, RAW + HASHED)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held.value.score(raw), pa.float64())], names=[*batch.schema.names[:-1], "quality_score"])

    return kept.mapInArrow(run, T.StructType([*kept.drop("__sz_text").schema.fields, T.StructField("quality_score", T.DoubleType())]))
