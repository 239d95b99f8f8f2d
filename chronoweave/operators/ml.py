"""Models: balanced boosted trees and logistic regression of Spark ML, and an isolation forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Adds weight: n / (2 * rows of the row's class)."""
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}
    n = sum(counts.values())
    weight = F.lit(1.0)
    for value, k in counts.items():
        weight = F.when(F.col(label) == value, n / (2.0 * k)).otherwise(weight)
    return train.withColumn("weight", weight)


def fit_predict(train: DataFrame, score: DataFrame, features: list[str], label: str, model: str = "gbt", seed: int = 0, rounds: int = 20) -> DataFrame:
    """score's rows with p, the probability of the positive class.  A training set of one class gives that class's rate."""
    classes = train.select(label).distinct().count()
    if classes < 2:
        return score.withColumn("p", F.lit(float(train.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)))
    assemble = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="keep")
    fit, rows = (assemble.transform(d) for d in (balanced(train.withColumn(label, F.col(label).cast("double")), label), score))
    scaler = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True).fit(fit)
    fit, rows = scaler.transform(fit).select("features", label, "weight").persist(), scaler.transform(rows)  # a fit reads its rows several times
    args = {"featuresCol": "features", "labelCol": label, "weightCol": "weight"}
    made = (GBTClassifier(maxIter=rounds, maxDepth=4, seed=seed, **args) if model == "gbt" else LogisticRegression(maxIter=100, regParam=1e-3, **args)).fit(fit)
    fit.unpersist()
    return made.transform(rows).withColumn("p", vector_to_array("probability")[1]).select(*score.columns, "p")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int):
    """A random tree: (feature, cut, below, above), or the number of rows at a leaf."""
    if depth == 0 or len(x) <= 1:
        return len(x)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    if not len(spread):
        return len(x)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    return f, cut, _grow(x[low], rng, depth - 1), _grow(x[~low], rng, depth - 1)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def walk(node, rows: np.ndarray, depth: int) -> None:
        if not isinstance(node, tuple):
            out[rows] = depth + _average_path(node)
            return
        f, cut, low_node, high_node = node
        low = x[rows, f] < cut
        walk(low_node, rows[low], depth + 1)
        walk(high_node, rows[~low], depth + 1)

    walk(tree, np.arange(len(x)), 0)
    return out


def isolation_forest(train: DataFrame, score: DataFrame, features: list[str], trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """score's rows with anomaly (higher is stranger): 2^-(mean path / average path), as the method defines it.

    Each tree sees ``sample`` rows, so the driver fetches at most trees * sample rows, by hash order; scoring is a map, and only the features leave the JVM.
    """
    wanted = trees * sample
    total = train.count()
    drawn = train if total <= wanted else train.where(F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * wanted / total)))
    x = np.array([[float(v or 0) for v in r] for r in drawn.select(*features).limit(wanted).collect()]).reshape(-1, len(features))
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    forest = [_grow(x[rng.choice(len(x), size, replace=False)], rng, math.ceil(math.log2(max(2, size)))) for _ in range(trees)] if len(x) else []
    norm = _average_path(size) or 1.0

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            values = part.fillna(0).to_numpy(float)
            mean = sum(_depths(t, values) for t in forest) / max(1, len(forest))
            yield pd.Series(np.exp2(-mean / norm) if forest else np.zeros(len(part)))

    return score.withColumn("anomaly", run(F.struct(*features)))


def sage_step(x: np.ndarray, neighbours: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer and output of a two-layer mean-aggregating network (neighbours: row-normalised adjacency)."""
    h = np.maximum(neighbours @ x @ w["l1"] + x @ w["r1"] + w["b1"], 0)
    return h, neighbours @ h @ w["l2"] + h @ w["r2"] + w["b2"]


def train_sage(x: np.ndarray, neighbours: np.ndarray, y: np.ndarray, rows: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 1e-2, seed: int = 0) -> tuple[dict[str, np.ndarray], list[float]]:
    """Weights and losses: binary cross-entropy with pos_weight = negatives / positives, Adam, over one bounded snapshot."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = {"l1": rng.normal(0, d**-0.5, (d, hidden)), "r1": rng.normal(0, d**-0.5, (d, hidden)), "b1": np.zeros(hidden), "l2": rng.normal(0, hidden**-0.5, (hidden, 1)), "r2": rng.normal(0, hidden**-0.5, (hidden, 1)), "b2": np.zeros(1)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    positives = max(1.0, float(y[rows].sum()))
    weight = np.where(y[rows] > 0, (len(rows) - positives) / positives, 1.0)
    losses = []
    for step in range(1, epochs + 1):
        h, z = sage_step(x, neighbours, w)
        p = 1 / (1 + np.exp(-np.clip(z[rows, 0], -30, 30)))
        losses.append(float(-(weight * (y[rows] * np.log(p + 1e-12) + (1 - y[rows]) * np.log(1 - p + 1e-12))).mean()))
        dz = np.zeros_like(z)
        np.add.at(dz[:, 0], rows, weight * (p - y[rows]) / len(rows))
        back = neighbours.T @ dz
        dh = (back @ w["l2"].T + dz @ w["r2"].T) * (h > 0)
        near = neighbours @ x
        grads = {"l2": (neighbours @ h).T @ dz, "r2": h.T @ dz, "b2": dz.sum(axis=0), "l1": near.T @ dh, "r1": x.T @ dh, "b1": dh.sum(axis=0)}
        for k, g in grads.items():
            m, v = moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moments[k] = m, v
            w[k] = w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, losses
