"""Missing codes from the nearest rows that have one: local naive Bayes and local logistic regression.

The neighbours of each query, k rows with their weights, are a group; groups are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "query bigint, predicted bigint, probability double"


def naive_bayes_at(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log odds of the classes: weighted Gaussian densities; a feature without spread counts as equal or not."""
    out = np.full(len(classes), -np.inf)
    for i, c in enumerate(classes):
        own, s = x[y == c], w[y == c]
        if not s.sum():
            continue
        mean = np.average(own, axis=0, weights=s)
        spread = np.sqrt(np.average((own - mean) ** 2, axis=0, weights=s))
        some = spread > 0
        out[i] = np.log(s.sum() / w.sum()) - np.log(spread[some]).sum() - (((at - mean)[some] / spread[some]) ** 2).sum() / 2 + np.where(at[~some] == mean[~some], 0.0, -1e6).sum()
    return out


def logistic_at(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, classes: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Log odds of the classes: weighted softmax regression with an L2 penalty on all but the constants, by Newton's method."""
    use = w > 0
    x, y, w = np.column_stack([np.ones(use.sum()), x[use]]), y[use], w[use] / max(w.sum(), 1e-300)
    k, d = len(classes), x.shape[1]
    hot = (y[:, None] == classes[None]).astype(float)
    beta, penalty = np.zeros((k, d)), np.tile(np.concatenate([[0.0], np.ones(d - 1)]), k) * ridge + 1e-9
    for _ in range(steps):
        z = x @ beta.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = ((p - hot) * w[:, None]).T @ x + penalty.reshape(k, d) * beta
        bend = np.einsum("n,nij,na,nb->iajb", w, np.einsum("ni,ij->nij", p, np.eye(k)) - p[:, :, None] * p[:, None, :], x, x).reshape(k * d, k * d)
        step = np.linalg.solve(bend + np.diag(penalty), slope.ravel())
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        beta -= step.reshape(k, d)
        if np.abs(step).max() < 1e-10:
            break
    return beta @ np.concatenate([[1.0], at])


def impute(neighbours: DataFrame, x: str, at: str, label: str, weight: str, fit: Callable[..., np.ndarray] = naive_bayes_at) -> DataFrame:
    """query, predicted class and its probability. Rows: query, the neighbour's vector, the query's, the neighbour's class and weight.

    A null label or vector, or a weight of 0, leaves a neighbour out; without neighbours there is no prediction. Of equal classes the smaller.
    """
    rows = neighbours.select("query", F.col(x).alias("x"), F.col(at).alias("at"), F.col(label).cast("long").alias("y"), F.col(weight).cast("double").alias("w"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["y"].notna() & pdf["x"].notna() & (pdf["w"] > 0)]
        query = int(pdf["query"].iloc[0])
        if not len(own) or pdf["at"].iloc[0] is None:
            return pd.DataFrame({"query": [query], "predicted": pd.array([None], "Int64"), "probability": [None]})
        y = own["y"].to_numpy(np.int64)
        classes = np.unique(y)
        z = fit(np.array(own["x"].tolist(), float), y, own["w"].to_numpy(), np.array(pdf["at"].iloc[0], float), classes)
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return pd.DataFrame({"query": [query], "predicted": pd.array([int(classes[best])], "Int64"), "probability": [float(p[best] / p.sum())]})

    return rows.groupBy("query").applyInPandas(one, ANSWER)
