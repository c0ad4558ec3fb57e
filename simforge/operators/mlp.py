"""A multilayer perceptron over pair features: scoring by batches, and training on a bounded pool."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYERS = (64, 32, 16, 8)
THRESHOLD = 0.87


@dataclass(frozen=True)
class Mlp:
    """Weights (in x out) and biases of each layer; hidden layers end in ReLU, the last in a sigmoid."""

    weights: tuple
    biases: tuple

    def to_json(self) -> str:
        return json.dumps({"weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]})

    @staticmethod
    def from_json(text: str) -> Mlp:
        d = json.loads(text)
        return Mlp(tuple(np.array(w, dtype=float) for w in d["weights"]), tuple(np.array(b, dtype=float) for b in d["biases"]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        for w, b in zip(self.weights[:-1], self.biases[:-1]):
            x = np.maximum(x @ w + b, 0)
        return 1 / (1 + np.exp(-np.clip((x @ self.weights[-1] + self.biases[-1])[:, 0], -60, 60)))


def expression(model: Mlp, inputs: list[Column]) -> Column:
    """The probability as a Catalyst expression; for small models."""
    x = F.array(*[c.cast("double") for c in inputs])
    last = len(model.weights) - 1
    for i, (w, b) in enumerate(zip(model.weights, model.biases)):
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[:, j]]).alias("w"), F.lit(float(b[j])).alias("b")) for j in range(w.shape[1])])
        y = lambda x=x, rows=rows: F.transform(rows, lambda r: F.aggregate(F.zip_with(x, r["w"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) + r["b"])
        x = y() if i == last else F.transform(y(), lambda v: F.greatest(v, F.lit(0.0)))
    return 1 / (1 + F.exp(-x[0]))


def score(pairs: DataFrame, model: Mlp, features: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """pairs with Plagiarism_Probability and Is_Plagiarized; Arrow batches through numpy."""

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(np.clip(model.probability(x.to_numpy(dtype=float)), 0, 1))

    return pairs.withColumn("Plagiarism_Probability", run(F.struct(*features))).withColumn("Is_Plagiarized", F.col("Plagiarism_Probability") >= threshold)


def focal_loss(z: Column, y: Column, pos_weight: float = 1.0, gamma: float = 2.0, alpha: float = 0.5) -> Column:
    """The focal loss of a logit; the focus uses the plain probability, the log loss the weighted one."""
    p = 1 / (1 + F.exp(-z))
    softplus = lambda v: F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
    bce = F.when(y == 1, pos_weight * softplus(-z)).otherwise(softplus(z))
    return F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(F.when(y == 1, 1 - p).otherwise(p), F.lit(gamma)) * bce


def focal_gradient(z: np.ndarray, y: np.ndarray, pos_weight: float, gamma: float, alpha: float) -> tuple[float, np.ndarray]:
    """Mean focal loss and its derivative by the logits; the focus uses the plain probability, the log loss the weighted one."""
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    softplus = lambda v: np.logaddexp(0, v)
    bce = np.where(y == 1, pos_weight * softplus(-z), softplus(z))
    d_bce = np.where(y == 1, pos_weight * (p - 1), p)
    pt = np.where(y == 1, p, 1 - p)
    d_pt = np.where(y == 1, 1, -1) * p * (1 - p)
    a = np.where(y == 1, alpha, 1 - alpha)
    focus = (1 - pt) ** gamma
    grad = a * (focus * d_bce - gamma * (1 - pt) ** (gamma - 1) * d_pt * bce if gamma else focus * d_bce)
    return float((a * focus * bce).mean()), grad / len(z)


def best_cut(p: np.ndarray, y: np.ndarray) -> dict:
    """The threshold of 0.30 ... 0.95 with the best F1, and its scores and counts; ties by precision, recall, lowest threshold."""
    best, found = (-1.0,), {}
    for t in range(30, 96):
        z = p >= t / 100
        tp, fp, fn, tn = (int((z == a)[y == b].sum()) for a, b in ((True, 1), (True, 0), (False, 1), (False, 0)))
        precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        now = (2 * tp / (2 * tp + fp + fn) if tp else 0.0, precision, recall, -t / 100)
        if now > best:
            best, found = now, {"f1": now[0], "precision": precision, "recall": recall, "threshold": t / 100, "tp": tp, "fp": fp, "fn": fn, "tn": tn}
    return found


def best_f1(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(f1, threshold) of the best cut."""
    found = best_cut(p, y)
    return found["f1"], found["threshold"]


def train(x: np.ndarray, y: np.ndarray, valid_x: np.ndarray, valid_y: np.ndarray, epochs: int = 400, patience: int = 30, batch: int = 4096, rate: float = 1e-3, dropout: float = 0.4, pos_weight: float = 200.0, gamma: float = 2.0, alpha: float = 0.25, seed: int = 42) -> tuple[Mlp, float, list[dict]]:
    """Adam on the focal loss with early stopping by validation F1: model, threshold, history.

    x, y: a pool that the caller has bounded (reservoir and downsample), on the driver.
    """
    rng = np.random.default_rng(seed)
    sizes = [x.shape[1], *LAYERS, 1]
    params = [rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:])] + [np.zeros(b) for b in sizes[1:]]
    n, m, v, step = len(sizes) - 1, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    best, chosen, threshold, since, history = -1.0, None, 0.5, 0, []
    for epoch in range(1, epochs + 1):
        losses = []
        for rows in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
            acts, masks = [x[rows]], []
            for i in range(n - 1):
                h = np.maximum(acts[-1] @ params[i] + params[n + i], 0)
                masks.append((rng.random(h.shape) >= dropout) / (1 - dropout))
                acts.append(h * masks[-1])
            loss, g = focal_gradient((acts[-1] @ params[n - 1] + params[-1])[:, 0], y[rows], pos_weight, gamma, alpha)
            losses.append(loss)
            d, grads = g[:, None], [None] * (2 * n)
            for i in range(n - 1, -1, -1):
                grads[i], grads[n + i] = acts[i].T @ d, d.sum(axis=0)
                if i:
                    d = (d @ params[i].T) * masks[i - 1] * (acts[i] > 0)
            step += 1
            for k, gk in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        model = Mlp(tuple(params[:n]), tuple(params[n:]))
        found = best_cut(model.probability(valid_x), valid_y)
        history.append({"epoch": epoch, "train_loss": float(np.mean(losses)), **{f"valid_{k}": v for k, v in found.items()}})
        if found["f1"] > best:
            best, chosen, threshold, since = found["f1"], model, found["threshold"], 0
        elif (since := since + 1) >= patience:
            break
    return chosen, threshold, history
