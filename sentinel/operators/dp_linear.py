"""Differentially private logistic regression by objective perturbation, for a whole budget grid.

After Chaudhuri, Monteleoni and Sarwate (2011). Rows are clipped to the norm bound, extended by a
constant 1 and scaled into the unit ball. A random linear term is added to the objective once, then
the objective is minimised exactly, so the number of passes costs no budget. More than two classes
are one-vs-rest problems sharing the budget equally.

All problems (epsilon x class) advance together: one pass over the rows returns loss and gradient of
every candidate weight vector. Driver state is a few vectors per problem.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import argmax, array_sql, double
from sentinel.functions.storage import training_table
from sentinel.operators.gradients import batch_matrix, sum_partials
from sentinel.operators.scale import clip_to_norm
from sentinel.schema import EPSILON_GRID

CURVATURE = 0.25  # largest second derivative of the logistic loss


@dataclass(frozen=True)
class LinearModels:
    """Weights per epsilon (None = not private), shape (problems, d + 1), on unscaled features.

    The privacy of objective perturbation holds at the minimiser. ``residuals`` has the final gradient norm per epsilon,
    relative to the start; a model with a large one is not the minimiser and must not be called private.
    """

    epsilons: tuple[float | None, ...]
    weights: tuple[np.ndarray, ...]
    n_classes: int
    norm_bound: float
    passes: int
    residuals: tuple[float, ...]

    def converged(self, tolerance: float = 1e-3) -> bool:
        return max(self.residuals) <= tolerance


def perturbation(epsilon: float, n: int, reg: float, dim: int,
                 rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(random linear term, extra regularisation) for one problem with rows in the unit ball."""
    spare = epsilon - 2.0 * math.log1p(CURVATURE / (n * reg))
    extra = 0.0
    if spare <= 0:
        extra = max(CURVATURE / (n * math.expm1(epsilon / 4.0)) - reg, 0.0)
        spare = epsilon / 2.0
    direction = rng.standard_normal(dim)
    direction /= np.linalg.norm(direction)
    return direction * rng.gamma(dim, 2.0 / spare), extra


def train(
    rows: DataFrame, features: str, label: str, n_classes: int, norm_bound: float,
    epsilons: Sequence[float | None] = EPSILON_GRID, c: float = 1.0, balanced: bool = False,
    max_iter: int = 200, tol: float = 1e-6, seed: int | None = None,
) -> LinearModels:
    """Train at every epsilon. ``seed=None`` draws the noise from the system's entropy."""
    for e in epsilons:
        if e is not None and not e > 0:
            raise ValueError(f"epsilon must be positive, got {e}")
    radius = math.sqrt(norm_bound ** 2 + 1.0)
    clipped = F.transform(F.concat(clip_to_norm(F.col(features), norm_bound), F.array(F.lit(1.0))),
                          lambda v: v / F.lit(radius))
    table = training_table(rows.select(clipped.alias("x"), F.col(label).cast("int").alias("y")))

    counts = {r["y"]: r["count"] for r in table.groupBy("y").count().collect()}
    n = sum(counts.values())
    row_weight = np.ones(n_classes)
    if balanced:  # largest weight 1, so that a row's influence keeps its bound
        row_weight = np.array([1.0 / counts[k] if counts.get(k) else 0.0 for k in range(n_classes)])
        row_weight /= row_weight.max()
    dim = len(table.first()["x"])
    targets = [1] if n_classes == 2 else list(range(n_classes))
    per_eps = len(targets)
    target = np.array(targets * len(epsilons))
    m = len(target)

    rng = np.random.default_rng(seed)
    reg = np.full(m, 1.0 / (c * n * radius ** 2))
    tilt = np.zeros((m, dim))
    for p in range(m):
        e = epsilons[p // per_eps]
        if e is not None:
            tilt[p], extra = perturbation(e / per_eps, n, reg[p], dim, rng)
            reg[p] += extra

    def gram(batch):
        x = batch_matrix(batch, "x")
        return (x.T @ x).ravel()

    bound = CURVATURE * sum_partials(table, gram, dim * dim).reshape(dim, dim) / n

    def objective(weights: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and gradient for weights[j], a candidate of problem which[j]."""
        goal = target[which]

        def partial(batch):
            x = batch_matrix(batch, "x")
            y = batch.column("y").to_numpy()
            sign = np.where(y[:, None] == goal[None, :], 1.0, -1.0)
            margin = sign * (x @ weights.T)
            w = row_weight[y][:, None]
            loss = (w * np.logaddexp(0.0, -margin)).sum(axis=0)
            slope = -w * sign / (1.0 + np.exp(np.minimum(margin, 700.0)))
            return np.concatenate([loss, (slope.T @ x).ravel()])

        out = sum_partials(table, partial, len(which) * (dim + 1))
        k = len(which)
        value = out[:k] / n + 0.5 * reg[which] * (weights ** 2).sum(1) + (tilt[which] * weights).sum(1) / n
        grad = out[k:].reshape(k, dim) / n + reg[which, None] * weights + tilt[which] / n
        return value, grad

    solve0 = [np.linalg.inv(bound + np.eye(dim) * r) for r in reg]
    w = np.zeros((m, dim))
    value, grad = objective(w, np.arange(m))
    scale = np.maximum(np.linalg.norm(grad, axis=1), 1e-12)
    memory: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(m)]
    passes, steps = 2, (1.0, 3.0, 0.3)
    for _ in range(max_iter):
        active = np.where(np.linalg.norm(grad, axis=1) > tol * scale)[0]
        if not len(active):
            break
        moves = np.stack([-_two_loop(grad[p], memory[p], solve0[p]) for p in active])
        which = np.repeat(active, len(steps))
        tries = np.concatenate([w[p] + np.outer(steps, d) for p, d in zip(active, moves)])
        v, g = objective(tries, which)
        passes += 1
        moved = False
        for j, p in enumerate(active):
            at = j * len(steps) + int(np.argmin(v[j * len(steps):(j + 1) * len(steps)]))
            if v[at] < value[p]:
                s, t = tries[at] - w[p], g[at] - grad[p]
                if s @ t > 1e-16 * (s @ s):
                    memory[p] = memory[p][-9:] + [(s, t)]
                w[p], value[p], grad[p] = tries[at], v[at], g[at]
                moved = True
            elif memory[p]:
                memory[p], moved = [], True
        if not moved:
            break
    unscaled = w / radius
    residual = np.linalg.norm(grad, axis=1) / scale
    return LinearModels(
        tuple(epsilons), tuple(unscaled[i * per_eps:(i + 1) * per_eps] for i in range(len(epsilons))),
        n_classes, norm_bound, passes, tuple(float(residual[i * per_eps:(i + 1) * per_eps].max()) for i in range(len(epsilons))))


def _two_loop(grad: np.ndarray, memory: list, inverse0: np.ndarray) -> np.ndarray:
    """L-BFGS direction with the curvature bound's inverse as the starting metric."""
    q, alphas = grad.copy(), []
    for s, t in reversed(memory):
        a = (s @ q) / (s @ t)
        q -= a * t
        alphas.append(a)
    r = inverse0 @ q
    for (s, t), a in zip(memory, reversed(alphas)):
        r += s * (a - (t @ r) / (s @ t))
    return r


def predict(df: DataFrame, models: LinearModels, features: str = "features") -> DataFrame:
    """One row per input row and epsilon with ``probs`` and ``y_pred``. Only training clips rows."""
    x = F.concat(F.transform(features, lambda v: v.cast("double")), F.array(F.lit(1.0)))
    grid = F.expr("explode(array(" + ", ".join(
        f"named_struct('epsilon', {double(e)}, 'w', array({', '.join(array_sql(row.tolist()) for row in w)}))"
        for e, w in zip(models.epsilons, models.weights)) + "))")
    margins = F.transform(F.col("_m.w"), lambda w: F.aggregate(
        F.zip_with("_x", w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
    each = F.transform(margins, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    scored = df.withColumn("_x", x).withColumn("_m", grid).withColumn("_p", each)
    if models.n_classes == 2:
        probs = F.array(F.lit(1.0) - F.get("_p", F.lit(0)), F.get("_p", F.lit(0)))
    else:
        total = F.aggregate("_p", F.lit(0.0), lambda a, v: a + v)
        probs = F.transform("_p", lambda v: v / total)
    scored = scored.withColumn("probs", probs).withColumn("epsilon", F.col("_m.epsilon"))
    return scored.withColumn("y_pred", argmax(F.col("probs"))).drop("_x", "_m", "_p")
