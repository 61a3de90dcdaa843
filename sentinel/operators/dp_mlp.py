"""Differentially private neural network: Poisson-sampled lots, per-example clipping, Gaussian noise.

Every row draws which steps it takes part in. The lots of a window of steps are written to the shared folder by
step, so a step reads its own lot and not the whole table. All budgets are trained on the same lots. Per-example gradient norms of a dense layer are
|input| * |error|, so clipping needs no per-example gradient in memory. The noise is added once, to
the sum, on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import argmax
from sentinel.functions.rand import fast_uniform, secret_seed
from sentinel.functions.storage import remove_dir, shared_dir
from sentinel.operators.accountant import noise_for_all, spent_epsilon
from sentinel.operators.gradients import batch_matrix, sum_partials

LOT_FILE_ROWS = 500_000
LOT_TASK_ROWS = 1000
LOT_WINDOW = 50
GRADIENT_ROWS = 1024  # rows of a lot whose layers stay in the cache of a core


@dataclass(frozen=True)
class Mlp:
    shapes: tuple[tuple[int, int], ...]
    theta: np.ndarray
    epsilon: float
    actual_epsilon: float
    delta: float
    sigma: float
    history: tuple[float, ...]


def _layers(theta: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for i, o in shapes:
        out.append((theta[at:at + i * o].reshape(i, o), theta[at + i * o:at + i * o + o]))
        at += i * o + o
    return out


def initial_weights(shapes: Sequence[tuple[int, int]], rng: np.random.Generator) -> np.ndarray:
    parts = []
    for i, o in shapes:
        limit = 1.0 / np.sqrt(i)
        parts += [rng.uniform(-limit, limit, i * o), rng.uniform(-limit, limit, o)]
    return np.concatenate(parts)


def forward(x: np.ndarray, layers: list, room: Sequence[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Layer inputs and softmax probabilities, written to ``room``, an array of each layer's width, where it is given."""
    inputs = [x]
    for k, (w, b) in enumerate(layers):
        z = np.matmul(inputs[-1], w, out=None if room is None else room[k][:len(x)])
        z += b
        if k < len(layers) - 1:
            inputs.append(np.maximum(z, 0.0, out=z))
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return inputs, z


def clipped_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray,
                     shapes: Sequence[tuple[int, int]], clip: float) -> tuple[np.ndarray, float]:
    """(sum of per-example gradients, each scaled to norm <= clip; summed loss)."""
    layers, total, loss = _layers(theta, shapes), np.zeros_like(theta), 0.0
    sums = _layers(total, shapes)  # views
    outputs, errors = ([np.empty((min(len(y), GRADIENT_ROWS), o)) for _, o in shapes] for _ in range(2))  # once: fresh memory costs more than the sums
    for begin in range(0, len(y), GRADIENT_ROWS):
        some = slice(begin, begin + GRADIENT_ROWS)
        loss += _add_clipped(x[some], y[some], weight[some], layers, clip, sums, outputs, errors)
    return total, loss


def _add_clipped(x: np.ndarray, y: np.ndarray, weight: np.ndarray, layers: list, clip: float, sums: list, outputs: list, back: list) -> float:
    """Adds the clipped gradients of a few rows to ``sums``, an array of weights and one of biases per layer, and returns their loss.

    ``outputs`` and ``back`` are overwritten: arrays of each layer's width with as many rows or more.
    """
    inputs, error = forward(x, layers, outputs)
    rows = np.arange(len(y))
    loss = float(-(weight * np.log(np.maximum(error[rows, y], 1e-12))).sum())
    error[rows, y] -= 1.0
    error *= weight[:, None]
    errors = [error]
    for k in range(len(layers) - 1, 0, -1):
        before = np.matmul(errors[0], layers[k][0].T, out=back[k - 1][:len(y)])
        before *= inputs[k] > 0
        errors.insert(0, before)
    length = lambda v: np.einsum("ij,ij->i", v, v)
    square = sum(length(e) * (length(a) + 1.0) for a, e in zip(inputs, errors))
    factor = np.minimum(1.0, clip / np.maximum(np.sqrt(square), 1e-12))
    for (w, b), a, e in zip(sums, inputs, errors):
        if a.shape[1] < e.shape[1]:  # the narrower side takes the factor
            w += (a * factor[:, None]).T @ e
            b += factor @ e
        else:
            e *= factor[:, None]
            w += a.T @ e
            b += e.sum(0)
    return loss


def assign_lots(rows: DataFrame, key: str, rate: float, begin: int, last: int, seed: str) -> DataFrame:
    """One row per (step, participating row); every row joins every step from ``begin`` to ``last`` independently."""
    joined = F.filter(F.sequence(F.lit(begin), F.lit(last)),
                      lambda s: fast_uniform(seed, F.col(key), s) < F.lit(rate))
    return rows.withColumn("step", F.explode(joined))


def train(
    rows: DataFrame, key: str, features: str, label: str, n_classes: int, epsilon: float, **settings,
) -> Mlp:
    """Train at one epsilon, see :func:`train_sweep`."""
    return train_sweep(rows, key, features, label, n_classes, [epsilon], **settings)[float(epsilon)]


def train_sweep(
    rows: DataFrame, key: str, features: str, label: str, n_classes: int, epsilons: Sequence[float],
    delta: float = 1e-5, hidden: Sequence[int] = (128, 64), steps: int = 300, rate: float | None = None,
    epochs: float = 20.0, clip: float = 1.0, lr: float = 1e-3, balanced: bool = True,
    seed: int | None = None, window: int = LOT_WINDOW,
) -> dict[float, Mlp]:
    """One network per epsilon, trained together: they share the lots and the start and differ in their noise.

    A step is one job that reads its lot once and returns the gradient sums of all networks. Lots are drawn and written
    for ``window`` steps at a time and deleted after use, so at most rate * window copies of the table exist. ``rate``,
    the share of rows in a lot, defaults to epochs / steps; on large tables choose a small one, the accountant gets it.
    """
    bad = [e for e in epsilons if not e > 0]
    if bad:
        raise ValueError(f"epsilon must be positive, got {bad}")
    spark = rows.sparkSession
    rate = min(1.0, epochs / steps) if rate is None else rate
    budgets = sorted(float(e) for e in epsilons)
    sigma = noise_for_all(spark, rate, steps, budgets, delta)

    counts = {r["y"]: r["count"] for r in
              rows.groupBy(F.col(label).cast("int").alias("y")).count().collect()}
    n = sum(counts.values())
    weight = np.ones(n_classes)
    if balanced:
        for k in range(n_classes):
            weight[k] = n / (len(counts) * counts[k]) if counts.get(k) else 0.0

    slim = rows.select(F.col(key).alias("k"), F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(label).cast("int").alias("y"))
    lot_seed, folder = secret_seed(seed), f"{shared_dir(spark).rstrip('/')}/lots-{uuid.uuid4().hex}"
    dim = len(rows.select(features).first()[0])
    sizes = [dim, *hidden, n_classes]
    shapes = tuple(zip(sizes[:-1], sizes[1:]))
    noise = {e: np.random.default_rng(None if seed is None else [seed, i]) for i, e in enumerate(budgets)}
    start = initial_weights(shapes, np.random.default_rng(seed))
    theta = np.tile(start, (len(budgets), 1))
    first, second, history = np.zeros_like(theta), np.zeros_like(theta), [[] for _ in budgets]
    try:
        for begin in range(1, steps + 1, window):
            last = min(begin + window - 1, steps)
            stored = _stored_lots(slim, rate, begin, last, lot_seed, n, f"{folder}/{begin}")
            for step in range(begin, last + 1):
                def partial(batch, now=theta):
                    y, x = batch.column("y").to_numpy(), batch_matrix(batch, "x")
                    parts = [clipped_gradient(x, y, weight[y], t, shapes, clip) for t in now]
                    return np.concatenate([np.append(loss, g) for g, loss in parts])

                total = sum_partials(stored.where(F.col("step") == step).select("x", "y"), partial, theta.size + len(budgets))
                total = total.reshape(len(budgets), -1)
                drawn = np.stack([noise[e].normal(0.0, sigma[e] * clip, theta.shape[1]) for e in budgets])
                noisy = (total[:, 1:] + drawn) / (rate * n)
                for h, loss in zip(history, total[:, 0]):
                    h.append(loss / (rate * n))
                first = 0.9 * first + 0.1 * noisy
                second = 0.999 * second + 0.001 * noisy ** 2
                theta = theta - lr * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            remove_dir(spark, f"{folder}/{begin}")
    finally:
        remove_dir(spark, folder)

    plan = spark.createDataFrame([(e, float(rate), sigma[e], int(steps)) for e in budgets],
                                 "target double, rate double, sigma double, steps long")
    actual = {r["target"]: r["epsilon"] for r in spent_epsilon(plan, ["target"], delta).collect()}
    return {e: Mlp(shapes, theta[i], e, actual[e], delta, sigma[e], tuple(history[i])) for i, e in enumerate(budgets)}


def _stored_lots(slim: DataFrame, rate: float, begin: int, last: int, seed: str, n: int, path: str) -> DataFrame:
    """The lots of steps ``begin`` to ``last``, written by step, in files of bounded size; a lot of more than ``LOT_TASK_ROWS`` rows has files for several cores."""
    cores = slim.sparkSession.sparkContext.defaultParallelism
    files = max(1, int(np.ceil(rate * n / LOT_FILE_ROWS)), min(cores, int(np.ceil(rate * n / LOT_TASK_ROWS))))
    lots = assign_lots(slim, "k", rate, begin, last, seed)
    spread = files * min(last - begin + 1, 16)  # a multiple of files, so that no two files of a step fall together
    slot = F.pmod((F.col("step") - begin) * files + F.pmod(F.xxhash64("k"), F.lit(files)), F.lit(spread)).cast("int")
    lots.repartitionById(spread, slot).write.partitionBy("step").parquet(path)
    return slim.sparkSession.read.parquet(path)


def predict(df: DataFrame, model: Mlp, features: str = "features") -> DataFrame:
    """Add ``probs``, ``y_pred`` and ``epsilon``."""
    return predict_all(df, [model], features)


def predict_all(df: DataFrame, models: Sequence[Mlp], features: str = "features") -> DataFrame:
    """One row per input row and network, from one pass: the stacked weights of all networks meet each batch once."""
    shapes, theta, budgets = models[0].shapes, np.stack([m.theta for m in models]), [m.epsilon for m in models]
    if any(m.shapes != shapes for m in models):
        raise ValueError("the networks have different layers")

    @F.arrow_udf("array<array<double>>")
    def probabilities(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), shapes[0][0])
        each = np.stack([forward(rows, _layers(t, shapes))[1] for t in theta], axis=1)  # rows x networks x classes
        n, count, classes = each.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(n * count + 1) * classes, pa.int32()), pa.array(each.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * count, pa.int32()), inner)

    x = F.transform(features, lambda v: v.cast("double"))
    pairs = F.arrays_zip(F.array(*map(F.lit, budgets)).alias("epsilon"), F.col("_all").alias("probs"))
    scored = df.withColumn("_all", probabilities(x)).withColumn("_one", F.explode(pairs))
    return scored.withColumn("probs", F.col("_one")["probs"]).withColumn("y_pred", argmax(F.col("probs"))).withColumn(
        "epsilon", F.col("_one")["epsilon"]).drop("_all", "_one")
