"""Privacy accounting for noisy gradient steps with Poisson-sampled lots, as a table job.

Rényi divergence of the sampled Gaussian mechanism at integer and at real orders, after Mironov, Talwar and
Zhang (2019); conversion to (epsilon, delta) after Balle et al. (2020). Orders between 1 and 2 and between integers matter where
epsilon is large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERS = (*range(2, 65), 80, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048)
LEAST_TERM = math.log(1e-10)
REAL_ORDERS = (1.05, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9, *(i + 0.5 for i in range(2, 16)))


def rdp(settings: DataFrame, orders: Sequence[int] = ORDERS,
        rate: str = "rate", sigma: str = "sigma") -> DataFrame:
    """(rate, sigma, alpha, rdp) of one step for every distinct (rate, sigma), 0 < rate <= 1.

    log sum_k C(alpha,k) (1-q)^(alpha-k) q^k exp((k^2-k)/(2 sigma^2)), in one running log-sum-exp.
    """
    grid = (
        settings.select(F.col(rate).alias("rate"), F.col(sigma).alias("sigma")).distinct()
        .withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in orders])))
        .repartition(4 * settings.sparkSession.sparkContext.defaultParallelism, "rate", "sigma", "alpha")  # few rows, but up to 2048 terms each
    )
    q, s, a = F.col("rate"), F.col("sigma"), F.col("alpha")
    log_q, log_stay = F.col("_lq"), F.col("_ls")
    grid = grid.withColumn("_lq", F.ln(q)).withColumn(
        "_ls", F.when(q < 1, F.ln(1 - q)).otherwise(F.lit(-1e300)))

    def add(acc: Column, k: Column) -> Column:
        choose = acc["choose"] + F.ln((a - k + 1) / k)
        stay = F.when(a == k, 0.0).otherwise((a - k) * log_stay)
        term = choose + stay + k * log_q + (k * k - k) / (2 * s * s)
        top = F.greatest(acc["top"], term)
        total = acc["total"] * F.exp(acc["top"] - top) + F.exp(term - top)
        return F.struct(choose.alias("choose"), top.alias("top"), total.alias("total"))

    start = F.struct(F.lit(0.0).alias("choose"), (a * log_stay).alias("top"), F.lit(1.0).alias("total"))
    log_sum = F.aggregate(F.sequence(F.lit(1), a), start, add, lambda acc: acc["top"] + F.ln(acc["total"]))
    return grid.select("rate", "sigma", "alpha", (log_sum / (a - 1)).alias("rdp"))


def _log_erfc(x: np.ndarray) -> np.ndarray:
    """Logarithm of the complementary error function; by its asymptotic series where the function itself underflows."""
    small = np.minimum(x, 25.0)
    near = np.log(np.array([math.erfc(v) for v in small.ravel()])).reshape(x.shape)
    far = np.maximum(x, 25.0)
    return np.where(x < 25.0, near, -far**2 - np.log(far * math.sqrt(math.pi)) + np.log1p(-0.5 / far**2 + 0.75 / far**4))


def log_moment(q: np.ndarray, sigma: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """log E[(density ratio)^alpha] of one step at real orders above 1, for rates below 1.

    The two halves of the integral, left and right of the point where both densities meet, are binomial series with a factor of erfc each. Their
    terms alternate beyond alpha and fall like a power of their number. A row is done when its next term is below ``LEAST_TERM``, which is more than all
    that follow, and is added, so the sum is not too small. Positive and negative terms are added up apart, as logarithms.
    """
    out, left = np.full(len(q), np.nan), np.arange(len(q))
    plus, minus = np.full(len(q), -np.inf), np.full(len(q), -np.inf)
    choose, positive, i = np.zeros(len(q)), np.ones(len(q), bool), 0
    while len(left):
        rate, s, a = q[left], sigma[left], alpha[left]
        j, meet, width = a - i, s**2 * np.log(1 / rate - 1) + 0.5, math.sqrt(2) * s
        low = i * np.log(rate) + j * np.log1p(-rate) + (i * i - i) / (2 * s**2) + _log_erfc((i - meet) / width)
        high = j * np.log(rate) + i * np.log1p(-rate) + (j * j - j) / (2 * s**2) + _log_erfc((meet - j) / width)
        term = choose + np.logaddexp(low, high) - math.log(2)
        last = (i > a) & (term < LEAST_TERM)
        plus = np.where(positive | last, np.logaddexp(plus, term), plus)
        minus = np.where(positive | last, minus, np.logaddexp(minus, term))
        out[left[last]] = (plus + np.log1p(-np.exp(minus - plus)))[last]
        with np.errstate(divide="ignore"):
            choose = choose + np.log(np.abs(a - i)) - math.log(i + 1)
        positive = positive == (a - i >= 0)
        left, plus, minus, choose, positive = (v[~last] for v in (left, plus, minus, choose, positive))
        i += 1
    return out


def rdp_real(settings: DataFrame, orders: Sequence[float] = REAL_ORDERS, rate: str = "rate", sigma: str = "sigma") -> DataFrame:
    """(rate, sigma, alpha, rdp) as :func:`rdp`, at real orders above 1."""
    if min(orders) <= 1:
        raise ValueError("orders must be above 1")
    grid = settings.select(F.col(rate).cast("double").alias("rate"), F.col(sigma).cast("double").alias("sigma")).distinct()
    wanted = np.array(orders, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, s = (np.repeat(b.column(c).to_numpy(), len(wanted)) for c in ("rate", "sigma"))
            alpha = np.tile(wanted, b.num_rows)
            out = alpha / (2 * s**2)  # every row takes part
            some = q < 1
            if some.any():
                out[some] = log_moment(q[some], s[some], alpha[some]) / (alpha[some] - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q, s, alpha, out)], ["rate", "sigma", "alpha", "rdp"])

    return grid.mapInArrow(run, "rate double, sigma double, alpha double, rdp double")


def epsilon_at(total_rdp: Column, alpha: Column, delta: float) -> Column:
    a = alpha.cast("double")
    return F.greatest(
        total_rdp + F.ln((a - 1) / a) - (F.lit(math.log(delta)) + F.ln(a)) / (a - 1), F.lit(0.0))


def spent_rdp(steps: DataFrame, keys: Sequence[str], orders: Sequence[int] = ORDERS, real_orders: Sequence[float] = ()) -> DataFrame:
    """(keys, alpha, total): the Rényi divergence of all ``steps(keys, rate, sigma, steps)`` together, per order."""
    curve = rdp(steps, orders)
    if real_orders:
        curve = curve.withColumn("alpha", F.col("alpha").cast("double")).unionByName(rdp_real(steps, real_orders))
    return steps.join(curve, ["rate", "sigma"]).groupBy(*keys, "alpha").agg(F.sum(F.col("steps") * F.col("rdp")).alias("total"))


def spent_epsilon(steps: DataFrame, keys: Sequence[str], delta: float,
                  orders: Sequence[int] = ORDERS, real_orders: Sequence[float] = ()) -> DataFrame:
    """(keys, epsilon, best_alpha) for ``steps(keys, rate, sigma, steps)``; with ``real_orders`` also whole_epsilon, the best of ``orders`` alone.

    Steps with different rates or noise compose by adding their Rényi divergences. The steps should
    come pre-counted per (keys, rate, sigma). With ``real_orders`` the best of those, too, is taken; both epsilons come from the same sums.
    """
    keys = list(keys)
    spent = epsilon_at(F.col("total"), F.col("alpha"), delta)
    best = [F.min(F.struct(spent.alias("epsilon"), "alpha")).alias("_b")]
    if real_orders:
        best.append(F.min(F.when(F.col("alpha").isin([float(a) for a in orders]), spent)).alias("whole_epsilon"))
    return spent_rdp(steps, keys, orders, real_orders).groupBy(*keys).agg(*best).select(
        *keys, F.col("_b.epsilon").alias("epsilon"), F.col("_b.alpha").alias("best_alpha"), *(["whole_epsilon"] if real_orders else []))


def calibrate_noise(plans: DataFrame, keys: Sequence[str], targets: Sequence[float], delta: float,
                    sigmas: Sequence[float], orders: Sequence[int] = ORDERS) -> DataFrame:
    """Smallest grid noise whose spent epsilon stays within each target, for ``plans(keys, rate, steps)``."""
    keys = list(keys)
    tried = plans.withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    spent = spent_epsilon(tried.withColumn("_s", F.col("sigma")), [*keys, "_s"], delta, orders)
    wanted = spent.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    ok = F.col("epsilon") <= F.col("target")
    pick = F.min(F.when(ok, F.struct("_s", "epsilon")))
    return wanted.groupBy(*keys, "target").agg(pick.alias("_p")).select(
        *keys, "target", F.col("_p._s").alias("sigma"), F.col("_p.epsilon").alias("epsilon"))


def noise_for_all(spark: SparkSession, rate: float, steps: int, epsilons: Sequence[float], delta: float) -> dict[float, float]:
    """Noise multiplier of one training plan for every target: grid search, refined twice around the best value of each.

    All targets share a job per refinement.
    """
    highest = 0.2 * 2.0 ** 14
    spans = {float(e): (0.2, highest) for e in epsilons}
    found: dict[float, float] = {}
    for points in (29, 33, 33):
        grids = {e: [low * (high / low) ** (i / (points - 1)) for i in range(points)] for e, (low, high) in spans.items()}
        tried = spark.createDataFrame([(e, float(rate), s, s, int(steps)) for e, grid in grids.items() for s in grid],
                                      "target double, rate double, sigma double, tried double, steps long")
        spent = spent_epsilon(tried, ["target", "tried"], delta).where("epsilon <= target")
        found = {r["target"]: r["sigma"] for r in spent.groupBy("target").agg(F.min("tried").alias("sigma")).collect()}
        missed = [e for e in spans if e not in found]
        if missed:
            raise ValueError(f"no noise level up to {highest} reaches epsilon {missed}")
        for e, grid in grids.items():
            i = grid.index(found[e])
            spans[e] = (grid[i - 1] if i else found[e] * 0.5), found[e]
    return found


def noise_for(spark: SparkSession, rate: float, steps: int, epsilon: float, delta: float) -> float:
    return noise_for_all(spark, rate, steps, [epsilon], delta)[float(epsilon)]
