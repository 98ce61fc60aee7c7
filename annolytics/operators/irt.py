"""Latent-trait models (2PL and Rasch) fitted by marginal maximum likelihood over response patterns.

Items are compressed to weighted response patterns first. Each EM step (Bock and Aitkin 1981) is one Spark job: tasks
turn their patterns into expected counts per rater and quadrature node, a grouped sum adds them up, and only that
raters-by-nodes table comes back for the tiny M-step.

Plain EM creeps near the end, so two steps are extrapolated (SQUAREM, Varadhan and Roland 2008); a jump that lowers the
likelihood is taken back. Some raters have no finite best estimate: one who gives a single answer throughout, and one whose
answers the trait separates without error, so that the likelihood rises with the slope for ever. They are found and named:
the first by counting, the second by the likelihood-ratio interval: where EM has come to a slope beyond ``STEEP`` and neither
``STEEPEST`` nor twice that lies outside the 95 % interval of the slope, the interval has no upper end. Their estimates are
missing; the others are those given the separating raters at ``STEEPEST``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.functions.stats import Z_975
from annolytics.operators.agreement import response_patterns
from annolytics.session import materialize

NODES = np.linspace(-6.0, 6.0, 61)
STEEP, STEEPEST = 8.0, 25.0  # with nodes 0.2 apart, a slope beyond the latter gives nearly the same likelihood
FINE_NODES = np.linspace(-6.0, 6.0, 481)  # for likelihoods at such slopes
LIKELY = 1.920729410347062  # fixed value: half the 95 % point of chi-square with one degree of freedom
ROUND = 30  # steps between two looks for separating raters


@dataclass
class LatentFit:
    raters: list[str]
    slope: np.ndarray
    intercept: np.ndarray
    slope_se: np.ndarray
    intercept_se: np.ndarray
    variance: float
    log_likelihood: float
    steps: int
    observations: np.ndarray
    converged: bool = True
    bounded: np.ndarray | None = None  # per rater, whether a finite maximum exists


def _prior(sd: float, nodes: np.ndarray = NODES) -> np.ndarray:
    density = np.exp(-0.5 * (nodes / sd) ** 2)
    return density / density.sum()


def _posteriors(x: np.ndarray, slope: np.ndarray, intercept: np.ndarray, sd: float, nodes: np.ndarray = NODES):
    """Posterior weights over nodes and the log-likelihood per pattern; missing ratings add no factor."""
    eta = slope[:, None] * nodes[None, :] + intercept[:, None]
    log_p, log_q = -np.logaddexp(0, -eta), -np.logaddexp(0, eta)
    seen = ~np.isnan(x)
    ones = np.where(seen, x, 0.0)
    log_like = ones @ log_p + (seen - ones) @ log_q + np.log(_prior(sd, nodes))[None, :]
    peak = log_like.max(axis=1, keepdims=True)
    weights = np.exp(log_like - peak)
    total = weights.sum(axis=1, keepdims=True)
    return weights / total, np.log(total[:, 0]) + peak[:, 0], seen, ones


def _expected_counts(patterns: DataFrame, raters: int, settings: list[tuple[np.ndarray, np.ndarray, float]]):
    """Expected (positives, ratings) per rater and node, and the log-likelihood, for each parameter setting."""
    columns = [f"r{i}" for i in range(raters)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            x = batch[columns].to_numpy(dtype=float)
            n = batch["n"].to_numpy(dtype=float)
            for s, (slope, intercept, sd) in enumerate(settings):
                post, log_like, seen, ones = _posteriors(x, slope, intercept, sd)
                weighted = post * n[:, None]
                part = [ones.T @ weighted, seen.astype(float).T @ weighted, weighted.sum(axis=0), float(n @ log_like)]
                sums[s] = part if s not in sums else [a + b for a, b in zip(sums[s], part, strict=True)]
        frames = []
        for s, (hits, rated, mass, log_like) in sums.items():
            j, k = np.indices(hits.shape)
            frames.append(pd.DataFrame({"s": s, "j": j.ravel(), "k": k.ravel(), "a": hits.ravel(), "b": rated.ravel()}))
            frames.append(pd.DataFrame({"s": s, "j": -1, "k": np.arange(len(mass)), "a": mass, "b": 0.0}))
            frames.append(pd.DataFrame({"s": [s], "j": [-2], "k": [0], "a": [log_like], "b": [0.0]}))
        if frames:
            yield pd.concat(frames, ignore_index=True)

    rows = (
        patterns.mapInPandas(partial, "s int, j int, k int, a double, b double")
        .groupBy("s", "j", "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()
    )
    out = []
    for s in range(len(settings)):
        part = rows[rows.s == s]
        grid = part[part.j >= 0].sort_values(["j", "k"])
        shape = (raters, len(NODES))
        mass = part[part.j == -1].sort_values("k").a.to_numpy()
        out.append((grid.a.to_numpy().reshape(shape), grid.b.to_numpy().reshape(shape), mass, float(part[part.j == -2].a.sum())))
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def _logistic_step(hits, rated, slope, intercept, rasch):
    """Newton steps of one logistic regression per rater on the node table."""
    for _ in range(25):
        eta = slope[:, None] * NODES + intercept[:, None]
        p = _logistic(eta)
        resid, weight = hits - rated * p, rated * p * (1 - p)
        g_d, h_dd = resid.sum(1), weight.sum(1) + 1e-10
        if rasch:
            move_a, move_d = np.zeros_like(slope), g_d / h_dd
        else:
            g_a = (resid * NODES).sum(1)
            h_aa, h_ad = (weight * NODES**2).sum(1) + 1e-10, (weight * NODES).sum(1)
            det = h_aa * h_dd - h_ad**2
            move_a, move_d = (h_dd * g_a - h_ad * g_d) / det, (h_aa * g_d - h_ad * g_a) / det
        slope = slope + np.clip(move_a, -1, 1)
        intercept = intercept + np.clip(move_d, -1, 1)
        if max(np.abs(move_a).max(), np.abs(move_d).max()) < 1e-8:
            break
    return slope, intercept


def _gradient(counts, slope, intercept, sd, rasch):
    """Score of the marginal likelihood (Fisher's identity) in the free parameters."""
    hits, rated, mass, _ = counts
    resid = hits - rated * _logistic(slope[:, None] * NODES + intercept[:, None])
    if rasch:
        second = (mass * NODES**2).sum()
        prior_second = mass.sum() * (_prior(sd) * NODES**2).sum()
        return np.concatenate([resid.sum(1), [(second - prior_second) / sd**3]])
    return np.concatenate([(resid * NODES).sum(1), resid.sum(1)])


def starting_point(observed: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    share = (positive + 0.5) / (observed + 1)
    return np.ones(len(share)), np.log(share / (1 - share))


def em_step(
    patterns: DataFrame, slope: np.ndarray, intercept: np.ndarray, sd: float = 1.0, rasch: bool = False, fixed: np.ndarray | None = None
):
    """``slope, intercept, sd`` after one step, and the log-likelihood before it; ``fixed`` raters keep their values."""
    hits, rated, mass, log_likelihood = _expected_counts(patterns, len(slope), [(slope, intercept, sd)])[0]
    new_slope, new_intercept = _logistic_step(hits, rated, slope, intercept, rasch)
    if fixed is not None:
        new_slope, new_intercept = np.where(fixed, slope, new_slope), np.where(fixed, intercept, new_intercept)
    over = np.maximum(np.abs(new_slope) / STEEPEST, 1.0)  # the cut -d/a stays where it is
    new_sd = float(np.sqrt((mass * NODES**2).sum() / mass.sum())) if rasch else 1.0
    return new_slope / over, new_intercept / over, new_sd, log_likelihood


def _accelerated(patterns: DataFrame, x: np.ndarray, rasch: bool, fixed: np.ndarray, max_steps: int, tolerance: float):
    """Steps of EM from ``x`` (slopes, intercepts, log of the spread): point, steps, whether it is a fixed point."""
    j = len(x) // 2

    def step(x: np.ndarray) -> tuple[np.ndarray, float]:
        slope, intercept, sd, log_likelihood = em_step(patterns, x[:j], x[j : 2 * j], float(np.exp(x[-1])), rasch, fixed)
        return np.concatenate([slope, intercept, [np.log(sd)]]), log_likelihood

    first, steps = step(x)[0], 1
    while steps < max_steps:
        if np.abs(first - x).max() < tolerance:
            return first, steps, True
        second, first_level = step(first)
        steps += 1
        r = first - x
        v = second - first - r
        if np.abs(second - first).max() < tolerance or not (v @ v) > 0:
            return second, steps, True
        stride = min(-1.0, -np.sqrt((r @ r) / (v @ v)))
        jump = x - 2 * stride * r + stride**2 * v
        jump[:j] = np.clip(jump[:j], -STEEPEST, STEEPEST)
        jump[-1] = np.clip(jump[-1], -3.0, 3.0)
        after, jump_level = step(jump)
        steps += 1
        if np.isfinite(jump_level) and jump_level >= first_level:
            x, first = jump, after
        else:
            x, first = second, step(second)[0]
            steps += 1
    return first, steps, False


def _log_likelihoods(patterns: DataFrame, settings: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """The log-likelihood of each setting of slopes and intercepts, on fine nodes, in one pass."""
    columns = [f"r{i}" for i in range(len(settings[0][0]))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, n = batch[columns].to_numpy(dtype=float), batch["n"].to_numpy(dtype=float)
            sums = [float(n @ _posteriors(x, slope, intercept, 1.0, FINE_NODES)[1]) for slope, intercept in settings]
            yield pd.DataFrame({"s": range(len(settings)), "l": sums})

    rows = patterns.mapInPandas(partial, "s int, l double").groupBy("s").agg(F.sum("l")).collect()
    return [level for _, level in sorted(rows)]


def _separating(patterns: DataFrame, slope: np.ndarray, intercept: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The steep raters whose interval of the slope has no upper end, their cut and all other values being kept."""
    steep = np.flatnonzero((np.abs(slope) > STEEP) & ~fixed)
    found = np.zeros(len(slope), bool)
    if steep.size:
        def at(i: int, size: float):
            factor = np.where(np.arange(len(slope)) == i, size / np.abs(slope), 1.0)
            return slope * factor, intercept * factor

        now, *levels = _log_likelihoods(patterns, [(slope, intercept)] + [at(i, size) for i in steep for size in (STEEPEST, 2 * STEEPEST)])
        for i, near, far in zip(steep, levels[::2], levels[1::2]):
            found[i] = min(near, far) > now - LIKELY
    return found


def fit(
    ratings: DataFrame, item: Sequence[str], rater: str, value: str, raters: Sequence[str],
    rasch: bool = False, max_steps: int = 400, tolerance: float = 1e-4,
) -> LatentFit:
    """Fit P(yes) = logistic(a * theta + d). Rasch fixes a = 1 and frees the latent variance.

    Standard errors come from the observed information, by central differences of the score; all perturbed settings
    share one pass over the patterns. Estimates of raters without a finite maximum are NaN.
    """
    raters = list(raters)
    j = len(raters)
    patterns = materialize(response_patterns(ratings, item, rater, value, raters), "patterns")
    totals = patterns.agg(
        *[F.sum(F.when(F.col(f"r{i}").isNotNull(), F.col("n"))).alias(f"o{i}") for i in range(j)],
        *[F.sum(F.col("n") * F.col(f"r{i}")).alias(f"p{i}") for i in range(j)],
    ).first()
    observed = np.array([totals[f"o{i}"] or 0 for i in range(j)], dtype=float)
    positive = np.array([totals[f"p{i}"] or 0 for i in range(j)], dtype=float)
    varied = np.flatnonzero((positive > 0) & (positive < observed))
    slope, intercept = np.full(j, np.nan), np.full(j, np.nan)
    slope_se, intercept_se, bounded = slope.copy(), slope.copy(), np.zeros(j, bool)
    if not len(varied):
        return LatentFit(raters, slope, intercept, slope_se, intercept_se, np.nan, 0.0, 0, observed, False, bounded)
    m = len(varied)
    fitted = patterns.select(*[F.col(f"r{i}").alias(f"r{at}") for at, i in enumerate(varied)], "n")
    x = np.concatenate([*starting_point(observed[varied], positive[varied]), [0.0]])
    finite, steps, converged = np.ones(m, bool), 0, False
    while steps < max_steps and not converged and finite.any():
        x, taken, converged = _accelerated(fitted, x, rasch, ~finite, min(ROUND, max_steps - steps), tolerance)
        steps += taken
        lost = np.zeros(m, bool) if rasch else _separating(fitted, x[:m], x[m : 2 * m], ~finite)
        if lost.any():
            factor = np.where(lost, STEEPEST / np.maximum(np.abs(x[:m]), 1e-9), 1.0)
            x[:m], x[m : 2 * m] = x[:m] * factor, x[m : 2 * m] * factor
            finite, converged = finite & ~lost, False
    converged = converged or not finite.any()
    a, d, sd = x[:m], x[m : 2 * m], float(np.exp(x[-1]))
    free = np.flatnonzero(finite)

    def unpack(p):
        if rasch:
            return np.ones(m), p[:m], float(p[m])
        slopes, intercepts = a.copy(), d.copy()
        slopes[free], intercepts[free] = p[: len(free)], p[len(free) :]
        return slopes, intercepts, 1.0

    point = np.concatenate([d, [sd]]) if rasch else np.concatenate([a[free], d[free]])
    kept = np.arange(m + 1) if rasch else np.concatenate([free, m + free])
    h = 1e-3
    moved = [point + sign * h * np.eye(len(point))[i] for i in range(len(point)) for sign in (1, -1)]
    counts = _expected_counts(fitted, m, [unpack(p) for p in [point, *moved]])
    scores = [_gradient(c, *unpack(p), rasch)[kept] for c, p in zip(counts, [point, *moved], strict=True)]
    info = np.array([-(scores[1 + 2 * i] - scores[2 + 2 * i]) / (2 * h) for i in range(len(point))])
    se = _standard_errors((info + info.T) / 2) if len(point) else np.empty(0)
    at = varied if rasch else varied[free]
    slope[at], intercept[at] = (1.0, d) if rasch else (a[free], d[free])
    slope_se[at], intercept_se[at] = (0.0, se[:m]) if rasch else (se[: len(free)], se[len(free) :])
    bounded[at] = True
    return LatentFit(raters, slope, intercept, slope_se, intercept_se, sd * sd, counts[0][3], steps, observed, converged, bounded)


def _standard_errors(info: np.ndarray) -> np.ndarray:
    """From the observed information; NaN throughout where it is not positive definite, so where the model is not identified."""
    scale = np.sqrt(np.clip(np.diag(info), 0, None))
    if not (scale > 0).all() or np.linalg.eigvalsh(info / np.outer(scale, scale))[0] < 1e-8:
        return np.full(len(info), np.nan)
    return np.sqrt(np.diag(np.linalg.inv(info)))


def parameter_table(spark: SparkSession, model: LatentFit, as_cutpoint: bool = False) -> DataFrame:
    """One row per rater: estimates with 95 % limits and the number of ratings.

    ``as_cutpoint`` shows the trait value at which a rater says yes with probability one half, -d/a; limits are those
    of d divided by -a.
    """
    rows = []
    for i, name in enumerate(model.raters):
        a, d, half = model.slope[i], model.intercept[i], Z_975 * model.intercept_se[i]
        low, mid, high = d - half, d, d + half
        if as_cutpoint:
            low, high = sorted((low / -a, high / -a)) if a else (np.nan, np.nan)
            mid = d / -a if a else np.nan
        known = [None if np.isnan(x) else float(x) for x in (a, model.slope_se[i], mid, low, high)]
        bounded = model.bounded is None or bool(model.bounded[i])
        rows.append((name, *known, int(model.observations[i]), bounded, model.converged, model.steps))
    return spark.createDataFrame(
        rows, "rater string, slope double, slope_se double, location double, low double, high double, observations long, "
        "bounded boolean, converged boolean, steps int"
    )
