"""Premium, risk and portfolio models. Cross-sections are reduced by Spark; matrices of one date are solved in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..semantics import SPECIFIC_FLOOR
from ..sources.market import by_symbol

# -- factor premiums ---------------------------------------------------------------------------------------------------


def training_pairs(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Rows with the features of one tick and the target of the next, where all are there."""
    paired = df.withColumn("y", F.lead(target).over(by_symbol())).withColumn("date", F.lead("date").over(by_symbol()))
    return paired.select("date", "symbol", *features, "y").dropna()


def cross_sections(pairs: DataFrame, features: list[str]) -> DataFrame:
    """Per date the sums that a least-squares fit needs: n, B'B by rows, B'y. Sums, so partial results are small."""
    k = len(features)
    terms = {f"g{i}_{j}": F.sum(F.col(features[i]) * F.col(features[j])) for i in range(k) for j in range(i, k)} | {f"r{i}": F.sum(F.col(features[i]) * F.col("y")) for i in range(k)}
    sums = pairs.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *(v.alias(c) for c, v in terms.items()))
    gram = F.array(*(F.array(*(F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(k))) for i in range(k)))
    return sums.select("date", "n", gram.alias("gram"), F.array(*(F.col(f"r{i}") for i in range(k))).alias("moment"))


def ridge_premium(sums: DataFrame, ridge: float, halflife: float) -> DataFrame:
    """Per date the factor returns f of (B'B + n ridge I) f = B'y, and their mean so far, older dates decaying by the half-life.

    One row a date goes to one task: the series is as long as the calendar.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        decay, weight, mean, out = 2.0 ** (-1.0 / halflife), 0.0, 0.0, []
        for r in rows.itertuples():
            g = np.array([list(x) for x in r.gram])
            f = np.linalg.solve(g + r.n * ridge * np.eye(len(g)), np.array(r.moment))
            weight = decay * weight + 1
            mean = mean + (f - mean) / weight
            out.append((r.date, f.tolist(), np.asarray(mean).tolist()))
        return pd.DataFrame(out, columns=["date", "premium", "expected"])

    return sums.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(solve, "date date, premium array<double>, expected array<double>")


def factor_risk(pairs: DataFrame, features: list[str], cov_halflife: float, specific_halflife: float, rcond: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Factor covariance and specific variances of a cross-sectional regression model after the last date.

    Each date is one task: f = pinv(B) y, leverage q = diag(B pinv(B)), residual e^2 / max(1 - q, 1e-6). Both decay by
    their half-lives: the outer products by date, the residuals by the dates that had any cross-section.
    """
    k = len(features)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        b, y = rows[features].to_numpy(float), rows["y"].to_numpy(float)
        inverse = np.linalg.pinv(b, rcond=rcond)
        f = inverse @ y
        leverage = np.einsum("ij,ji->i", b, inverse)
        e2 = (y - b @ f) ** 2 / np.maximum(1 - leverage, 1e-6)
        return pd.DataFrame({"date": rows["date"], "symbol": rows["symbol"], "f": [f.tolist()] * len(rows), "e2": e2})

    fitted = pairs.groupBy("date").applyInPandas(one, "date date, symbol long, f array<double>, e2 double")
    days = fitted.groupBy("date").agg(F.first("f").alias("f"))
    newest = days.agg(F.count(F.lit(1)).alias("days"))
    numbered = days.withColumn("k", F.row_number().over(Window.orderBy("date"))).crossJoin(F.broadcast(newest))
    w = F.pow(F.lit(2.0), -(F.col("days") - F.col("k")) / cov_halflife)
    covariance = numbered.groupBy().agg(F.array(*(F.array(*(F.sum(w * F.col("f")[i] * F.col("f")[j]) / F.sum(w) for j in range(k))) for i in range(k))).alias("covariance"))
    own = F.pow(F.lit(2.0), -(F.col("days") - F.col("k")) / specific_halflife)
    specific = fitted.join(F.broadcast(numbered.select("date", "k", "days")), "date").groupBy("symbol").agg((F.sum(own * F.col("e2")) / F.sum(own)).alias("specific"))
    return covariance, specific


# -- shrinkage covariance ----------------------------------------------------------------------------------------------
#
# A window has t ticks and n assets, n usually far larger. Correlations C = U'U have the rank of U's t rows, so whatever
# is asked of them is asked of the t x t products G = UU', or of C times a few vectors; no n x n matrix is made.

TARGETS = ("none", "diagonal", "constant-correlation", "common-covariance", "single-index")


def unit_columns(returns: np.ndarray, cov_halflife: float, var_halflife: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U with C = U'U, each asset's deviation, and the ticks' shares of the decaying weight.

    returns: [tick, asset], the newest last; gaps are NaN and count as zero in C, and not at all in deviations. No mean
    is taken off.
    """
    age = np.arange(len(returns) - 1, -1, -1.0)
    slow, fast = np.exp2(-age / cov_halflife), np.exp2(-age / var_halflife)
    filled = np.nan_to_num(returns, nan=0.0, posinf=0.0, neginf=0.0)
    u = filled * np.sqrt(slow)[:, None]
    lengths = np.sqrt((u * u).sum(axis=0))
    u /= np.where(lengths > 0, lengths, 1.0)
    weight = fast @ np.isfinite(returns)
    deviation = np.sqrt(fast @ (filled * filled) / np.where(weight > 0, weight, 1.0))
    return u, deviation, slow / slow.sum()


def correlation_noise(u: np.ndarray, share: np.ndarray) -> float:
    """Estimation variance of the correlations, summed over all pairs of different assets.

    A pair's variance is the sum over ticks of (u_i u_j - share c_ij)^2. Over all pairs, squares of products of columns
    become squares of G's entries; what i = j adds is taken off.
    """
    g = u @ u.T
    everything = (np.diag(g) ** 2).sum() - 2 * (share @ (g * g)).sum() + (share @ share) * (g * g).sum()
    own = (u * u).sum(axis=0)
    alone = (u**4).sum() - 2 * (share @ (u * u)) @ own + (share @ share) * (own @ own)
    return float(everything - alone)


def _distance(u: np.ndarray, line: np.ndarray | None, level: float) -> float:
    """Squared distance of the correlations off the diagonal from line line' (if given), or from one level."""
    own = (u * u).sum(axis=0)
    g = u @ u.T
    squares = (g * g).sum() - own @ own
    if line is None:
        total = (u.sum(axis=1) ** 2).sum() - own.sum()
        n = u.shape[1]
        return float(squares - 2 * level * total + n * (n - 1) * level**2)
    crossed = ((u @ line) ** 2).sum() - own @ line**2
    return float(squares - 2 * crossed + (line @ line) ** 2 - (line**4).sum())


@dataclass
class Target:
    """A matrix diag(own) + line line' + level one one' off the diagonal, with `one` given by `along`; and its distance from C."""

    own: np.ndarray
    along: np.ndarray
    level: float
    distance: float | None

    def times(self, v: np.ndarray) -> np.ndarray:
        """The target times the columns of v."""
        spread = np.outer(self.along, self.along @ v) * self.level
        return spread + (self.own - self.level * self.along**2)[:, None] * v


def target_of(name: str, u: np.ndarray, deviation: np.ndarray) -> Target:
    """What the covariance is drawn to. A distance of None: it is not drawn at all."""
    n = len(deviation)
    variance, pairs = deviation**2, n * (n - 1)
    off = lambda columns: (columns.sum(axis=1) ** 2).sum() - (columns**2).sum()
    mean = off(u) / pairs if pairs else 0.0
    match name:
        case "none":
            return Target(np.zeros(n), np.zeros(n), 0.0, None)
        case "diagonal":
            return Target(variance, np.zeros(n), 0.0, _distance(u, None, 0.0))
        case "constant-correlation":
            return Target(variance, deviation, mean, _distance(u, None, mean))
        case "common-covariance":
            level = off(u * deviation) / pairs if pairs else 0.0
            return Target(np.full(n, variance.mean()), np.ones(n), level, _distance(u, None, mean))
        case "single-index":
            index = u.sum(axis=1)
            size = np.sqrt(index @ index)
            line = index @ u / (size if size > 0 else 1.0)
            return Target(variance, line * deviation, 1.0, _distance(u, line, 0.0))
    raise ValueError(f"no target {name}")


def largest_eigenpairs(times, n: int, k: int, rounds: int = 300, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their vectors of a symmetric matrix that is known by its products with columns.

    A basis grows by what the matrix makes of its newest columns, until the values settle or it spans everything.
    """
    rng = np.random.default_rng(0)
    basis, _ = np.linalg.qr(rng.normal(size=(n, min(n, 2 * k + 8))))
    image = times(basis)
    newest, before = image, None
    for _ in range(rounds):
        values, turn = np.linalg.eigh(basis.T @ image)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        vectors = basis @ turn
        gap = np.abs(image @ turn - vectors * values).max(initial=0.0)
        if basis.shape[1] >= n or gap <= tolerance * max(1e-300, np.abs(values).max(initial=0.0)):
            return values, vectors
        fresh = newest - basis @ (basis.T @ newest)
        fresh, sizes, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = fresh[:, sizes > 1e-13 * max(1e-300, np.abs(newest).max(initial=0.0))][:, : n - basis.shape[1]]
        if not fresh.shape[1]:  # the matrix makes nothing more of this basis
            return values, vectors
        fresh, _ = np.linalg.qr(fresh - basis @ (basis.T @ fresh))  # again, as one projection leaves rounding behind
        newest = times(fresh)
        basis, image = np.hstack((basis, fresh)), np.hstack((image, newest))
    return values, vectors


def shrunk_covariance(returns: np.ndarray, target: str, rank: int, *, cov_halflife: float = 250.0, var_halflife: float = 60.0, intensity: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Exposures [n, k], factor variances [k], specific variances [n] and the intensity.

    The covariance is drawn to the target by the share that noise has of the distance, 1 at most. Its largest
    eigenvectors are the factors; specific variances restore its diagonal. An asset without a return in the window has none.
    """
    n = returns.shape[1]
    seen = np.flatnonzero(np.isfinite(returns).any(axis=0))
    exposures, factors, specific = np.zeros((n, rank)), np.zeros(rank), np.full(n, np.nan)
    if not len(seen):
        return exposures, factors, specific, 0.0
    u, deviation, share = unit_columns(returns[:, seen], cov_halflife, var_halflife)
    goal = target_of(target, u, deviation)
    if intensity is None:
        intensity = 0.0
        if goal.distance is not None:
            intensity = min(1.0, max(0.0, correlation_noise(u, share) / (goal.distance if goal.distance > 0 else 1.0)))
    scaled = u * deviation
    mixed = lambda v: (1 - intensity) * (scaled.T @ (scaled @ v)) + intensity * goal.times(v)
    values, vectors = largest_eigenpairs(mixed, len(seen), min(rank, len(seen)))
    found = int((values > 0).sum())
    factors[:found] = values[:found]
    exposures[seen[:, None], np.arange(found)] = vectors[:, :found]
    diagonal = (1 - intensity) * (scaled**2).sum(axis=0) + intensity * goal.own
    specific[seen] = np.maximum(diagonal - vectors[:, :found] ** 2 @ values[:found], 0)
    return exposures, factors, specific, intensity


# -- portfolios and readouts -------------------------------------------------------------------------------------------


def minimum_variance(x: np.ndarray, f: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """Weights in proportion to S^-1 1 for S = X F X' + D, by the matrix inversion lemma; None if they can't be scaled to one."""
    inverse = 1 / np.maximum(d, SPECIFIC_FLOOR)
    keep = np.diag(f) > 0
    x, f = x[:, keep], f[np.ix_(keep, keep)]
    dx = x * inverse[:, None]
    inner = np.linalg.inv(f) + x.T @ dx if len(f) else np.zeros((0, 0))
    w = inverse - dx @ np.linalg.solve(inner, dx.sum(axis=0)) if len(f) else inverse
    total = w.sum()
    return w / total if total > 0 else None


def onto_simplex(v: np.ndarray, total: float = 1.0) -> np.ndarray:
    """The nearest point with entries of at least zero that add up to total."""
    u = np.sort(v)[::-1]
    excess = np.cumsum(u) - total
    k = np.flatnonzero(u - excess / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - excess[k] / (k + 1), 0)


def mean_variance(mu: np.ndarray, x: np.ndarray, f: np.ndarray, d: np.ndarray, aversion: float, *, benchmark: np.ndarray | None = None, steps: int = 5000, tolerance: float = 1e-10) -> np.ndarray:
    """Long-only, fully invested weights that maximize mu'w - aversion (w - b)'S(w - b): accelerated projected gradient."""
    b = np.zeros(len(mu)) if benchmark is None else benchmark
    d = np.maximum(d, SPECIFIC_FLOOR)
    times = lambda w: x @ (f @ (x.T @ w)) + d * w
    v = np.ones(len(mu)) / np.sqrt(len(mu))
    for _ in range(50):
        v = times(v)
        size = np.linalg.norm(v)
        v = v / size
    step = 1 / (2 * aversion * size * 1.05 + 1e-12)
    w = y = onto_simplex(np.ones(len(mu)))
    momentum = 1.0
    for _ in range(steps):
        new = onto_simplex(y + step * (mu - 2 * aversion * times(y - b)))
        nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        restart = (y - new) @ (new - w) > 0
        y = new if restart else new + (momentum - 1) / nxt * (new - w)
        momentum = 1.0 if restart else nxt
        if np.abs(new - w).max() < tolerance:
            w = new
            break
        w = new
    return w


def log_likelihood(r: np.ndarray, x: np.ndarray, f: np.ndarray, d: np.ndarray) -> float:
    """Gaussian log-likelihood of returns an asset, over those with returns, exposures and specific variance."""
    fine = np.isfinite(r) & np.isfinite(x).all(axis=1) & np.isfinite(d)
    n = int(fine.sum())
    if not n:
        return float("nan")
    r, x, d = r[fine], x[fine], np.maximum(d[fine], SPECIFIC_FLOOR)
    keep = np.diag(f) > 0
    x, f = x[:, keep], f[np.ix_(keep, keep)]
    inner = np.linalg.inv(f) + x.T @ (x / d[:, None])
    quad = r @ (r / d) - (x.T @ (r / d)) @ np.linalg.solve(inner, x.T @ (r / d))
    logdet = np.log(d).sum() + np.linalg.slogdet(f)[1] + np.linalg.slogdet(inner)[1]
    return float(-0.5 * (quad + logdet + n * np.log(2 * np.pi)) / n)


def portfolio_variance(w: np.ndarray, x: np.ndarray, f: np.ndarray, d: np.ndarray) -> float:
    held = w != 0
    t = x[held].T @ w[held]
    return float(t @ f @ t + (w[held] ** 2 * d[held]).sum())


def mean_correlation(x: np.ndarray, f: np.ndarray, d: np.ndarray) -> float:
    """Mean correlation off the diagonal over assets with variance."""
    var = np.einsum("ij,jk,ik->i", x, f, x) + d
    fine = var > 0
    m = int(fine.sum())
    if m < 2:
        return float("nan")
    s, sd = x[fine], np.sqrt(var[fine])
    t = s.T @ (1 / sd)
    total = t @ f @ t + (d[fine] / var[fine]).sum()
    return float((total - m) / (m * (m - 1)))


def factor_share(x: np.ndarray, f: np.ndarray, d: np.ndarray) -> float:
    """Share of the summed variances that factors explain."""
    own = np.einsum("ij,jk,ik->i", x, f, x)
    fine = np.isfinite(d)
    total = (own[fine] + d[fine]).sum()
    return float(own[fine].sum() / total) if total > 0 else float("nan")
