from __future__ import annotations

import math

import numpy as np
import pytest

from tidegrid.operators import models
from tidegrid.operators.chips import COLUMNS, distribution
from tidegrid.operators.simulator import simulate
from tidegrid.operators.text import text_of


def covariance(seed=0, n=12, k=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, k)), np.diag(rng.uniform(0.5, 2, k)), rng.uniform(0.1, 1, n)


def test_minimum_variance_is_the_inverse():
    x, f, d = covariance()
    w = models.minimum_variance(x, f, d)
    inverse = np.linalg.inv(x @ f @ x.T + np.diag(d)).sum(axis=1)
    assert w == pytest.approx(inverse / inverse.sum()) and w.sum() == pytest.approx(1)


def test_mean_variance_meets_its_conditions():
    x, f, d = covariance(1)
    mu = np.random.default_rng(2).normal(size=len(d)) * 0.5
    w = models.mean_variance(mu, x, f, d, 2.0)
    assert w.min() >= 0 and w.sum() == pytest.approx(1)
    slope = mu - 4 * (x @ f @ x.T + np.diag(d)) @ w
    held = w > 1e-7
    assert np.ptp(slope[held]) < 1e-5 and (slope[~held] <= slope[held].max() + 1e-5).all()


def test_readouts_against_dense_matrices():
    x, f, d = covariance(3)
    s = x @ f @ x.T + np.diag(d)
    r = np.random.default_rng(4).normal(size=len(d))
    dense = -0.5 * (r @ np.linalg.solve(s, r) + np.linalg.slogdet(s)[1] + len(r) * np.log(2 * np.pi)) / len(r)
    assert models.log_likelihood(r, x, f, d) == pytest.approx(dense)
    w = r.clip(0)
    assert models.portfolio_variance(w, x, f, d) == pytest.approx(w @ s @ w)
    c = s / np.sqrt(np.outer(np.diag(s), np.diag(s)))
    assert models.mean_correlation(x, f, d) == pytest.approx((c.sum() - len(d)) / (len(d) * (len(d) - 1)))
    assert models.factor_share(x, f, d) == pytest.approx(np.trace(x @ f @ x.T) / np.trace(s))
    assert models.portfolio_variance(w * 0, x, f, d) == 0


def dense_shrinkage(r, name, halflife=250.0, fast=60.0):
    """Correlations, deviations, the intensity and the drawn covariance, pair by pair."""
    t, n = r.shape
    a, b = (np.array([0.5 ** ((t - 1 - i) / h) for i in range(t)]) for h in (halflife, fast))
    z = np.where(np.isnan(r), 0, r)
    c = np.array([[(a * z[:, i] * z[:, j]).sum() / np.sqrt((a * z[:, i] ** 2).sum() * (a * z[:, j] ** 2).sum()) for j in range(n)] for i in range(n)])
    sd = np.sqrt([(b * z[:, i] ** 2).sum() / b[~np.isnan(r[:, i])].sum() for i in range(n)])
    u = np.sqrt(a)[:, None] * z / np.sqrt((a[:, None] * z**2).sum(axis=0))
    off = [(i, j) for i in range(n) for j in range(n) if i != j]
    noise = sum(((u[:, i] * u[:, j] - c[i, j] * a / a.sum()) ** 2).sum() for i, j in off)
    mean = np.mean([c[i, j] for i, j in off])
    line = u.T @ u.sum(axis=1) / np.linalg.norm(u.sum(axis=1))
    level = {"none": c, "diagonal": np.zeros((n, n)), "single-index": np.outer(line, line)}.get(name, np.full((n, n), mean))
    distance = sum((c[i, j] - level[i, j]) ** 2 for i, j in off)
    k = 0.0 if name == "none" else min(1, noise / distance)
    both = np.outer(sd, sd)
    target = np.full((n, n), np.mean([(c * both)[i, j] for i, j in off])) if name == "common-covariance" else level * both
    np.fill_diagonal(target, np.mean(sd**2) if name == "common-covariance" else sd**2)
    return k, (1 - k) * c * both + k * target


@pytest.mark.parametrize("name", models.TARGETS)
@pytest.mark.parametrize("shape", [(60, 9), (25, 70)])
def test_shrinkage_against_dense_matrices(name, shape):
    rng = np.random.default_rng(5)
    r = rng.normal(size=shape) * rng.uniform(0.5, 2, shape[1]) + rng.normal(size=(shape[0], 1))
    r[:5, 2] = np.nan
    x, f, d, intensity = models.shrunk_covariance(r, name, 4)
    k, full = dense_shrinkage(r, name)
    values = np.linalg.eigvalsh(full)[::-1][:4]
    assert intensity == pytest.approx(k) and f == pytest.approx(values) and (intensity == 0) == (name == "none")
    assert np.diag(x @ np.diag(f) @ x.T) + d == pytest.approx(np.diag(full)) and x.T @ x == pytest.approx(np.eye(4), abs=1e-9)
    assert full @ x == pytest.approx(x * f, abs=1e-7)


def test_shrinkage_without_returns():
    r = np.full((5, 3), np.nan)
    assert np.isnan(models.shrunk_covariance(r, "diagonal", 2)[2]).all()
    r[:, 1] = [0.1, -0.1, 0.2, 0.0, 0.1]
    x, f, d, k = models.shrunk_covariance(r, "constant-correlation", 2)
    assert np.isnan(d[[0, 2]]).all() and f[1] == 0 and (x[1, 0] ** 2 * f[0] + d[1]) > 0


def slow_chips(price, turn, window, i):
    """All ten columns at tick i, chip by chip."""
    chips = []  # [cost, weight]
    for k in range(i - window + 1, i + 1):
        t = min(max(turn[k], 0.0), 1.0) if math.isfinite(turn[k]) else 0.0
        chips = [[c, w * (1 - t)] for c, w in chips]
        if t > 0 and math.isfinite(price[k]) and price[k] > 0:
            chips.append([price[k], t])
    total = sum(w for _, w in chips)
    if not math.isfinite(price[i]) or price[i] <= 0 or total <= 0:
        return [math.nan] * 10
    each = [(price[i] / c - 1, w / total) for c, w in chips if w > 0]
    mean = sum(r * w for r, w in each)
    m2, m3, m4 = (sum((r - mean) ** k * w for r, w in each) for k in (2, 3, 4))
    shape = [m2**0.5, m3 / m2**1.5, m4 / m2**2] if m2 > 1e-12 else [0.0, math.nan, math.nan]
    bins = [0.0] * 50
    for r, w in each:
        bins[min(49, max(0, math.floor((r + 0.5) / 0.02)))] += w
    mode = -0.5 + (bins.index(max(bins)) + 0.5) * 0.02
    of = lambda fits: sum(w for r, w in each if fits(r))
    return [mean, *shape, mode, of(lambda r: -0.02 <= r <= 0.02), of(lambda r: r > 0.1), of(lambda r: 0.02 < r <= 0.1), of(lambda r: -0.1 <= r < -0.02), of(lambda r: r < -0.1)]


def test_chips_against_a_loop():
    ticks, window = 300, 60
    for lane in range(3):
        rng = np.random.default_rng(lane)
        price, turn = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, ticks))), rng.uniform(0, 0.1, ticks)
        i = np.arange(ticks)
        price[(i + 7 * lane) % 37 == 0], turn[(i + 11 * lane) % 53 == 0], turn[(i + 13 * lane) % 29 == 0] = np.nan, np.nan, 0.0
        if lane == 0:
            turn[150], turn[170] = 1.0, 2.5
        got = distribution(price, turn, window)
        assert np.isnan(got[: window - 1]).all() and len(COLUMNS) == 10
        for k in range(window - 1, ticks):
            assert got[k] == pytest.approx(slow_chips(price, turn, window, k), abs=1e-9, nan_ok=True)


def test_chips_by_hand():
    # half the chips cost 8 and half 12, as the close is 10 on a day without turnover
    got = dict(zip(COLUMNS, distribution(np.array([8.0, 12.0, 10.0]), np.array([1.0, 0.5, 0.0]), 3)[2], strict=True))
    up, down = 10 / 8 - 1, 10 / 12 - 1
    assert got["ret_avg"] == pytest.approx((up + down) / 2) and got["ret_std"] == pytest.approx((up - down) / 2)
    assert got["profit_l"] == got["loss_l"] == pytest.approx(0.5) and got["bal"] == got["profit_s"] == got["loss_s"] == 0
    # on the edges: 10 % of the cost is small, and the day's own chip is balanced
    got = distribution(np.array([10.0, 11.0]), np.array([1.0, 0.0]), 2)[1]
    assert got[COLUMNS.index("profit_s" if 11.0 / 10.0 - 1 <= 0.1 else "profit_l")] == 1
    assert distribution(np.array([5.0, 10.0]), np.array([0.3, 1.0]), 2)[1].tolist()[:2] == [0.0, 0.0]


def test_simulation_by_hand():
    nan = np.nan
    close = np.array([[10.0, 20.0], [10.0, nan], [12.0, 20.0], [12.0, 20.0]])
    quote = close.copy()
    none = np.full((4, 2), nan)
    cash = none.copy()
    cash[2, 0] = 1.0
    nav, money = simulate(quote, quote, close, np.ones((4, 2), bool), none, cash, {0: np.array([0.5, 0.5])}, 1000.0)
    # the second asset has no quote on the day of the trade, and the book is not tried again
    fee = 500 * 0.0005
    assert money[1] == pytest.approx(500 - fee) and nav[1] == pytest.approx(1000 - fee)
    assert money[2] == pytest.approx(550 - fee) and nav[2] == pytest.approx(550 - fee + 600)


def test_visible_text():
    assert text_of("<p>a <b>b</b></p><script>x()</script><div>c &amp; d<br>e</div>") == "a b\n\nc & d\ne"
    assert text_of(None) is None and text_of("") == ""
    assert text_of("<table><tr><td>a</td><td>b</td></tr></table>") == "ab"
    assert text_of("x<style>p {}</style>y</style>z<template><p>no</template>w") == "xyz\nw"
    assert text_of("a\t \tb<p> \n \n <p>c<!-- no -->d") == "a b\n\ncd"
    assert text_of("one<![x]two").startswith("one")  # whatever the parser makes of it, no error


def test_references_cut_short():
    page = "<title>a &amp; b&amp</title><p title='&amp'>c &am<br>d &#38 &#38; \ue000 & e"
    assert text_of(page, closed=True) == "a & b&amp\nc &am\nd &#38 & \ue000 & e"
    assert text_of("<p>b&amp</p>") == "b&" and text_of(None, closed=True) is None


def test_projection_onto_the_simplex():
    v = np.array([0.3, -1.0, 2.0])
    w = models.onto_simplex(v)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w == pytest.approx([0, 0, 1])
