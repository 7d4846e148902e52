"""A plan's nodes in numpy: the ticks of a symbol, or the symbols of a date, as arrays.

Spark sums each row's frame of a sliding window anew, one function call a value, and sorts a date twice for each rank. Here the
windows of all rows are merged from shorter ones. What the nodes mean is written in expression.py as SQL; a missing value is NaN here, so NaN
counts as missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..semantics import CONSTANT, MIN_PAIRS

#: Values of the windows that are sorted together; rows of symbols that are looked at together, at least.
BLOCK, ROWS = 1 << 18, 1 << 14
#: Factor and noise of ties, as numbers (see semantics.TIE_SPLIT and NOISE).
SPLIT, SMALL = 1073741825.0, 1e-12


def tied(x, near: bool):
    if not near:
        return x
    return np.where(np.abs(x) < SMALL, 0.0, x * SPLIT - (x * SPLIT - x))


# -- ticks: rows of several symbols, one symbol after the other, each in order of time --------------------------------


class Ticks:
    """place: the number of each row within its symbol, from 1; t: its tick. A window holds the last d rows of a symbol."""

    def __init__(self, place: np.ndarray, t: np.ndarray, near: bool = False):
        self.place, self.t, self.near = place, t, near
        self._early: dict[int, np.ndarray] = {}
        self._known: dict = {}

    def back(self, x: np.ndarray, k: int, none: float = np.nan) -> np.ndarray:
        """The value k rows before; `none` where the symbol has no such row."""
        if k == 0:
            return x
        if k >= len(x):
            return np.full(len(x), none)
        if k not in self._early:
            self._early[k] = np.flatnonzero(self.place <= k)
        out = np.empty_like(x)
        out[k:] = x[:-k]
        out[self._early[k]] = none
        return out

    def over(self, d: int, state: tuple, merge, none: float) -> tuple:
        """The merged states of each window: of its newest rows with those before them, by powers of two."""
        out, held, size = None, 0, 1
        while True:
            if d & size:
                out = state if out is None else merge(out, tuple(self.back(x, held, none) for x in state))
                held += size
            if held == d:
                return out
            state = merge(state, tuple(self.back(x, size, none) for x in state))
            size *= 2

    def sums(self, x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the values there are."""
        have = ~np.isnan(x)
        return self.over(d, (have.astype(float), np.where(have, x, 0.0)), lambda a, b: (a[0] + b[0], a[1] + b[1]), 0.0)

    def extreme(self, x: np.ndarray, d: int, f) -> np.ndarray:
        return self.over(d, (x,), lambda a, b: (f(a[0], b[0]),), np.nan)[0]

    def moments(self, d: int, *series: np.ndarray) -> tuple[np.ndarray, list, dict]:
        """Of the rows that have all series: their number, the means, and the summed products of deviations. Deviations of equal values are zero, exactly."""
        m = range(len(series))
        pairs = [(i, j) for i in m for j in m if i <= j]
        have = ~np.isnan(sum(series))

        def merge(a, b):
            n = a[0] + b[0]
            share = b[0] / np.maximum(n, 1.0)
            apart = [b[1 + i] - a[1 + i] for i in m]
            weight = a[0] * share
            means = [a[1 + i] + apart[i] * share for i in m]
            return (n, *means, *(a[k] + b[k] + apart[i] * apart[j] * weight for k, (i, j) in enumerate(pairs, 1 + len(series))))

        zero = np.zeros(len(have))
        found = self.over(d, (have.astype(float), *(np.where(have, x, 0.0) for x in series), *(zero for _ in pairs)), merge, 0.0)
        return found[0], list(found[1 : 1 + len(series)]), dict(zip(pairs, found[1 + len(series) :], strict=True))

    def variance(self, x: np.ndarray, d: int) -> np.ndarray:
        n, _, c = self.moments(d, x)
        return np.where(n >= MIN_PAIRS, c[0, 0] / (n - 1), np.nan)

    def covariance(self, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
        n, _, c = self.moments(d, x, y)
        return np.where(n >= MIN_PAIRS, c[0, 1] / (n - 1), np.nan)

    def correlation(self, x: np.ndarray, y: np.ndarray, d: int) -> np.ndarray:
        n, mean, c = self.moments(d, x, y)
        one, two = (np.sqrt(c[i, i] / (n - 1)) for i in (0, 1))
        fine = (n >= MIN_PAIRS) & (one > CONSTANT * np.abs(mean[0])) & (two > CONSTANT * np.abs(mean[1]))
        return np.where(fine, c[0, 1] / (n - 1) / (one * two), np.nan)

    def line(self, x: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Slope of x over t, and what the newest x is from the line."""
        n, mean, c = self.moments(d, x, self.t)
        slope = np.where(n >= MIN_PAIRS, c[0, 1] / c[1, 1], np.nan)
        return slope, x - (mean[0] + slope * (self.t - mean[1]))

    def oldest(self, x: np.ndarray, d: int, largest: bool) -> np.ndarray:
        """The tick of the extreme value, the oldest of equal ones."""
        best = x.copy() if largest else -x
        own, at = best.copy(), np.where(np.isnan(x), np.nan, self.t)
        for k in range(1, d):
            older = self.back(own, k)
            better = (older >= best) | (np.isnan(best) & ~np.isnan(older))
            np.copyto(best, older, where=better)
            np.copyto(at, self.back(self.t, k), where=better)
        return at

    def rank(self, x: np.ndarray, d: int) -> np.ndarray:
        less, equal = np.zeros(len(x)), np.ones(len(x))
        for k in range(1, d):
            older = self.back(x, k)
            less += older < x
            equal += older == x
        return np.where(np.isnan(x), np.nan, (less + (equal + 1) / 2) / self.sums(x, d)[0])

    def ordered(self, x: np.ndarray, d: int) -> np.ndarray:
        """The values of each window in order, missing ones last."""
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(d - 1, np.nan), x)), d)
        inside, step = np.arange(d - 1, -1, -1), max(1, BLOCK // d)
        return np.concatenate([np.sort(np.where(self.place[k : k + step, None] > inside, rows[k : k + step], np.nan), axis=1) for k in range(0, len(x), step)])

    def quantile(self, ordered: np.ndarray, q: float) -> np.ndarray:
        last = np.maximum((~np.isnan(ordered)).sum(axis=1) - 1, 0)
        place = last * q
        low = np.floor(place)
        a, b = (ordered[np.arange(len(ordered)), np.minimum(k, last).astype(np.int64)] for k in (low, low + 1))
        return np.where(a == b, a, (low + 1 - place) * a + (place - low) * b)

    def decay(self, x: np.ndarray, d: int) -> np.ndarray:
        have, weights, total = ~np.isnan(x), np.zeros(len(x)), np.zeros(len(x))
        filled = np.where(have, x, 0.0)
        there = have.astype(float)
        for k in range(d):
            w = (self.back(self.t, k, 0.0) - self.t + d) * self.back(there, k, 0.0)
            weights += w
            total += w * self.back(filled, k, 0.0)
        return total / np.where(weights == 0, np.nan, weights)

    def value(self, n, args: list[np.ndarray]) -> np.ndarray:
        """A time-series node over these values of its arguments."""
        x = args[0]
        d = int(n.args[2 if n.op in ("corr", "cov") else 1].value)
        match n.op:
            case "delay":
                return self.back(x, d)
            case "delta":
                return x - self.back(x, d)
            case "ts_sum" | "ts_mean":
                number, total = self.sums(x, d)
                out = np.where(number > 0, total if n.op == "ts_sum" else total / number, np.nan)
            case "ts_min" | "ts_max":
                out = self.extreme(x, d, np.fmin if n.op == "ts_min" else np.fmax)
            case "ts_count":
                out = self.sums(x, d)[0]
            case "ts_var":
                out = self.variance(x, d)
            case "ts_std":
                out = np.sqrt(self.variance(x, d))
            case "ts_argmax" | "ts_argmin":
                out = self.oldest(tied(x, self.near), d, n.op == "ts_argmax") - self.t + d
            case "ts_rank":
                out = self.rank(tied(x, self.near), d)
            case "ts_quantile":
                key = (n.args[0], d)
                if key not in self._known:
                    self._known[key] = self.ordered(x, d)
                out = self.quantile(self._known[key], n.args[2].value)
            case "ts_slope":
                out = self.line(x, d)[0]
            case "ts_resi":
                out = self.line(x, d)[1]
            case "ts_rsquare":
                out = self.correlation(x, self.t, d) ** 2
            case "decay":
                out = self.decay(x, d)
            case "corr":
                out = self.correlation(x, args[1], d)
            case "cov":
                out = self.covariance(x, args[1], d)
            case _:
                raise AssertionError(n.op)
        return np.where(self.t >= d, out, np.nan)


# -- a date ------------------------------------------------------------------------------------------------------------


def ranks(x: np.ndarray, near: bool) -> np.ndarray:
    """Percentile in 0..1 by average rank; 0.5 for a lone value."""
    out, have = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    _, group, size = np.unique(tied(x[have], near), return_inverse=True, return_counts=True)
    average = np.cumsum(size) - size + (size + 1) / 2
    out[have] = (average[group] - 1) / (len(have) - 1) if len(have) > 1 else 0.5
    return out


def over_date(op: str, x: np.ndarray, groups: np.ndarray | None, near: bool) -> np.ndarray:
    have = ~np.isnan(x)
    match op:
        case "rank":
            return ranks(x, near)
        case "scale":
            total = np.abs(x[have]).sum()
            return x / (total if total else np.nan)
        case "demean":
            return x - (x[have].mean() if have.any() else np.nan)
        case "neutralize":
            assert groups is not None
            n, total = (np.bincount(groups[have], w, groups.max(initial=0) + 1) for w in (None, x[have]))
            return x - (total / n)[groups]
    raise AssertionError(op)


# -- single values -----------------------------------------------------------------------------------------------------


def single(op: str, a: list, near: bool):
    """A condition is true or not; one on a missing value is not."""
    match op:
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return a[0] / np.where(np.equal(a[1], 0), np.nan, a[1])
        case "<" | ">" | "<=" | ">=" | "==":
            by = {"<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "==": np.equal}[op]
            return by(tied(a[0], near), tied(a[1], near))
        case "or":
            return a[0] | a[1]
        case "choose":
            return np.where(a[0], a[1], a[2])
        case "larger" | "smaller":  # a missing value is passed over
            return (np.fmax if op == "larger" else np.fmin)(a[0], a[1])
        case "positive" | "negative":
            return (np.maximum if op == "positive" else np.minimum)(a[0], 0.0)
        case "sign":
            return np.where(np.isnan(a[0]), np.nan, np.where(np.less(a[0], 0), -1.0, 1.0))
        case "abs":
            return np.abs(a[0])
        case "log":
            return np.log(np.where(np.greater(a[0], 0), a[0], np.nan))
        case "sqrt":
            return np.sqrt(np.where(np.greater_equal(a[0], 0), a[0], np.nan))
        case "power":
            x, y = np.broadcast_arrays(np.asarray(a[0], float), np.asarray(a[1], float))
            small = np.abs(y * np.log(np.abs(x))) < 690
            fine = ((x > 0) & small) | ((x == 0) & (y >= 0)) | ((x < 0) & (y == np.floor(y)) & small)
            return np.where(fine, np.power(np.where(fine, x, 1.0), np.where(fine, y, 1.0)), np.nan)
    raise AssertionError(op)


# -- a pass over symbols or dates --------------------------------------------------------------------------------------


def doubles(column) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


def codes(column) -> np.ndarray:
    """A number for each different value, missing ones alike."""
    import pandas as pd

    return pd.factorize(column if isinstance(column, np.ndarray) else column.to_pandas(), use_na_sentinel=False)[0]


def added(table: pa.Table, steps: list, held: list[str], new: list[str], near: bool) -> pa.Table:
    """The held columns of a date, or of symbols whose rows have a `place`, and the new ones of steps (name, node)."""
    size = table.num_rows
    ticks = Ticks(doubles(table.column(PLACE)), doubles(table.column("t")), near) if PLACE in table.column_names else None
    have: dict[str, np.ndarray] = {}

    def full(n) -> np.ndarray:
        return np.array(np.broadcast_to(value(n), size), float)

    def value(n):
        if n.op == "const":
            return n.value
        if n.op == "field":
            if n.value not in have:
                have[n.value] = doubles(table.column(n.value))
            return have[n.value]
        if n.kind == "time":
            return ticks.value(n, [full(x) for x in n.args[: 2 if n.op in ("corr", "cov") else 1]])
        if n.kind == "cross":
            groups = None
            if n.op == "neutralize":
                by = n.args[1]
                groups = codes(table.column(by.value) if by.op == "field" and by.value in table.column_names else full(by))
            return over_date(n.op, full(n.args[0]), groups, near)
        return single(n.op, [value(x) for x in n.args], near)

    with np.errstate(all="ignore"):
        for name, node in steps:
            have[name] = full(node)
    return pa.table({c: table.column(c) for c in held} | {c: pa.array(have[c], pa.float64(), from_pandas=True) for c in new})


#: Column of the number of a row within its symbol.
PLACE = "_place"


def whole_symbols(batches, rows: int = ROWS):
    """Batches of about so many rows, none of which ends within a symbol; they come in order of symbols and places."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(batch.column(PLACE).to_numpy() == 1)
        if len(starts) and sum(b.num_rows for b in waiting) + starts[-1] >= rows:
            yield pa.Table.from_batches([*waiting, batch.slice(0, starts[-1])])
            waiting = []
            batch = batch.slice(starts[-1])
        waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)
