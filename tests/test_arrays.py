"""Nodes in numpy against the same nodes as Spark SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tidegrid import catalogs, queries
from tidegrid.plans import arrays, expression
from tidegrid.plans.expression import evaluate, near_ties

WINDOWS = {f"{f}{d}": f"{f}(x, {d})" for f in ("ts_sum", "ts_mean", "ts_std", "ts_var", "ts_min", "ts_max", "ts_argmin", "ts_argmax", "ts_count", "ts_rank", "ts_slope", "ts_rsquare", "ts_resi", "decay") for d in (1, 3, 7)}
OTHERS = {
    "quantile": "ts_quantile(x, 5, 0.3)", "corr": "corr(x, y, 4)", "cov": "cov(x, y, 6)", "lag": "ts_sum(delay(x, 2), 2)", "delta": "ts_mean(delta(y, 1), 3)", "rank": "rank(x)", "scale": "scale(rank(y))", "own": "neutralize(rank(x), g)",
    "demean": "demean(ts_sum(x, 2) + rank(y))", "choice": "rank(1 if x < y or x == 3 else log(y - 2))", "power": "rank(power(x - 2, y)) + sign(ts_sum(x, 3) - 9)", "least": "larger(rank(x), smaller(y, x / (y - 1)))", "both": "ts_rank(rank(corr(x, rank(y), 3)), 4)",
}


def odd_panel(spark):
    """Symbols of different lengths, late starts, gaps, equal values and a constant."""
    rng = np.random.default_rng(5)
    rows = []
    for s, (first, last) in enumerate([(1, 30), (1, 2), (4, 25), (9, 9), (1, 30), (2, 30)]):
        for t in range(first, last + 1):
            x, y = (None if rng.random() < 0.2 else float(rng.integers(1, 6)) for _ in range(2))
            rows.append((f"2024-01-{t:02d}", s, t, 3.7 if s == 4 else x, y, None if s == 2 else "ab"[s % 2]))
    df = spark.createDataFrame(rows, "date string, symbol long, t long, x double, y double, g string")
    return df.withColumn("date", df.date.cast("date"))


@pytest.mark.parametrize("near", [False, True])
def test_arrays_are_what_the_sql_is(spark, monkeypatch, near):
    def values():
        with near_ties() if near else expression.contextmanager(lambda: iter([None]))():
            out = evaluate(odd_panel(spark), WINDOWS | OTHERS)
        return {(r.symbol, r.t): r.asDict() for r in out.collect()}

    got = values()
    monkeypatch.setattr(expression, "in_arrays", lambda stages: False)
    want = values()
    assert got.keys() == want.keys()
    for k, row in want.items():
        for c, v in row.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)


@pytest.mark.parametrize("name", ["alpha101_031_040", "alpha101_071_080", "alpha101_081_090", "alpha101_091_100", "alpha158_rolling_60"])
def test_no_row_sums_its_window_anew(spark, sf, name):
    p = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in p and "corr" not in p and "covar_samp" not in p and "percentile" not in p and " rank(" not in p


def test_symbols_stay_whole():
    place = [1, 2, 3, 1, 1, 2, 1, 2, 3, 4, 5]
    batches = [pa.record_batch({arrays.PLACE: place[a:b], "k": list(range(a, b))}) for a, b in ((0, 2), (2, 6), (6, 6), (6, 9), (9, 11))]
    parts = [t.column("k").to_pylist() for t in arrays.whole_symbols(batches, 3)]
    assert sum(parts, []) == list(range(11)) and [place[p[0]] for p in parts] == [1] * len(parts) and len(parts) > 1


def test_every_catalog_factor_of_windows_goes_by_arrays():
    for x in (catalogs.alpha101(), catalogs.alpha158()):
        p = expression.plan(x)
        assert any(expression.in_arrays([p.stages[k] for k in part]) for part in expression.passes(p.stages))
