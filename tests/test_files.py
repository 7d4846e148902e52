"""Panels and reports that are written and read again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import cross_section
from tidegrid.plans.expression import evaluate, near_ties
from tidegrid.sources import files


def days(df):
    return df.withColumn("date", F.col("date").cast("date"))


def test_histories_of_many_files(spark, tmp_path):
    (tmp_path / "AB.daily_prices.csv").write_text("date,close,volume\n2024-01-02,1.5,10\n2024-01-03,,20\n")
    (tmp_path / "C D.daily_prices.csv").write_text("date,close,volume\n2024-01-02,2.5,30\n")
    (tmp_path / "AB.dividends.csv").write_text("date,cash\n2024-01-02,1\n")
    got = sorted((str(r.date), r.symbol, r.close, r.volume) for r in files.read_histories(spark, str(tmp_path), "daily_prices").collect())
    assert got == [("2024-01-02", "AB", 1.5, 10), ("2024-01-02", "C D", 2.5, 30), ("2024-01-03", "AB", None, 20)]
    (tmp_path / "X.daily_prices.csv").write_text("date,close,volume\n,2.5,30\n")
    with pytest.raises(ValueError):
        files.read_histories(spark, str(tmp_path), "daily_prices")


def test_symbol_lists(spark, tmp_path):
    path = tmp_path / "symbols.csv"
    path.write_text("symbol,name,industry\nB,Bee,\nA,Ay,Mining\n")
    assert [tuple(r) for r in files.read_symbols(spark, str(path)).collect()] == [("A", "Ay", "Mining"), ("B", "Bee", "")]
    for more in ("A,Again,x\n", ",None,x\n"):
        path.write_text("symbol,name,industry\nA,Ay,Mining\n" + more)
        with pytest.raises(ValueError):
            files.read_symbols(spark, str(path))


def test_panels_side_by_side(spark, tmp_path):
    prices = spark.createDataFrame([("2024-01-01", "A", 1.0, True), ("2024-01-02", "A", 2.0, False), ("2024-01-04", "B", 3.0, True), ("2024-01-04", "Z", 9.0, True)], "date string, symbol string, close double, open_day boolean")
    shares = spark.createDataFrame([("2023-06-01", "A", 10.0), ("2024-01-03", "A", 20.0), ("2024-01-02", "B", 5.0)], "date string, symbol string, total double")
    files.write_panel(days(prices), f"{tmp_path}/daily_prices.parquet")
    files.write_panel(days(shares), f"{tmp_path}/equity_structures.parquet")
    symbols = spark.createDataFrame([("A", "a", "x"), ("B", "b", "")], "symbol string, name string, industry string")
    out = files.market_panels(spark, str(tmp_path), symbols, start="2024-01-01", end="2025-01-01")
    got = {(str(r["date"]), r["symbol"]): (r["prices.close"], r["shares.total"]) for r in out.collect()}
    assert got == {("2024-01-01", "A"): (1.0, 10.0), ("2024-01-02", "A"): (2.0, 10.0), ("2024-01-04", "A"): (None, 20.0), ("2024-01-01", "B"): (None, None), ("2024-01-02", "B"): (None, 5.0), ("2024-01-04", "B"): (3.0, 5.0)}
    near = files.read_panel(spark, f"{tmp_path}/equity_structures.parquet", prefix="shares", start="2024-01-03", carry_in=True)
    assert {(r["symbol"], r["shares.total"]) for r in near.collect()} == {("A", 20.0), ("B", 5.0)}


def test_weights_are_in_order(spark, tmp_path):
    books = spark.createDataFrame([("2024-01-02", "A", 0.2), ("2024-01-02", "B", 0.7), ("2024-01-01", "C", 0.05), ("2024-01-01", "D", 1e-12)], "date string, symbol string, weight double")
    files.write_weights(books, f"{tmp_path}/w")
    text = "".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*"))).replace("date,symbol,weight\n", "")
    assert text == "2024-01-01,C,0.05\n2024-01-02,B,0.7\n2024-01-02,A,0.2\n"


def test_risk_model_statistics(spark):
    rng = np.random.default_rng(3)
    rows = [("m", float(rng.normal()), float(rng.normal() / 50), float(rng.uniform(0.5, 2) / 2500), 0.1, 0.5, 8.0, 0.0) for _ in range(40)]
    rows += [("m", float("nan"), None, 1.0, None, None, None, None), ("m", 1.0, 0.1, 0.0, 0.1, 0.5, 8.0, 0.0), ("few", 1.0, 0.1, 0.1, 0.1, 0.5, 8.0, 0.0)]
    scores = spark.createDataFrame(rows, "label string, log_likelihood double, period_return double, portfolio_variance double, mean_correlation double, factor_share double, breadth double, short_share double")
    got = {r.label: r for r in cross_section.risk_model_statistics(scores).collect()}
    r, v = np.array([x[2] for x in rows[:40]]), np.array([x[3] for x in rows[:40]])
    m = got["m"]
    assert m.days == 40 and m.realized_vol == pytest.approx(r.std(ddof=1) * 252**0.5) and m.predicted_vol == pytest.approx(np.sqrt(v).mean() * 252**0.5)
    assert m.bias_ratio == pytest.approx((r / np.sqrt(v)).std(ddof=1)) and m.log_likelihood == pytest.approx(np.mean([x[1] for x in rows[:40]] + [1.0]))
    assert got["few"].days == 1 and got["few"].realized_vol is None and got["few"].breadth == 8


def test_annualized_turnover(spark):
    curve = spark.createDataFrame([("a", i, 2.0 * i) for i in range(21)] + [("b", i, 1.0) for i in range(9)], "label string, date int, total double")
    got = {r.label: (r.n, r.turnover) for r in cross_section.annualized_turnover(curve).collect()}
    assert got == {"a": (21, pytest.approx(40 / (21 / 252))), "b": (9, None)}


def test_values_are_compared_exactly(spark):
    df = spark.createDataFrame([("2024-01-01", 1, i, x, 1.0) for i, x in ((1, 1.0), (2, 1.0 + 1e-9), (3, 1.0 - 1e-9))], "date string, t long, symbol long, a double, b double")
    own = {"above": "(1 if a > b else 0)", "least": "(1 if a <= b else 0)", "rank": "rank(a)"}
    exact = {r.symbol: (r.above, r.least, r["rank"]) for r in evaluate(days(df), own).collect()}
    assert exact == {1: (0, 1, 0.5), 2: (1, 0, 1.0), 3: (0, 1, 0.0)}
    with near_ties():
        near = {r.symbol: (r.above, r.least, r["rank"]) for r in evaluate(days(df), own).collect()}
    assert near == {i: (0, 1, 0.5) for i in (1, 2, 3)}


def test_parts_above_and_below_zero(spark):
    df = spark.createDataFrame([("2024-01-01", 1, i, x) for i, x in ((1, 2.0), (2, -3.0), (3, None), (4, 0.0))], "date string, t long, symbol long, a double")
    got = {r.symbol: (r.up, r.down) for r in evaluate(days(df), {"up": "positive(a) + 0", "down": "negative(a) + 0"}).collect()}
    assert got == {1: (2, 0), 2: (0, -3), 3: (None, None), 4: (0, 0)}
