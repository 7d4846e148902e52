"""Queries against DuckDB on the smallest tables, and without SQL against what must hold."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidegrid import queries
from tidegrid.sources import market


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def table_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) if r[i] is None or not isinstance(r[i], float) else f"{r[i] + 0.0:.6g}" for i in order) for r in rows)


SOME = ["panel_prefill", "symbols_unlisted_anti", "report_superseded", "report_last_wins", "annualize_flow", "forward_adjust", "market_return", "year_growth", "ts_idxmax", "ts_rank", "ts_corr", "cs_rank", "cs_normalize", "ind_neutralize", "other_spelling", "alpha101_061_070", "alpha158_rolling_10", "pv_range_mom_M", "fund_safety", "style_prices", "quote_book", "ic_spearman", "turnover", "nav_stats", "wide_csv", "stream_daily_bars", "stream_rolling", "reversal_ic"]


@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    got = table_of([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == table_of(cursor.fetchall(), columns)


def test_models_run(spark, sf):
    weights = queries.QUERIES["gmv_weights"](spark, sf).collect()
    assert sum(r.weight for r in weights) == pytest.approx(1)
    nav = queries.QUERIES["backtest_nav"](spark, sf).collect()
    assert {r.label for r in nav} == {"top5", "top10", "top20"} and min(r.nav for r in nav) > 0
    assert queries.QUERIES["ridge_premium"](spark, sf).count() > 100


def test_risk_models_run_at_every_rebalance(spark, sf):
    import numpy as np

    from tidegrid.operators import models

    panel = market.factor_panel(spark, sf).select("t", "date", "symbol", "returns").toPandas()
    grid = panel.pivot(index="t", columns="symbol", values="returns").sort_index()
    days = panel[["t", "date"]].drop_duplicates().set_index("t")["date"]
    every = [t for t in grid.index if t % 4 == 0]
    got = queries.QUERIES["shrinkage_diagonal"](spark, sf).toPandas()
    assert sorted(got["date"].unique()) == [days[t] for t in every] and len(got) == len(every) * len(grid.columns)
    books = queries.QUERIES["gmv_books"](spark, sf).toPandas()
    assert books.groupby("date")["weight"].sum().to_numpy() == pytest.approx(np.ones(len(every)))
    scores = queries.QUERIES["risk_readouts"](spark, sf).toPandas().pivot(index="date", columns="metric", values="value")
    assert sorted(scores.index) == [days[t] for t in grid.index if t > every[0]]
    for r in (every[10], every[-2]):  # a window that is not full yet, and one that is
        x, f, d, _ = models.shrunk_covariance(grid.loc[max(1, r - 119) : r].to_numpy(float), "diagonal", 5)
        assert got[got["date"] == days[r]].sort_values("symbol")["variance"].to_numpy(float) == pytest.approx(x**2 @ f + d, nan_ok=True)
        x, f, d, _ = models.shrunk_covariance(grid.loc[max(1, r - 119) : r].to_numpy(float), "constant-correlation", 5)
        for t in range(r + 1, r + 5):
            assert scores.loc[days[t], "log_likelihood"] == pytest.approx(models.log_likelihood(grid.loc[t].to_numpy(float), x, np.diag(f), np.nan_to_num(d, nan=1.0)))


def test_ticks_go_to_few_tasks(spark):
    df = spark.range(3).selectExpr("id AS symbol", "explode(sequence(1L, 401L)) AS t").selectExpr("symbol", "t", "IF(t % 7 = symbol, NULL, CAST(t * 10 + symbol AS DOUBLE)) AS x")

    def solve(symbols, ticks, x, n):
        assert list(symbols) == [0, 1, 2] and x.shape == (len(ticks), 3)
        assert all((v != v) if t % 7 == s else v == t * 10 + s for t, row in zip(ticks, x, strict=True) for s, v in zip(symbols, row, strict=True))
        return {"t": [ticks[n - 1]], "first": ticks[0], "last": ticks[-1]}

    found = queries._of_windows(df, ["x"], solve, "t long, first long, last long")
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(r, max(1, r - 119), min(401, r + 4)) for r in range(4, 402, 4)]
    newest = queries._of_windows(df, ["x"], solve, "t long, first long, last long", newest=True)
    assert [tuple(r) for r in newest.collect()] == [(400, 282, 401)]
    # 13 tasks of 8 rebalances get at most 155 ticks each, where 100 windows of up to 124 were sent before
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "slice" in plan


def test_books_need_only_the_ticks_of_what_they_hold(spark):
    from tidegrid.operators import simulator

    quoted = spark.range(50).selectExpr("id AS symbol", "explode(sequence(1L, 6L)) AS t").selectExpr("symbol", "t", "date_add(DATE '2024-01-01', CAST(t AS INT)) AS date", "IF(symbol = 1 AND t = 3, NULL, 10D + symbol + t) AS bid", "11D + symbol + t AS ask", "10.5D + symbol + t AS close", "true AS listed", "IF(t = 5, 0.1D, NULL) AS share", "CAST(NULL AS DOUBLE) AS cash")
    own = spark.createDataFrame([("a", 2, 1, 0.5), ("a", 2, 2, 0.5), ("a", 4, 7, 1.0), ("b", 1, 99, 1.0), ("b", 40, 1, 1.0)], "label string, t long, symbol long, weight double")
    got = simulator.backtest(quoted, own)
    few = simulator.backtest(quoted.filter("symbol IN (1, 2, 7)"), own, quoted.select("t", "date").distinct())
    rows = {(r.label, str(r.date)): (r.nav, r.cash) for r in got.collect()}
    assert rows == {(r.label, str(r.date)): (r.nav, r.cash) for r in few.collect()} and len(rows) == 12
    assert rows["b", "2024-01-07"] == (1e6, 1e6) and rows["a", "2024-01-07"][1] < 1e6 * 0.6


def test_streams_end_in_files(spark, tmp_path):
    from tidegrid.streaming import bars

    df = spark.range(500).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id * 7 % 500 AS INT)) AS ts", "id % 3 AS user_id", "concat('e', id % 2) AS event_type", "CAST(id * id % 31 AS DOUBLE) AS value")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = bars.run_to_end(bars.sessions(bars.events(spark, str(tmp_path))), "complete")
    assert got.inputFiles()  # not rows in the driver's memory
    assert {r.user_id: r.n for r in got.collect()} == {0: 167, 1: 167, 2: 166}
    for n in (1, 4, 20):
        means = {(r.key, r.event_id): r["mean"] for r in bars.run_to_end(bars.rolling_means(bars.events(spark, str(tmp_path)), n=n), "append").collect()}
        assert len(means) == 500
        for k in ("e0", "e1"):
            rows = [r for r in df.filter(df.event_type == k).orderBy("ts", "event_id").collect()]
            for i, r in enumerate(rows):
                last = [x.value for x in rows[max(0, i - n + 1) : i + 1]]
                assert means[k, r.event_id] == pytest.approx(sum(last) / len(last))


def test_prefill_and_names(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 5.0), ("2024-01-03", 1, 6.0), ("2024-01-02", 2, 7.0)], "date string, symbol long, x double")
    df = df.withColumn("date", df.date.cast("date"))
    got = {(str(r.date), r.symbol): r.x for r in market.prefilled(df, "2024-01-02", "2024-01-04").collect()}
    assert got == {("2024-01-02", 1): 5.0, ("2024-01-03", 1): 6.0, ("2024-01-02", 2): 7.0}
    assert market.field_names(["open", "prices.low", "prices"], "prices") == {"open": "prices.open", "prices.low": "prices.low", "prices": "prices"}
    with pytest.raises(ValueError):
        market.field_names(["open", "prices.open"], "prices")


def test_entry_points():
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(names) > 100
