"""What models move between tasks."""

from __future__ import annotations

from tidegrid import queries
from tidegrid.sources import market


def test_a_bar_moves_with_its_rows_alone(spark, sf):
    p = market.factor_panel(spark, sf).select("t", "symbol", "returns")._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in p and "min_by" not in p


def test_a_tick_goes_to_three_tasks():
    step = queries.TICKS_HELD * queries.REBALANCES_A_TASK
    assert (queries.WINDOW_OF_MODEL + step) / step < 3
