"""Trading simulation: target books turned into positions, cash and net asset value, tick by tick."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..semantics import BUY_FEE, MIN_FEE, SELL_FEE, START_CASH
from ..session import settled


def simulate(bid: np.ndarray, ask: np.ndarray, close: np.ndarray, listed: np.ndarray, share: np.ndarray, cash_div: np.ndarray, targets: dict[int, np.ndarray], start_cash: float = START_CASH) -> tuple[np.ndarray, np.ndarray]:
    """NAV and cash at each tick. Arrays are [tick, asset]; NaN for no quote, no close, no event; targets by the tick at which they are known.

    On each tick: dividends (bonus shares, then cash a share held before them); the book known since an earlier tick is
    traded, sells before buys, each at its side's quote or not at all, buys scaled to the cash there is; then holdings
    are marked at the last close, and at zero once delisted. Shares may be fractions.
    """
    ticks, n = close.shape
    held, cash, mark = np.zeros(n), start_cash, np.zeros(n)
    nav, money = np.zeros(ticks), np.zeros(ticks)
    waiting = None
    fee = lambda amount, rate: np.where(amount > 0, np.maximum(MIN_FEE, rate * amount), 0.0)
    for t in range(ticks):
        paid = np.nan_to_num(cash_div[t])
        cash += float(held @ paid)
        held = held * (1 + np.nan_to_num(share[t]))
        if waiting is not None:
            price = np.where(np.isfinite(close[t]), close[t], mark)
            want = np.divide(waiting * (cash + held @ price), price, out=np.zeros(n), where=price > 0)
            change = want - held
            sell = np.where((change < 0) & np.isfinite(bid[t]), -change, 0.0)
            got = sell * np.nan_to_num(bid[t])
            cash += float((got - fee(got, SELL_FEE)).sum())
            held = held - sell
            buy = np.where((change > 0) & np.isfinite(ask[t]), change, 0.0)
            cost = buy * np.nan_to_num(ask[t])
            need = float((cost + fee(cost, BUY_FEE)).sum())
            part = min(1.0, cash / need) if need > 0 else 0.0
            held = held + buy * part
            cash -= need * part
            waiting = None
        mark = np.where(listed[t], np.where(np.isfinite(close[t]), close[t], mark), 0.0)
        nav[t], money[t] = cash + float(held @ mark), cash
        if t in targets:
            waiting = targets[t]
    return nav, money


FIELDS = ("bid", "ask", "close", "listed", "share", "cash")


def backtest(quoted: DataFrame, books: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """(label, date, nav, cash): each label's books over the quoted market. quoted: one row a symbol and tick; books: (label, t, symbol, weight).

    A path depends on all before it, so a label is one task. It gets the ticks of the symbols that its books hold, one
    row of arrays a symbol; others are never held and change nothing. ticks: (t, date) of the market, where known.
    """
    books = settled(books.select(F.concat("label", F.lit("")).alias("label"), "t", "symbol", "weight"))
    held = books.select("label", "symbol").distinct()
    days = (quoted if ticks is None else ticks).select("t", "date").distinct()
    rows = quoted.select("symbol", "t", *FIELDS).join(held.select("symbol").distinct(), "symbol", "left_semi")
    rows = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("t", *FIELDS))).alias("s")).select("symbol", *(F.col(f"s.{c}").alias(c) for c in ("t", *FIELDS)))
    # the calendar, as a symbol of no number, so that a label whose symbols are not quoted has its dates too
    calendar = days.agg(F.sort_array(F.collect_list(F.struct("t", "date"))).alias("s")).select(F.col("s.t").cast("array<long>").alias("t"), F.transform("s.date", F.unix_date).alias("days"))
    labels = held.select("label").distinct()
    market = rows.join(held, "symbol").withColumn("days", F.lit(None).cast("array<int>")).withColumn("t", F.col("t").cast("array<long>"))
    market = market.unionByName(labels.crossJoin(F.broadcast(calendar)), allowMissingColumns=True).select("label", "symbol", "t", "days", *FIELDS)

    def one(key: tuple, market: pa.Table, own: pa.Table) -> pa.Table:
        is_calendar = market.column("days").is_valid()
        calendar, market = market.filter(is_calendar), market.filter(pc.invert(is_calendar))
        at = calendar.column("t").combine_chunks().flatten().to_numpy()
        dates = calendar.column("days").combine_chunks().flatten().cast(pa.int32()).cast(pa.date32())
        symbols = market.column("symbol").to_numpy()
        place = np.searchsorted(at, market.column("t").combine_chunks().flatten().to_numpy())
        row = np.repeat(np.arange(len(symbols)), pc.list_value_length(market.column("t")).to_numpy())

        def grid(name: str, kind=float) -> np.ndarray:
            out = np.full((len(at), len(symbols)), np.nan if kind is float else False, kind)
            out[place, row] = market.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            return out

        index, targets = {s: i for i, s in enumerate(symbols.tolist())}, {}
        for t, s, w in zip(*(own.column(c).to_pylist() for c in ("t", "symbol", "weight")), strict=True):
            k = int(np.searchsorted(at, t))
            if k < len(at) and at[k] == t:
                target = targets.setdefault(k, np.zeros(len(symbols)))
                if s in index:
                    target[index[s]] = 0.0 if w is None else w
        nav, cash = simulate(*(grid(c, bool if c == "listed" else float) for c in FIELDS), targets)
        return pa.table({"label": pa.array([key[0].as_py()] * len(at), pa.string()), "date": dates, "nav": nav, "cash": cash})

    own = books.select(F.col("label").alias("book"), "t", "symbol", "weight")
    return market.groupBy("label").cogroup(own.groupBy("book")).applyInArrow(one, "label string, date date, nav double, cash double")
