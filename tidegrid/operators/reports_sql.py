"""Point-in-time reports as DuckDB SQL, for comparison."""

from __future__ import annotations

from ..sources.market_sql import PANEL, PRICES
from .reports import BALANCES, FLOWS

QUARTERLY = """SELECT symbol, report_date, notice_date, CAST(year(report_date) AS INTEGER) AS year, CAST(dayofyear(report_date) AS INTEGER) AS day, revenue, profit, sold,
CASE WHEN notice_date IS NOT NULL AND notice_date <= report_date + lag THEN greatest(report_date, notice_date) ELSE report_date + lag END AS effective FROM (
SELECT symbol, report_date, CASE WHEN (symbol + qi) % 11 <> 0 THEN report_date + CAST((symbol * 37 + qi * 53) % 160 AS INTEGER) END AS notice_date, revenue, profit, sold,
CASE month(report_date) WHEN 12 THEN 121 WHEN 6 THEN 62 ELSE 31 END AS lag FROM (
SELECT symbol, CAST(q + INTERVAL 3 MONTHS AS DATE) - 1 AS report_date, year(q) * 4 + quarter(q) AS qi,
sum(r) OVER (PARTITION BY symbol, year(q) ORDER BY q) AS revenue, sum(p) OVER (PARTITION BY symbol, year(q) ORDER BY q) AS profit, sum(r) OVER (PARTITION BY symbol ORDER BY q) AS sold FROM (
SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q, sum(l_extendedprice * (1 - l_discount)) AS r, sum(l_extendedprice * l_tax) AS p FROM lineitem GROUP BY ALL)))"""

CURRENT = f"""SELECT * EXCLUDE (seen) FROM (SELECT *, max(report_date) OVER (PARTITION BY symbol ORDER BY effective, report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({QUARTERLY}))
WHERE seen IS NULL OR report_date > seen"""


def _rate(value: str) -> str:
    w = "(PARTITION BY symbol ORDER BY effective, report_date)"
    same = f"lag(year) OVER {w} = year"
    return f"({value} - CASE WHEN {same} THEN lag({value}) OVER {w} ELSE 0 END) / nullif(day - CASE WHEN {same} THEN lag(day) OVER {w} ELSE 0 END, 0) * 365"


RATED = f"SELECT *, {_rate('revenue')} AS r, {_rate('profit')} AS p FROM ({CURRENT})"

ON_TICK = f"""SELECT symbol, date, report_date, effective, r, p, sold FROM (
SELECT x.*, row_number() OVER (PARTITION BY symbol, date ORDER BY report_date DESC, effective DESC) AS n FROM (
SELECT q.*, (SELECT min(date) FROM (SELECT DISTINCT date FROM ({PRICES})) c WHERE c.date >= q.effective) AS date FROM ({RATED}) q) x WHERE date IS NOT NULL) WHERE n = 1"""

_HELD = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("r", "p", "sold"))
_KEYS = "date, symbol, t, industry, raw_close, total, circulating, cash"

REPORT_PANEL = f"""SELECT {_KEYS}, {", ".join(BALANCES)}, {", ".join(f"avg({c}) OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS {c}" for c in FLOWS)} FROM (
SELECT {_KEYS}, {", ".join(f"{x} AS {c}" for c, x in (FLOWS | BALANCES).items())} FROM (
SELECT {_KEYS}, {_HELD} FROM (SELECT b.*, c.r, c.p, c.sold FROM ({PANEL}) b LEFT JOIN ({ON_TICK}) c ON b.date = c.date AND b.symbol = c.symbol)))"""
