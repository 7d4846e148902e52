"""The fixture market as DuckDB SQL, written on its own: what the queries over it are held against."""

from __future__ import annotations

from ..catalogs import ADV_WINDOWS

SYMBOLS = "SELECT s_suppkey AS symbol, s_name AS name, CASE WHEN r_regionkey = 0 THEN '' ELSE r_name END AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

PRICES = """SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS symbol,
arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY ALL"""

DENSE = f"""SELECT d.date, y.symbol, d.t, y.industry, p.open, p.high, p.low, p.close, p.volume, p.amount
FROM ({SYMBOLS}) y CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM ({PRICES}))) d
LEFT JOIN ({PRICES}) p ON p.date = d.date AND p.symbol = y.symbol"""

MARKET = f"""SELECT * EXCLUDE (p0, f), exp(coalesce(sum(f) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 0)) AS mult FROM (
SELECT *, CASE WHEN cash IS NOT NULL AND p0 > cash THEN ln(p0 * (1 + share) / (p0 - cash)) END AS f FROM (
SELECT *, circulating * 1.25 AS total, CASE WHEN ev THEN close * 0.01 END AS cash, CASE WHEN ev THEN CASE WHEN (symbol + t) % 52 = 0 THEN 0.1 ELSE 0.0 END END AS share,
last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p0 FROM (
SELECT *, CAST((10000 + (symbol * 7919) % 9000) * CASE WHEN t > floor(max(t) OVER (PARTITION BY symbol) / 2) AND symbol % 7 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS circulating,
close IS NOT NULL AND (symbol + t) % 26 = 0 AS ev FROM ({DENSE}))))"""

_ADV = ", ".join(f"CASE WHEN t >= {d} THEN avg(amount) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW) END AS adv{d}" for d in ADV_WINDOWS)

PANEL = f"""SELECT * EXCLUDE (r, w), sum(CASE WHEN r IS NOT NULL AND w > 0 THEN w * r END) OVER (PARTITION BY date) / nullif(sum(CASE WHEN r IS NOT NULL AND w > 0 THEN w END) OVER (PARTITION BY date), 0) AS mkt FROM (
SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY t), 0) - 1 AS returns, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY t) AS r,
lag(raw_close * circulating) OVER (PARTITION BY symbol ORDER BY t) AS w, {_ADV} FROM (
SELECT date, symbol, t, industry, amount, cash, share, mult, total, circulating, close AS raw_close, close * total AS cap, volume / circulating AS turn, 2 * (high - low) - abs(open - close) AS path,
open * mult AS open, high * mult AS high, low * mult AS low, close * mult AS close, volume / mult AS volume, amount / nullif(volume, 0) * mult AS vwap FROM ({MARKET})))"""
