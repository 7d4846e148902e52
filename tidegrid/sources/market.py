"""Market panels: long Parquet tables put onto one dense grid of symbols and trading dates.

The fixture market is derived from the order tables: a symbol is a supplier, a trading date a week with a shipment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window, WindowSpec

from ..catalogs import ADV_WINDOWS
from ..semantics import YEAR_DAYS
from ..session import share_package

#: The six panels of a market: file stem, prefix of its fields, whether values before the start are carried in.
PANELS = (("daily_prices", "prices", False), ("dividends", "dividends", False), ("equity_structures", "shares", True), ("balance_sheets", "balance_sheet", True), ("income_statements", "income_statement", True), ("cash_flow_statements", "cash_flow_statement", True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- general panel operators -------------------------------------------------------------------------------------------


def value_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns: the fields of a panel."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType | BooleanType)]


def field_names(columns: list[str], prefix: str) -> dict[str, str]:
    """Column to field name: the prefix is put in front where it is not there. Two columns of one name are an error."""
    out = {c: c if c == prefix or c.startswith(f"{prefix}.") else f"{prefix}.{c}" for c in columns}
    if len(set(out.values())) < len(out):
        raise ValueError(f"two columns of {prefix} have one field name")
    return out


def in_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows from start, inclusive, to end, exclusive."""
    return df.filter((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))


def prefilled(df: DataFrame, start: str, end: str, key: str = "symbol", date: str = "date") -> DataFrame:
    """in_range, and each symbol's last earlier row moved to the start, unless the symbol has a row on it."""
    first = F.lit(start).cast("date")
    rest = [c for c in df.columns if c not in (key, date)]
    earlier = df.filter(F.col(date) < first).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(date, *rest)).alias("r"))
    moved = earlier.select(first.alias(date), key, *(F.col(f"r.{c}").alias(c) for c in rest))
    inside = in_range(df, start, end, date)
    at_start = inside.filter(F.col(date) == first).select(key)
    return inside.select(date, key, *rest).unionByName(moved.join(at_start, key, "left_anti"))


def unlisted(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows whose symbol is not listed, for the report; the others are kept by listed()."""
    return df.join(symbols.select("symbol"), "symbol", "left_anti")


def listed(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return df.join(symbols.select("symbol"), "symbol", "left_semi")


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, t): the dates on which any symbol has a row, numbered from 1. One row a trading day, so one task orders it."""
    return df.select(F.col(date).alias("date")).distinct().withColumn("t", F.row_number().over(Window.orderBy("date")).cast("long"))


def rebalance_dates(spark: SparkSession, start: str, end: str, every: int) -> DataFrame:
    """Every so many calendar days from start, before end; trading days or not."""
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', date_sub(DATE '{end}', 1), INTERVAL {int(every)} DAYS)) AS date")


def dense(df: DataFrame, symbols: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """One row for each listed symbol and trading date, with t; values are null where df has no row.

    The calendar is small and sent to all executors; the grid is then symbols times dates, as the panel itself. dates:
    the calendar of df, where it is known without df's values.
    """
    grid = symbols.select("symbol", "industry").crossJoin(F.broadcast(calendar(df) if dates is None else dates))
    return grid.join(df, ["date", "symbol"], "left")


def by_symbol() -> WindowSpec:
    """A symbol's ticks in order."""
    return Window.partitionBy("symbol").orderBy("t")


def carried(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each value stays until the next one."""
    return df.withColumns({c: F.last(c, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)) for c in columns})


# -- the fixture market ------------------------------------------------------------------------------------------------


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name and industry: the supplier's region, and none for the first region."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.when(F.col("r_regionkey") == 0, "").otherwise(F.col("r_name")).alias("industry"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each supplier's unit prices, in order of shipment."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("at"), "l_quantity", "l_extendedprice",
    )
    # the first and the last row hold their prices, so that these don't move besides
    px = lambda at: at["l_extendedprice"] / at["l_quantity"]
    return rows.groupBy("date", "symbol").agg(px(F.min("at")).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), px(F.max("at")).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar of prices(), without its bars."""
    return calendar(table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date")))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense grid with bars, shares outstanding, dividend events and adjustment multipliers."""
    df = dense(prices(spark, sf_dir), symbols(spark, sf_dir), ticks(spark, sf_dir))
    # shares: known from the first week; a seventh of the symbols doubles half way
    base = F.lit(10000) + (F.col("symbol") * 7919) % 9000
    half = F.col("t") > F.floor(F.max("t").over(Window.partitionBy("symbol")) / 2)
    df = df.withColumn("circulating", (base * F.when(half & (F.col("symbol") % 7 == 0), 2).otherwise(1)).cast("double"))
    df = df.withColumn("total", F.col("circulating") * 1.25)
    event = F.col("close").isNotNull() & ((F.col("symbol") + F.col("t")) % 26 == 0)
    df = df.withColumn("cash", F.when(event, F.col("close") * 0.01)).withColumn("share", F.when(event, F.when((F.col("symbol") + F.col("t")) % 52 == 0, 0.1).otherwise(0.0)))
    return adjusted(df)


def adjusted(df: DataFrame) -> DataFrame:
    """mult: the product, over a symbol's dividend events so far, of P (1 + share) / (P - cash), with P the last close before."""
    before = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_p", before)
    factor = F.when(F.col("cash").isNotNull() & (F.col("_p") > F.col("cash")), F.col("_p") * (1 + F.col("share")) / (F.col("_p") - F.col("cash")))
    df = df.withColumn("_f", F.ln(factor))
    mult = F.exp(F.coalesce(F.sum("_f").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return df.withColumn("mult", mult).drop("_p", "_f")


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that factor expressions may name: adjusted prices and volume, returns, cap, adv*, turn, path, mkt."""
    df = market(spark, sf_dir)
    raw = F.when(F.col("volume") != 0, F.col("amount") / F.col("volume"))
    df = df.select(
        "date", "symbol", "t", "industry", "amount", "cash", "share", "mult", "total", "circulating", F.col("close").alias("raw_close"), (F.col("close") * F.col("total")).alias("cap"), (F.col("volume") / F.col("circulating")).alias("turn"),
        (2 * (F.col("high") - F.col("low")) - F.abs(F.col("open") - F.col("close"))).alias("path"), *((F.col(c) * F.col("mult")).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") / F.col("mult")).alias("volume"), (raw * F.col("mult")).alias("vwap"),
    )
    last = F.lag("close").over(by_symbol())
    adv = {f"adv{d}": F.when(F.col("t") >= d, F.avg("amount").over(by_symbol().rowsBetween(1 - d, 0))) for d in ADV_WINDOWS}
    df = df.withColumns({"returns": F.col("close") / F.nullif(last, F.lit(0.0)) - 1, "_r": F.ln("close") - F.lag(F.ln("close")).over(by_symbol()), "_w": F.lag(F.col("raw_close") * F.col("circulating")).over(by_symbol())} | adv)
    return df.withColumn("mkt", market_return(F.col("_r"), F.col("_w"))).drop("_r", "_w")


def market_return(r, w):
    """Mean of r weighted by w over the symbols of a date that have both, where w > 0; the same for all symbols."""
    day = Window.partitionBy("date")
    both = r.isNotNull() & (w > 0)
    return F.sum(F.when(both, w * r)).over(day) / F.nullif(F.sum(F.when(both, w)).over(day), F.lit(0.0))


def year_window() -> str:
    return f"PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL {YEAR_DAYS} DAYS PRECEDING AND CURRENT ROW"
