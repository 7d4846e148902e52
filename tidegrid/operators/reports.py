"""Point-in-time reports: when a report may be used, which rows are superseded, and yearly rates from running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..semantics import YEAR_DAYS
from ..sources.market import calendar, prices, table

#: Days after the period's end by which a report is out, where its notice is unknown or too late.
LAGS = {"annual": 121, "half": 62, "quarter": 31}
US_LAGS, US_ANNUAL_DAYS = {"annual": 135, "other": 50}, 300


def disclosure_lag(report_date: Column) -> Column:
    """By the month in which the period ends."""
    return F.when(F.month(report_date) == 12, LAGS["annual"]).when(F.month(report_date) == 6, LAGS["half"]).otherwise(LAGS["quarter"])


def disclosure_lag_us(start_date: Column, report_date: Column) -> Column:
    """By the period's length; a report without a start, of a state, is an annual one."""
    days = F.datediff(report_date, start_date) + 1
    return F.when(start_date.isNull() | (days > US_ANNUAL_DAYS), US_LAGS["annual"]).otherwise(US_LAGS["other"])


def effective_date(report_date: Column, notice_date: Column, lag: Column) -> Column:
    """The notice, not before the period's end, if it comes within the lag; else the end of the lag."""
    due = F.date_add(report_date, lag)
    return F.when(notice_date.isNotNull() & (notice_date <= due), F.greatest(report_date, notice_date)).otherwise(due)


def current_reports(df: DataFrame, by_key: bool = False) -> DataFrame:
    """Reports in order of (effective, report_date) without those that an earlier one supersedes.

    A report stays if its period is later than all before it, kept or not; with by_key, its (year, day) may not fall either.
    """
    before = Window.partitionBy("symbol").orderBy("effective", "report_date").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_last", F.max("report_date").over(before)).withColumn("_key", F.max(F.col("year") * 1000 + F.col("day")).over(before))
    keep = F.col("_last").isNull() | (F.col("report_date") > F.col("_last"))
    if by_key:
        keep = keep & (F.col("_key").isNull() | (F.col("year") * 1000 + F.col("day") >= F.col("_key")))
    return out.filter(keep).drop("_last", "_key")


def annualized(df: DataFrame, value: str) -> Column:
    """Yearly rate of a running total within years: its rise since the last report over the days between; from zero in a new year."""
    w = Window.partitionBy("symbol").orderBy("effective", "report_date")
    same = F.lag("year").over(w) == F.col("year")
    rise = F.col(value) - F.when(same, F.lag(value).over(w)).otherwise(0.0)
    days = F.col("day") - F.when(same, F.lag("day").over(w)).otherwise(0)
    return F.when(days != 0, rise / days * YEAR_DAYS)


def last_of_tick(df: DataFrame, ticks: DataFrame) -> DataFrame:
    """Each report on the first tick from its effective date on; of several on one tick the latest period counts."""
    # the first tick not before a date, by one pass over both in order: no join on a range
    marks = ticks.select(F.col("date").alias("d"), F.lit(1).alias("is_tick"), "date")
    days = df.select(F.col("effective").alias("d")).distinct().withColumn("is_tick", F.lit(0)).withColumn("date", F.lit(None).cast("date"))
    following = Window.orderBy("d", "is_tick").rowsBetween(0, Window.unboundedFollowing)
    placed = marks.union(days).withColumn("date", F.first("date", ignorenulls=True).over(following)).filter("is_tick = 0").select(F.col("d").alias("effective"), "date")
    on_tick = df.join(F.broadcast(placed), "effective").filter("date IS NOT NULL")
    newest = Window.partitionBy("symbol", "date").orderBy(F.desc("report_date"), F.desc("effective"))
    return on_tick.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def quarterly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's reports: each supplier's revenue and profit of the year so far at each quarter's end, with notices that may be late or missing."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_trunc("quarter", "l_shipdate").cast("date").alias("q"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), (F.col("l_extendedprice") * F.col("l_tax")).alias("p"))
    by_quarter = rows.groupBy(F.col("l_suppkey").alias("symbol"), "q").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    in_year = Window.partitionBy("symbol", F.year("q")).orderBy("q")
    all_time = Window.partitionBy("symbol").orderBy("q")
    out = by_quarter.select("symbol", "q", F.sum("r").over(in_year).alias("revenue"), F.sum("p").over(in_year).alias("profit"), F.sum("r").over(all_time).alias("sold"))
    out = out.withColumn("report_date", F.date_sub(F.add_months("q", 3), 1)).withColumn("qi", F.year("q") * 4 + F.quarter("q"))
    notice = F.when((F.col("symbol") + F.col("qi")) % 11 != 0, F.date_add("report_date", ((F.col("symbol") * 37 + F.col("qi") * 53) % 160).cast("int")))
    return out.select("symbol", "report_date", notice.alias("notice_date"), F.year("report_date").alias("year"), F.dayofyear("report_date").alias("day"), "revenue", "profit", "sold").withColumn("effective", effective_date(F.col("report_date"), F.col("notice_date"), disclosure_lag(F.col("report_date"))))


#: The fixture's report fields from the rates of revenue and profit and from sales to date, for symbol numbers k.
FLOWS = {"profit": "p", "operating": "p * (1.2 + (symbol % 5) * 0.02)", "income": "r * 1.05", "revenue": "r", "costs": "-r * (0.5 + (symbol % 9) * 0.03)", "op_cash": "p * 0.9 + r * (symbol % 4) * 0.01", "net_cash": "p * 0.3 - r * (symbol % 3) * 0.02", "capex": "-r * 0.02 * (1 + symbol % 6)", "tax_paid": "-p * 0.25"}
BALANCES = {"assets": "sold * (0.8 + (symbol % 7) * 0.1)", "debt": "sold * (0.3 + (symbol % 5) * 0.05)", "equity": "sold * (0.4 + (symbol % 11) * 0.02)", "cur_assets": "sold * 0.4", "cur_liab": "sold * (0.15 + (symbol % 3) * 0.03)", "cash_held": "sold * 0.05 * (1 + symbol % 4)", "inventories": "sold * 0.1 + 1000", "receivables": "sold * 0.12 + 500", "taxes_due": "sold * 0.01 * (1 + symbol % 3)", "noncurrent_due": "sold * 0.01", "prepayments": "sold * 0.02"}


def report_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor panel with report fields: balances carried, flows as the mean of the carried yearly rate over 365 days."""
    from ..sources.market import carried, factor_panel

    kept = current_reports(quarterly(spark, sf_dir))
    rated = kept.withColumns({"r": annualized(kept, "revenue"), "p": annualized(kept, "profit")})
    cells = last_of_tick(rated, calendar(prices(spark, sf_dir))).select("symbol", "date", "r", "p", "sold")
    df = factor_panel(spark, sf_dir).select("date", "symbol", "t", "industry", "raw_close", "total", "circulating", "cash").join(cells, ["date", "symbol"], "left")
    df = carried(df, ["r", "p", "sold"])
    df = df.selectExpr("date", "symbol", "t", "industry", "raw_close", "total", "circulating", "cash", *(f"{x} AS {c}" for c, x in (FLOWS | BALANCES).items()))
    year = f"OVER (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL '{YEAR_DAYS}' DAYS PRECEDING AND CURRENT ROW)"
    return df.selectExpr("date", "symbol", "t", "industry", "raw_close", "total", "circulating", "cash", *BALANCES, *(f"avg({c}) {year} AS {c}" for c in FLOWS))
