"""Panels from files and back: Parquet panels, CSV histories of one symbol each, and the CSV tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .market import PANELS, calendar, carried, field_names, in_range, listed, prefilled, value_columns

# -- readers -----------------------------------------------------------------------------------------------------------


def read_panel(spark: SparkSession, path: str, *, date: str = "date", symbol: str = "symbol", columns: list[str] | None = None, prefix: str | None = None, start: str | None = None, end: str | None = None, carry_in: bool = False) -> DataFrame:
    """date, symbol and the value columns (all numeric and boolean ones, or those named) of a Parquet panel.

    With a prefix, columns get their field names. Rows from start, inclusive, to end, exclusive; with carry_in, each
    symbol's last row before the start stands at the start.
    """
    df = spark.read.parquet(path)
    chosen = columns if columns is not None else [c for c in value_columns(df) if c not in (date, symbol)]
    df = df.select(F.col(date).cast("date").alias("date"), F.col(symbol).alias("symbol"), *(F.col(f"`{c}`") for c in chosen))
    first, last = start or "0001-01-01", end or "9999-12-31"
    df = prefilled(df, first, last) if carry_in and start else in_range(df, first, last)
    return df.toDF("date", "symbol", *field_names(chosen, prefix).values()) if prefix else df


def market_panels(spark: SparkSession, folder: str, symbols: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The panels of PANELS that the folder has, side by side on the grid of listed symbols and days with a price.

    Prices and dividends stand on their day; what a panel carries in stays until its next row.
    """
    found = {}
    for stem, prefix, stays in PANELS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stem}.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            found[prefix] = (listed(read_panel(spark, f"{folder}/{stem}.parquet", prefix=prefix, start=start, end=end, carry_in=stays), symbols), stays)
    prices = found.pop("prices")[0]
    grid = symbols.select("symbol", "industry").crossJoin(F.broadcast(calendar(prices)))
    out = grid.join(prices, ["date", "symbol"], "left")
    for df, stays in found.values():
        values = [c for c in df.columns if c not in ("date", "symbol")]
        plain = [f"v{i}" for i in range(len(values))]
        own = df.toDF(*("date" if c == "date" else "symbol" if c == "symbol" else plain[values.index(c)] for c in df.columns))
        if stays:  # a row between two days counts from the next one
            days = calendar(prices).select(F.col("date").alias("day"))
            own = own.join(F.broadcast(days), F.col("day") >= F.col("date")).groupBy("symbol", "date", *plain).agg(F.min("day").alias("day"))
            own = own.groupBy("day", "symbol").agg(F.max_by(F.struct(*plain), "date").alias("r")).select(F.col("day").alias("date"), "symbol", "r.*")
        out = out.join(own, ["date", "symbol"], "left")
        if stays:
            out = carried(out, plain)
        out = out.withColumnsRenamed(dict(zip(plain, values, strict=True)))
    return out


def read_symbols(spark: SparkSession, path: str, *, symbol: str = "symbol", name: str = "name", industry: str = "industry") -> DataFrame:
    """symbol, name and industry of a CSV list, in order. A symbol that is missing or there twice is an error."""
    df = spark.read.csv(path, header=True).select(F.col(f"`{symbol}`").alias("symbol"), F.col(f"`{name}`").alias("name"), F.coalesce(F.col(f"`{industry}`"), F.lit("")).alias("industry"))
    wrong = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("symbol IS NULL OR n > 1").limit(5).collect()
    if wrong:
        raise ValueError(f"symbols missing or repeated: {[r.symbol for r in wrong]}")
    return df.orderBy("symbol")


def read_histories(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All files <symbol>.<kind>.csv of a folder as one table, the symbol from the file's name. A row without a date is an error."""
    df = spark.read.csv(f"{folder}/*.{kind}.csv", header=True, inferSchema=True, enforceSchema=False)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    df = df.withColumn("symbol", F.regexp_extract(F.url_decode(name), r"^(.*)\.[^.]+\.csv$", 1))
    df = df.withColumn("date", F.col("date").cast("date"))
    if not df.filter("date IS NULL").isEmpty():
        raise ValueError(f"a {kind} history has a row without a date")
    return df.select("date", "symbol", *(c for c in df.columns if c not in ("date", "symbol")))


# -- sinks -------------------------------------------------------------------------------------------------------------


def write_panel(df: DataFrame, path: str) -> None:
    """A Parquet panel in order of date and symbol, compressed by zstd; files follow the order, so ranges of dates are read alone."""
    df.orderBy("date", "symbol").write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, *order) -> None:
    """One CSV file with a header, its rows in order: for tables as long as a calendar or a list, not for panels."""
    df.orderBy(*order).coalesce(1).write.csv(path, header=True)


def write_weights(books: DataFrame, path: str, least: float = 0.0) -> None:
    """date, symbol, weight of holdings of at least `least` (and of more than rounding), by date and then the largest first. What is left to 1 is cash."""
    kept = books.filter(F.col("weight") >= max(least, 1e-9)).select("date", "symbol", "weight")
    kept.orderBy("date", F.desc("weight"), "symbol").write.csv(path, header=True)


def write_features(statistics: DataFrame, path: str) -> None:
    """Feature statistics, the strongest first: by the absolute t value, missing ones last."""
    write_csv(statistics, path, F.abs("t_value").desc_nulls_last(), "feature")
