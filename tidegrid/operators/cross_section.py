"""Operators over one date: normalizing, selecting, quoting, and scoring features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..plans.expression import average_rank
from ..semantics import DELIST_AFTER, HALF_SPREAD, PRICE_LIMIT, SHORTEST, WINSOR, Z_LIMIT
from ..sources.market import by_symbol


def day() -> WindowSpec:
    """All symbols of a date."""
    return Window.partitionBy("date")


def winsorized(df: DataFrame, columns: list[str], share: float = WINSOR) -> DataFrame:
    """Each value kept within its date's lower and upper quantile of that share."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.percentile(c, F.lit(share)).over(day())), F.percentile(c, F.lit(1 - share)).over(day()))) for c in columns})


def zscores(df: DataFrame, columns: list[str], missing: float | None = None) -> DataFrame:
    """Mean 0 and population deviation 1 over each date; a column without spread is 0. missing: what a null becomes."""

    def z(c: str) -> Column:
        sd = F.stddev_pop(c).over(day())
        out = F.when(F.col(c).isNotNull(), F.when(sd > 1e-12 * F.abs(F.avg(c).over(day())), (F.col(c) - F.avg(c).over(day())) / sd).otherwise(0.0))
        return out if missing is None else F.coalesce(out, F.lit(missing))

    return df.withColumns({c: z(c) for c in columns})


def normalized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Winsorized, standardized with missing at 0, and kept within the z limit."""
    out = zscores(winsorized(df, columns), columns, 0.0)
    return out.withColumns({c: F.greatest(F.least(F.col(c), F.lit(Z_LIMIT)), F.lit(-Z_LIMIT)) for c in columns})


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average rank within the date, from 0 to 1."""
    return df.withColumns({c: F.expr(average_rank(c)) for c in columns})


def scaled_down(df: DataFrame, column: str, most: float = 1.0) -> DataFrame:
    """Weights whose absolute sum is `most` or less, shrunk where it is more."""
    return df.withColumn(column, F.col(column) / F.greatest(F.sum(F.abs(F.col(column))).over(day()) / most, F.lit(1.0)))


def industry_dummies(df: DataFrame, tags: list[str]) -> DataFrame:
    """IND_<tag> columns of 1 and 0, in order of the tags; the empty tag has none."""
    return df.withColumns({f"IND_{t}": F.when(F.col("industry") == t, 1.0).otherwise(0.0) for t in sorted(tags) if t})


def nonlinear_size(df: DataFrame, size: str) -> DataFrame:
    """The cube of standardized size, without what size itself explains."""
    df = zscores(df.withColumn("_z", F.col(size)), ["_z"])
    slope = F.sum(F.pow("_z", F.lit(4.0))).over(day()) / F.nullif(F.sum(F.pow("_z", F.lit(2.0))).over(day()), F.lit(0.0))
    return df.withColumn("NLSIZE", F.pow("_z", F.lit(3.0)) - F.coalesce(slope, F.lit(0.0)) * F.col("_z")).drop("_z")


def largest(df: DataFrame, k: int, cap: str = "cap") -> DataFrame:
    """The rows of the k largest capitalisations of each date; ties to the smaller symbol."""
    return df.filter(F.col(cap) > 0).withColumn("_n", F.row_number().over(day().orderBy(F.desc(cap), "symbol"))).filter(F.col("_n") <= k).drop("_n")


def cap_weighted_top(df: DataFrame, k: int, cap: str = "cap") -> DataFrame:
    """(date, symbol, weight): the k largest capitalisations of each date, weighted by them; ties to the smaller symbol."""
    return largest(df, k, cap).select("date", "symbol", (F.col(cap) / F.sum(cap).over(day())).alias("weight"))


def quotes(df: DataFrame) -> DataFrame:
    """listed, bid and ask of each tick: the close less and plus the half spread, and no quote beyond the daily limit.

    Limits are from the last close before, rounded to cents; the first close has none. Without a close there is no quote. A
    symbol counts as listed until more than DELIST_AFTER ticks are missing in a row.
    """
    before = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    seen = F.max(F.when(F.col("close").isNotNull(), F.col("t"))).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    cents = lambda x: F.floor(x * 100 + 0.5) / 100
    low, high = cents(before * (1 - PRICE_LIMIT)), cents(before * (1 + PRICE_LIMIT))
    bid, ask = F.col("close") - HALF_SPREAD, F.col("close") + HALF_SPREAD
    return df.withColumns({
        "bid": F.when(F.col("close").isNotNull() & ~F.coalesce(bid < low, F.lit(False)), bid), "ask": F.when(F.col("close").isNotNull() & ~F.coalesce(ask > high, F.lit(False)), ask),
        "listed": (F.col("t") - F.coalesce(seen, F.lit(0))) <= DELIST_AFTER,
    })


def information_coefficients(df: DataFrame, features: list[str], target: str, ranked: bool = False) -> DataFrame:
    """(date, feature, ic): correlation over the symbols that have both; by average ranks if ranked. Null below two pairs or without spread."""
    pairs = df.select("date", "symbol", F.col(target).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features))).alias("p"))
    pairs = pairs.select("date", "p.feature", F.col("p.x").alias("x"), "y").filter("x IS NOT NULL AND y IS NOT NULL")
    if ranked:
        pairs = pairs.select("date", "feature", F.expr(average_rank("x", "date, feature")).alias("x"), F.expr(average_rank("y", "date, feature")).alias("y"))
    spread = lambda c: F.when(F.stddev_samp(c) > 1e-9 * F.abs(F.avg(c)), F.stddev_samp(c))
    return pairs.groupBy("date", "feature").agg(F.when(F.count(F.lit(1)) >= 2, F.covar_samp("x", "y") / (spread("x") * spread("y"))).alias("ic"))


def feature_statistics(ic: DataFrame) -> DataFrame:
    """Per feature: count, mean, sample deviation, their ratio, t value, share above zero."""
    sd = F.when(F.count("ic") >= 2, F.stddev_samp("ic"))
    out = ic.groupBy("feature").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), sd.alias("std"), F.avg(F.when(F.col("ic").isNotNull(), (F.col("ic") > 0).cast("double"))).alias("positive"))
    return out.withColumn("icir", F.col("mean") / F.nullif("std", F.lit(0.0))).withColumn("t_value", F.col("icir") * F.sqrt("n"))


def cumulative(ic: DataFrame) -> DataFrame:
    """Running sum of each feature's values; a missing one leaves it flat."""
    w = Window.partitionBy("feature").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ic.withColumn("total", F.sum(F.coalesce("ic", F.lit(0.0))).over(w))


def turnover(books: DataFrame) -> DataFrame:
    """(date, turnover, total) of target books (date, symbol, weight): the absolute change since the book before, and its running sum.

    The first book counts as a change from nothing; a symbol that leaves counts with its weight.
    """
    dates = books.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    now = books.join(F.broadcast(dates), "date").select("k", "symbol", "weight")
    gone = now.select((F.col("k") + 1).alias("k"), "symbol", (-F.col("weight")).alias("weight"))
    moved = now.union(gone).groupBy("k", "symbol").agg(F.abs(F.sum("weight")).alias("d")).groupBy("k").agg(F.sum("d").alias("turnover"))
    out = moved.join(dates, "k").select("date", "turnover")
    return out.withColumn("total", F.sum("turnover").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def annualized_turnover(curve: DataFrame, days: int = 252) -> DataFrame:
    """Per label, what a running turnover (date, label, total) grows by in a year of `days` values; null below SHORTEST values."""
    grown = (F.max_by("total", "date") - F.min_by("total", "date")) / (F.count(F.lit(1)) / F.lit(float(days)))
    return curve.filter("total IS NOT NULL AND NOT isnan(total)").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= SHORTEST, grown).alias("turnover"))


def risk_model_statistics(scores: DataFrame, days: int = 252) -> DataFrame:
    """Per label, from daily scores of a risk model and of the book that it holds for the least variance.

    scores: label, log_likelihood, period_return, portfolio_variance, mean_correlation, factor_share, breadth,
    short_share. A day counts as scored with a return and a variance above zero; volatilities a year and the bias
    (deviation of returns over predicted deviations, 1 if predictions are right) are null below SHORTEST such days.
    """
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    both = finite("period_return").isNotNull() & (finite("portfolio_variance") > 0)
    ret, sd = F.when(both, F.col("period_return")), F.when(both, F.sqrt("portfolio_variance"))
    scored = F.count(ret)
    enough = lambda x: F.when(scored >= SHORTEST, x)
    means = [F.avg(finite(c)).alias(c) for c in ("log_likelihood", "mean_correlation", "factor_share", "breadth", "short_share")]
    return scores.groupBy("label").agg(
        scored.alias("days"), enough(F.stddev_samp(ret) * days**0.5).alias("realized_vol"), enough(F.avg(sd) * days**0.5).alias("predicted_vol"), enough(F.stddev_samp(ret / sd)).alias("bias_ratio"), *means
    )


def exposures(books: DataFrame) -> DataFrame:
    """Per date: effective number of holdings, short and gross exposure."""
    w = F.col("weight")
    return books.groupBy("date").agg((1 / F.nullif(F.sum(w * w), F.lit(0.0))).alias("breadth"), F.sum(F.greatest(-w, F.lit(0.0))).alias("short_exposure"), F.sum(F.abs(w)).alias("gross_exposure"))


def nav_statistics(nav: DataFrame, days: int = 252) -> DataFrame:
    """Per label, over finite values above zero: growth a year, mean and deviation of log returns, their ratio a year, largest fall. Null below SHORTEST values."""
    w = Window.partitionBy("label").orderBy("date")
    fine = nav.filter("nav > 0")
    r = fine.withColumn("r", F.ln(F.col("nav") / F.lag("nav").over(w))).withColumn("fall", 1 - F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.max("fall").alias("drawdown"))
    enough = lambda x: F.when(F.col("n") >= SHORTEST, x)
    return out.select("label", "n", enough(F.pow(F.col("last") / F.col("first"), days / F.col("n")) - 1).alias("cagr"), enough(F.col("mean")).alias("mean"), enough(F.col("std")).alias("std"), enough(F.col("mean") / F.nullif("std", F.lit(0.0)) * days**0.5).alias("sharpe"), enough(F.col("drawdown")).alias("drawdown"))


def rebased(series: DataFrame) -> DataFrame:
    """Each label's values over its first one that is neither missing nor zero."""
    w = Window.partitionBy("label").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.when(F.col("value") != 0, F.col("value")), ignorenulls=True).over(w)
    return series.withColumn("value", F.col("value") / base)


def wide(series: DataFrame, labels: list[str]) -> DataFrame:
    """date and one column a label, in their order."""
    return series.groupBy("date").pivot("label", labels).agg(F.first("value"))


def range_momentum(df: DataFrame, amplitude: str, ret: str, window: int) -> Column:
    """Return on the fifth of days with the largest amplitude less that on the fifth with the smallest, over a full window; null below five days.

    Days of equal amplitude are in order of time.
    """
    w = by_symbol().rowsBetween(1 - window, 0)
    both = F.col(amplitude).isNotNull() & F.col(ret).isNotNull()
    days = F.array_sort(F.collect_list(F.when(both, F.struct(F.col(amplitude).alias("a"), F.col("t").alias("t"), F.col(ret).alias("r")))).over(w))
    m = F.size(days)
    k = F.greatest(F.lit(1), F.floor(m * 0.2 + 0.5).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["r"])
    return F.when((F.col("t") >= window) & (m >= 5), total(F.slice(days, m - k + 1, k)) - total(F.slice(days, F.lit(1), k)))
