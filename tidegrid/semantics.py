"""Decisions on meaning that the whole library shares. Missing is NULL; see README for each."""

from __future__ import annotations

#: Degrees of freedom of rolling and of cross-sectional dispersion.
ROLLING_DDOF, CROSS_DDOF = 1, 0
#: A window is missing until it is full; then it needs one value, or two for dispersion, correlation and regression.
MIN_PAIRS = 2
#: A leg whose spread is below this share of its mean is constant.
CONSTANT = 1e-7
#: Under near_ties(), ranks, extremes and comparisons see values at 23 binary digits, and nothing below NOISE: equal
#: values stay equal however they were summed. The factor splits a double there.
TIE_SPLIT, NOISE = "CAST(1073741825 AS DOUBLE)", "CAST(0.000000000001 AS DOUBLE)"
#: Length of a year for durations, in days; a sample exactly so old is inside.
YEAR_DAYS = 365
#: Winsorizing share and limit of normalized features.
WINSOR, Z_LIMIT = 0.01, 5.0
#: Trading days in a year, for annualizing; shortest series that gets statistics.
DAYS_IN_YEAR, SHORTEST = 252, 10
#: Quotes: half spread, daily price limit, missing run after which a symbol counts as delisted.
HALF_SPREAD, PRICE_LIMIT, DELIST_AFTER = 0.01, 0.10, 252
#: Trading costs and starting cash.
BUY_FEE, SELL_FEE, MIN_FEE, START_CASH = 0.0005, 0.0015, 0.0, 1e6
#: Floor of specific variance in models.
SPECIFIC_FLOOR = 1e-8
