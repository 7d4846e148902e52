"""Chip distribution: at what prices the shares in hand were bought, from closes and turnover."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ("ret_avg", "ret_std", "ret_skew", "ret_kurt", "max_prob_ret", "bal", "profit_l", "profit_s", "loss_s", "loss_l")
WINDOW = 250
#: Returns are counted in bins of this width from -HALF to HALF, those beyond in the outermost; and in bands.
BIN, HALF = 0.02, 0.5
NEAR, FAR = 0.02, 0.10
#: A variance below this share of the squares that it is the difference of is none.
NO_SPREAD = 1e-13


def distribution(price: np.ndarray, turnover: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """[tick, COLUMNS] for one symbol; null rows until the window is full, and where the tick has no price above zero.

    A tick's turnover t, kept within 0..1, moves that share of all chips to the tick's price; a missing turnover moves
    none. A tick without a price above zero takes away but lays down nothing. A chip's return is close / cost - 1. The
    bands are: balanced within NEAR on both ends, small up to and with FAR, and large beyond; bins are closed below, and
    of equally likely ones the lowest counts. Without a spread, the deviation is 0 and skew and kurtosis are missing.
    """
    n = len(price)
    out = np.full((n, len(COLUMNS)), np.nan)
    move = np.clip(np.where(np.isfinite(turnover), turnover, 0.0), 0.0, 1.0)
    good = np.isfinite(price) & (price > 0)
    laid, cost = np.where(good, move, 0.0), np.where(good, price, 1.0)
    bins = round(2 * HALF / BIN)
    for end in range(window, n + 1):
        if not good[end - 1]:
            continue
        span = slice(end - window, end)
        # what later ticks have left of each tick's chips
        left = np.cumprod(np.append(1.0, 1 - move[end - window + 1 : end][::-1]))[::-1]
        w = laid[span] * left
        if not w.sum() > 0:
            continue
        held = w > 0
        w, ratio = w[held] / w.sum(), price[end - 1] / cost[span][held]
        r = ratio - 1
        mean = w @ r
        off = r - mean
        variance = w @ off**2
        if variance > max(1e-16, NO_SPREAD * (w @ ratio**2 + (w @ ratio) ** 2)):
            shape = (np.sqrt(variance), (w @ off**3) / variance**1.5, (w @ off**4) / variance**2)
        else:
            shape = (0.0, np.nan, np.nan)
        share = np.bincount(np.clip(np.floor((r + HALF) / BIN), 0, bins - 1).astype(int), w, bins)
        # by band: large loss, small loss, balanced, small profit, large profit
        band = (r >= -FAR).astype(int) + (r >= -NEAR) + (r > NEAR) + (r > FAR)
        loss_l, loss_s, bal, profit_s, profit_l = np.bincount(band, w, 5)
        out[end - 1] = (mean, *shape, (share.argmax() + 0.5) * BIN - HALF, bal, profit_l, profit_s, loss_s, loss_l)
    return out


def chip_distribution(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """date, symbol and COLUMNS for each row of a dense panel with close and turn; a symbol at a time."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        found = distribution(rows["close"].to_numpy(float), rows["turn"].to_numpy(float), window)
        out = pd.DataFrame(found, columns=list(COLUMNS))
        out.insert(0, "symbol", rows["symbol"].to_numpy())
        out.insert(0, "date", rows["date"].to_numpy())
        return out

    return df.select("date", "symbol", "t", "close", "turn").groupBy("symbol").applyInPandas(one, "date date, symbol long, " + ", ".join(f"{c} double" for c in COLUMNS))
