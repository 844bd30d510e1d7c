"""The smile of volatilities: a curve through one ladder, worked out by a small helper that Spark runs group by group.

A group is one ladder of strikes: bounded by the exchange's listings, not by the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SNAPSHOT

KEYS = list(SNAPSHOT)


def smooth_to(x: np.ndarray, y: np.ndarray, target: float) -> np.ndarray:
    """The smoothest curve at x whose squared residuals add up to target: least fourth divided differences, which a cubic has none of.

    Where the cubic itself is nearer than target, it is the curve. The eigenvectors of the penalty
    give the residuals at any stiffness, which is then found by halving.
    """
    at = (x - x[0]) / np.diff(x).mean()
    d = np.eye(len(x))
    for order in range(1, 5):
        d = np.diff(d, axis=0) / (at[order:] - at[:-order])[:, None]
    e, u = np.linalg.eigh(d.T @ d)
    e[:4] = 0
    z = u.T @ y
    kept = lambda power: 1 / (1 + 10.0**power * e)
    low, high = -25.0, 25.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if (((1 - kept(middle)) * z) ** 2).sum() > target else (middle, high)
    return u @ (kept(low) * z)


def iv_smile(chain: DataFrame, side: str = "ce", keys=KEYS, share: float = 0.5, least: float = 3.0) -> DataFrame:
    """(keys, strike_price, iv, fitted, zscore, anomaly): a smooth curve through implied volatilities between 0.5 and 150, and what lies far from it.

    The squared residuals of the curve add up to share for each strike, least at the least; at
    least five strikes are needed. Rows of one strike count as their mean. Residuals over two
    standard deviations are anomalies; a curve that meets all its points has none.
    """
    iv = F.col(f"{side}_iv")
    rows = chain.filter((iv > 0.5) & (iv < 150)).select(*keys, F.col("strike_price").cast("double").alias("strike_price"), iv.cast("double").alias("iv"))
    fields = ", ".join(f"{k} {dict(chain.dtypes)[k]}" for k in keys)

    def one(x: pd.DataFrame) -> pd.DataFrame:
        key = [x[k].iloc[0] for k in keys]
        x = x.groupby("strike_price", as_index=False)["iv"].mean().sort_values("strike_price")
        if len(x) < 5:
            return pd.DataFrame()
        y = x.iv.to_numpy()
        fitted = smooth_to(x.strike_price.to_numpy(), y, max(share * len(y), least))
        spread = (y - fitted).std()
        x = x.assign(fitted=fitted, zscore=(y - fitted) / spread if spread > 1e-9 else 0.0)
        return x.assign(**dict(zip(keys, key)))[[*keys, "strike_price", "iv", "fitted", "zscore"]]

    found = rows.groupBy(*keys).applyInPandas(one, f"{fields}, strike_price double, iv double, fitted double, zscore double")
    return found.withColumn("anomaly", F.abs("zscore") > 2)
