import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidebars.operators.panel import number_bars  # noqa: E402
from tidebars.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 8, "tests")


@pytest.fixture(scope="session")
def ohlc():
    """A seeded hourly random walk with volume, two legs and slow series."""
    n, rng = 1500, np.random.default_rng(42)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high = np.maximum(open_, close) + np.abs(rng.normal(0, 0.05, n))
    low = np.minimum(open_, close) - np.abs(rng.normal(0, 0.05, n))
    rate = np.repeat(rng.normal(0, 1, n // 150), 150)
    vix = np.full(n, 17.0)
    vix[n // 2 : n // 2 + n // 10] = 35.0
    return pd.DataFrame(
        {
            "symbol": "X", "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "open": open_, "high": high, "low": low, "close": close,
            "volume": rng.integers(1, 1000, n).astype(float), "fill_spread_fraction": np.abs(rng.normal(1e-4, 2e-5, n)),
            "leg_a_close": close, "leg_b_close": 0.5 * close + 50 + rng.normal(0, 0.1, n),
            "interest_rate_differential": rate, "real_rate_differential": rate[::-1].copy(), "term_slope_differential": -rate, "vix_level": vix,
        }
    )


@pytest.fixture(scope="session")
def bars(spark, ohlc):
    df = spark.createDataFrame(ohlc)
    return number_bars(df).cache()
