import os
import sys
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from varloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", "varloom-tests", 8)


def days(n, start=date(2000, 1, 3)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


@pytest.fixture(scope="session")
def ohlc(spark):
    """Two assets, geometric walks on a business-day calendar."""
    rng = np.random.default_rng(5)
    frames = []
    for asset in ("X", "Y"):
        n = 700
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        open_ = close * np.exp(rng.normal(0, 0.004, n))
        frames.append(pd.DataFrame({
            "asset": asset, "date": days(n), "open": open_, "close": close,
            "high": np.maximum(open_, close) * np.exp(np.abs(rng.normal(0, 0.003, n))),
            "low": np.minimum(open_, close) * np.exp(-np.abs(rng.normal(0, 0.003, n))),
        }))
    return spark.createDataFrame(pd.concat(frames))


@pytest.fixture(scope="session")
def board(spark):
    """A target, a good, a middling and a bad forecast."""
    rng = np.random.default_rng(11)
    n = 400
    y = np.exp(rng.normal(-9, 0.6, n))
    rows = []
    for model, noise in (("good", 0.1), ("mid", 0.4), ("bad", 0.9)):
        rows.append(pd.DataFrame({"asset": "X", "date": days(n), "model": model, "yhat": y * np.exp(rng.normal(0, noise, n)), "y_true": y}))
    return spark.createDataFrame(pd.concat(rows))
