"""What a fit and the queries around it read is made once; frames are not read anew for every row."""

import numpy as np
import pytest

from conftest import SF001
from ventana.operators import learn as L
from ventana.operators import windows as W
from ventana.plans import q_learn as Q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("target", ["same_day", "next_day"])
def test_features_of_the_daily_model_are_written_once(spark, target):
    """the model's rows and those that are forecast come from one pass over the readings."""
    _, split, every = Q._daily_model(spark, SF001, target, maxIter=2)
    for df in (split, every):
        assert "Window" not in _plan(df) and "Aggregate" not in _plan(df)
    want = W.chrono_split(Q._features_daily(spark, SF001, target), ts="day", series_cols=["user_id"])
    assert split.columns == want.columns
    assert split.exceptAll(want).count() == want.exceptAll(split).count() == 0


def test_rows_of_a_patient_fit_are_written_once(spark, monkeypatch):
    """F8: training and validation rows are read several times by the fit."""
    seen = {}

    def fit(train, *, validation, **params):
        seen.update(train=train, validation=validation)
        return old(train, validation=validation, maxIter=2, **params)

    old = L.fit_gbt
    monkeypatch.setattr(L, "fit_gbt", fit)
    assert Q.q_gbt_patience(spark, SF001).count() == 1
    assert all("Window" not in _plan(df) and df.count() for df in seen.values())


def test_interpolation_looks_ahead_in_one_pass(spark):
    """A frame up to the series' end is read anew for every row, which takes the square of its length."""
    rng = np.random.default_rng(3)
    rows = [(s, i, float(i * i) if rng.random() < 0.4 else None) for s in range(5) for i in range(40)]
    df = spark.createDataFrame(rows, "s int, t int, x double")
    got = W.interpolate(df, ts="t", cols=["x"], series_cols=["s"])
    assert "unboundedfollowing" not in _plan(got).lower()
    for s in range(5):
        x = np.array([np.nan if v is None else v for a, _, v in rows if a == s])
        at = np.flatnonzero(~np.isnan(x))
        want = np.interp(np.arange(40), at, x[at])
        have = np.array([np.nan if r.x is None else r.x for r in got.filter(f"s = {s}").orderBy("t").collect()])
        assert np.isnan(have[:at[0]]).all() and np.allclose(have[at[0]:], want[at[0]:])
