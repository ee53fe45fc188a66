"""Regression of budgets against plain least squares, medians of all other embryos against sorting."""

import numpy as np
import pytest

from trackspark.operators import budget

DESIGN = "dataset string, embryo string, y double, " + ", ".join(f"{f} double" for f in budget.FEATURES)


def design(spark, groups, per, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for k in range(per(g)):
            x = rng.random(len(budget.FEATURES)) * 3
            y = float(rng.integers(0, 4)) if ties else float(x @ np.arange(1, 9) / 8 + 0.5 + rng.normal() / 20)
            rows.append((f"d{g}_{k}", f"e{g}", y, *map(float, x)))
    return rows, spark.createDataFrame(rows, DESIGN)


def test_held_out_coefficients_are_those_of_least_squares(spark):
    rows, df = design(spark, 5, lambda g: 6 + g)
    got = {r.dataset: r.yhat for r in budget.predict(df, budget.fit(df)).collect()}
    for name in {r[1] for r in rows}:
        train = [r for r in rows if r[1] != name]
        x = np.array([[1.0, *r[3:]] for r in train])
        beta = np.linalg.lstsq(x, np.array([r[2] for r in train]), rcond=None)[0]
        for r in rows:
            if r[1] == name:
                assert got[r[0]] == pytest.approx(beta @ np.array([1.0, *r[3:]]), abs=1e-6)
    whole = budget.predict(df, budget.fit(df, hold_out=False)).collect()
    assert len(whole) == len(rows) and all(r.yhat is not None for r in whole)


@pytest.mark.parametrize("ties", [False, True])
def test_median_of_all_other_embryos(spark, ties):
    rows, df = design(spark, 6, lambda g: 1 + 7 * (g == 2) + g, 3, ties)
    rows.append(("lost", "e0", None, *[0.0] * 8))
    df = df.unionByName(spark.createDataFrame(rows[-1:], DESIGN))
    found = budget.null_prediction(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ynull == pytest.approx(np.median([q[2] for q in rows if q[1] != r.embryo and q[2] is not None]))


def test_one_embryo_has_no_others(spark):
    _, df = design(spark, 1, lambda g: 4)
    assert [r.ynull for r in budget.null_prediction(df).collect()] == [None] * 4
    assert [r.yhat for r in budget.predict(df, budget.fit(df)).collect()] == [None] * 4
