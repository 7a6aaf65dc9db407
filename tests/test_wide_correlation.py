"""Tiles of the Gram matrix against pandas and against the narrow matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd

from paceframe.operators.correlation import correlation_long
from paceframe.operators.wide_correlation import wide_correlation


def table(rows: int, columns: int) -> pd.DataFrame:
    rng = np.random.default_rng(7)
    values = rng.normal(size=(rows, 4)) @ rng.normal(size=(4, columns)) + rng.normal(size=(rows, columns)) + 1e6
    values[rng.random(values.shape) < 0.2] = np.nan
    return pd.DataFrame(values, columns=[f"a.{i} `x`" for i in range(columns)])


def found(spark, frame: pd.DataFrame, **options) -> dict[tuple[str, str], tuple[float | None, int]]:
    arrow = spark.createDataFrame(frame).repartition(3)
    rows = wide_correlation(arrow, list(frame.columns), **options).collect()
    out = {(r["x"], r["y"]): (r["r"], r["n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_tiles_equal_pandas(spark):
    frame = table(300, 40)
    out = found(spark, frame, block=7, tiles=4)
    r, seen = frame.corr(), frame.notna().astype(int)
    n = seen.T @ seen
    names = list(frame.columns)
    assert set(out) == {(a, b) for i, a in enumerate(names) for b in names[i:]}
    for (a, b), (value, count) in out.items():
        assert count == n.loc[a, b]
        assert abs(value - r.loc[a, b]) < 1e-9


def test_constant_missing_and_infinite_values(spark):
    frame = pd.DataFrame({"v": [1.0, 2.0, 3.0, 5.0], "same": [4.0] * 4, "none": [np.nan] * 4, "inf": [np.inf, 1.0, 2.0, -4.0]})
    out = found(spark, frame)
    assert out["v", "same"] == (None, 4) and out["same", "same"] == (None, 4)
    assert out["v", "none"] == (None, 0) and out["none", "none"] == (None, 0)
    assert out["v", "inf"][1] == 3 and abs(out["v", "inf"][0] - np.corrcoef([2, 3, 5], [1, 2, -4])[0, 1]) < 1e-12


def test_empty_table_and_repeated_rows(spark):
    frame = table(50, 3)
    assert wide_correlation(spark.createDataFrame(frame).limit(0), list(frame.columns)).count() == 0
    twice = found(spark, pd.concat([frame, frame]))
    once = found(spark, frame)
    assert all(abs(twice[k][0] - once[k][0]) < 1e-12 and twice[k][1] == 2 * once[k][1] for k in once)


def test_equal_to_the_narrow_matrix(spark):
    frame = table(200, 5).dropna()
    frame.columns = list("abcde")
    narrow = {(r["x"], r["y"]): r["r"] for r in correlation_long(spark.createDataFrame(frame), list(frame.columns)).collect()}
    for pair, (value, n) in found(spark, frame, block=2).items():
        assert n == len(frame) and abs(value - narrow[pair]) < 1e-9


def test_five_hundred_columns(spark):
    frame = table(400, 500)
    out = found(spark, frame)
    assert len(out) == 500 * 501 // 2
    r = frame.iloc[:, [0, 499]].corr().iloc[0, 1]
    assert abs(out[frame.columns[0], frame.columns[499]][0] - r) < 1e-9
