import numpy as np
import pandas as pd
import pytest

from roundwise.operators import curves as K
from roundwise.operators import trends as M

def binomial_cells(seed=1, slope=0.12):
    rng = np.random.default_rng(seed)
    rounds = np.arange(6, 20)
    n = rng.integers(200, 900, len(rounds))
    p = 1 / (1 + np.exp(-(-1.5 + slope * (rounds - 13))))
    return pd.DataFrame({"g": "a", "round": rounds.astype("int32"), "n": n, "positives": rng.binomial(n, p)})


def newton(cells, centre):
    x = np.column_stack([np.ones(len(cells)), cells["round"] - centre])
    k, n = cells["positives"].to_numpy(float), cells["n"].to_numpy(float)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (n * p * (1 - p))[:, None])
        b = b + np.linalg.solve(h, x.T @ (k - n * p))
    return b, np.linalg.inv(h)


@pytest.mark.parametrize("centre", [0.0, 13.0])
def test_logit_lines_match_newton(spark, centre):
    cells = binomial_cells()
    row = M.logit_lines(spark.createDataFrame(cells), ["g"], centre=centre).first()
    b, v = newton(cells, centre)
    assert np.allclose([row["intercept"], row["slope"]], b, rtol=1e-9)
    assert np.allclose([row["v00"], row["v01"], row["v11"]], [v[0, 0], v[0, 1], v[1, 1]], rtol=1e-9)


def test_logit_lines_without_variation_have_no_fit(spark):
    cells = binomial_cells().assign(positives=0)
    assert M.logit_lines(spark.createDataFrame(cells), ["g"]).first()["slope"] is None


def test_logit_lines_of_separated_and_steep_strata(spark):
    rounds = list(range(6, 31))
    rows = [("apart", r, 100, 100 if r > 15 else 0) for r in rounds] + [("steep", r, 1000, min(999, max(1, int(1000 / (1 + np.exp(-1.5 * (r - 18))))))) for r in rounds]
    lines = M.logit_lines(spark.createDataFrame(rows, "g string, round int, n long, positives long"), ["g"], centre=13.0)
    got = {r["g"]: r for r in lines.collect()}
    assert not got["apart"]["converged"] and got["apart"]["slope"] is None
    assert got["steep"]["converged"] and got["steep"]["slope"] > 0.5
    assert M.predict_lines(lines, centre=13.0).agg({"round": "max"}).first()[0] == 30


def direct_loess(x, y, span):
    q = int(np.floor(len(x) * span + 1e-5))
    out = {}
    for x0 in np.unique(x):
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        design = np.column_stack([np.ones_like(x), x - x0, (x - x0) ** 2])
        out[x0] = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
    return out


@pytest.mark.parametrize("points, chunk, span", [(60, 128, 0.25), (300, 16, 0.1), (300, 16, 1.0)])
def test_smoothing_matches_direct_fit(spark, monkeypatch, points, chunk, span):
    """Also over chunk borders and with several observations at one x."""
    monkeypatch.setattr(K, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x = np.sort(rng.choice(np.arange(points), size=points, replace=True)).astype(float)
    y = np.sin(x / 9) + rng.normal(0, 0.2, points)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    got = {r["x"]: r["smooth_y"] for r in K.smooth_curves(df, ["g"], "x", ["y"], span).collect()}
    expected = direct_loess(x, y, span)
    assert sorted(got) == sorted(expected)
    for x0, value in expected.items():
        assert got[x0] == pytest.approx(value, abs=1e-8)


# Fifty stopping distances by speed, a public teaching table, and the smooth published for
# it by the common statistics package (span 0.75, its documentation's example output).
SPEED = "4 4 7 7 8 9 10 10 10 11 11 12 12 12 12 13 13 13 13 14 14 14 14 15 15 15 16 16 17 17 17 18 18 18 18 19 19 19 20 20 20 20 20 22 23 24 24 24 24 25"
DISTANCE = "2 10 4 22 16 10 18 26 34 17 28 14 20 24 28 26 34 34 46 26 36 60 80 20 26 54 32 40 32 40 50 42 56 76 84 36 46 68 32 48 52 56 64 66 54 70 92 93 120 85"
PUBLISHED = {7: 12.499786, 8: 15.281082, 9: 18.446568, 10: 21.865315, 11: 25.517015, 12: 29.350386, 13: 33.230660, 14: 37.167935, 15: 41.205226, 17: 48.355889, 18: 49.824812, 19: 51.986702, 20: 56.461318, 22: 68.569313, 23: 76.316068, 24: 85.212121, 25: 95.324047}


def test_interpolated_smooth_equals_a_published_one(spark):
    rows = [("a", float(x), float(y), 2 * float(y)) for x, y in zip(SPEED.split(), DISTANCE.split())]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(3)
    got = {r["x"]: r for r in K.smooth_curves(df, ["g"], "x", ["y", "z"], 0.75, method="interpolate").collect()}
    for x, value in PUBLISHED.items():
        assert got[x]["smooth_y"] == pytest.approx(value, abs=1e-6)
        assert got[x]["smooth_z"] == pytest.approx(2 * value, abs=2e-6)


def blended_by_hand(x, y, span, cell=0.2):
    """Cuts by recursion over observations, fits by least squares, cubic blending."""
    n = len(x)
    most, q = int(np.floor(n * (span * cell))), int(np.floor(n * span + 1e-5))
    margin = 0.005 * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    ends, cells = [x[0] - margin, x[-1] + margin], [(0, n - 1)]
    while cells:
        a, b = cells.pop()
        if b - a + 1 <= most:
            continue
        # last observations of a lower part, counted from one as in the middle
        m = (a + 1 + b + 1) // 2
        places = [p for p in range(a + 1, b + 1) if x[p - 1] != x[p] and m - p <= b + 1 - m - 1]
        if places:
            p = min(places, key=lambda p: (abs(p - m), -p))
            ends.append(x[p - 1])
            cells += [(a, p - 1), (p, b)]
    ends = np.sort(ends)
    fits = []
    for v in ends:
        d = np.abs(x - v)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        design = np.column_stack([np.ones(n), x - v, (x - v) ** 2])
        fits.append(np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][:2])
    out = {}
    for x0 in np.unique(x):
        i = np.searchsorted(ends, x0, side="right") - 1
        width = ends[i + 1] - ends[i]
        s = (x0 - ends[i]) / width
        basis = [(1 - s) ** 2 * (1 + 2 * s), s * (1 - s) ** 2 * width, s * s * (3 - 2 * s), -s * s * (1 - s) * width]
        out[x0] = np.dot(basis, [*fits[i], *fits[i + 1]])
    return out, len(ends)


@pytest.mark.parametrize("points, repeats, span", [(80, False, 0.25), (200, True, 0.1), (60, True, 0.5), (30, False, 0.9)])
def test_interpolated_smooth_matches_the_hand_worked_curve(spark, points, repeats, span):
    rng = np.random.default_rng(points)
    x = np.sort(rng.choice(np.arange(points), size=points, replace=repeats)).astype(float)
    y = np.cos(x / 7) + rng.normal(0, 0.1, points)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    got = {r["x"]: r["smooth_y"] for r in K.smooth_curves(df, ["g"], "x", ["y"], span, method="interpolate").collect()}
    expected, n_ends = blended_by_hand(x, y, span)
    assert sorted(got) == sorted(expected) and n_ends < 4 / (span * 0.2)
    for x0, value in expected.items():
        assert got[x0] == pytest.approx(value, abs=1e-8)


def test_interpolated_smooth_of_short_and_empty_curves(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("two", 1.0, 2.0), ("two", 3.0, 5.0), ("none", None, 1.0)], "g string, x double, y double")
    got = K.smooth_curves(df, ["g"], "x", ["y"], 0.5, method="interpolate").collect()
    assert sorted((r["g"], r["x"], r["smooth_y"]) for r in got) == [("one", 1.0, None), ("two", 1.0, None), ("two", 3.0, None)]
    with pytest.raises(ValueError):
        K.smooth_curves(df, ["g"], "x", ["y"], method="other")


def test_averted_share_is_of_the_compared_scenario(spark):
    df = spark.createDataFrame([("base", 1, 80.0), ("other", 1, 100.0)], "scenario string, year int, cuminc_mean double")
    rows = {r["scenario"]: r for r in K.infections_averted(df, "base", ["year"]).collect()}
    assert (rows["other"]["delta_inc_mean"], rows["other"]["delta_inc_mean_pct"]) == (20.0, 0.2)
    assert rows["base"]["delta_inc_mean"] == 0.0


def test_patch_and_ratio(spark):
    df = spark.createDataFrame([("a", 6, 0.0005, 0.1), ("a", 7, 0.2, None), ("a", 8, 0.2, 0.3)], "g string, round int, prob double, ub double")
    assert [r["ub"] for r in M.patch_upper_bound(df, 0.001).orderBy("round").collect()] == [0.0, 0.0, 0.3]
    ratios = M.ratio_to_reference(df, ["g"], "prob", 6, "r").orderBy("round").collect()
    assert [r["r"] for r in ratios] == pytest.approx([1.0, 400.0, 400.0])
