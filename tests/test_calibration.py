import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import calibration
from textloom.plans import queries


def test_interpolation_between_many_knots(spark):
    xs = np.arange(1000) / 1000
    knots = [(float(x), float(x**2)) for x in xs]
    p = [None, -1.0, 0.0, 0.0005, 0.25, 0.4321, 0.999, 2.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    for ks in (knots, knots[:1], knots[::300]):
        got = [r["c"] for r in df.select("i", calibration.interpolate(F.col("p"), ks).alias("c")).orderBy("i").collect()]
        want = np.clip(np.interp([-1.0 if v is None else v for v in p], *zip(*ks)), 1e-6, 1 - 1e-6)
        assert np.allclose(got, want, atol=1e-12)


def test_query_calibrates_with_many_knots(spark, monkeypatch):
    """Rates that rise at every step give a knot each; the query must not return the scores."""
    rows = [(1000 * b + k, (b + 0.5) / 400, int(k < b // 4)) for b in range(0, 400, 1) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, p double, y int")
    monkeypatch.setattr(queries, "scored", lambda *_: df)
    monkeypatch.setattr(calibration, "isotonic_knots", lambda s: [(i / 400, i / 1600) for i in range(400)])
    got = queries.QUERIES["isotonic_calibration"](spark, "").join(df, "doc_id").where("p > 0.1")
    assert got.where("calibrated > 0.5 * p").count() == 0 and got.count() > 0


def brute(xs, ys):
    """The isotonic fit by the formula of largest smallest means."""
    n = len(xs)
    return [max(min(float(np.mean(ys[j : k + 1])) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def test_isotonic_fit_is_exact(spark):
    r = np.random.default_rng(3)
    p = np.unique(r.random(120))
    y = (r.random(len(p)) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    knots = calibration.isotonic_knots(df)
    got = [x["c"] for x in df.select("p", calibration.interpolate(F.col("p"), knots).alias("c")).orderBy("p").collect()]
    assert np.allclose(got, np.clip(brute(p, y), 1e-6, 1 - 1e-6))
    assert calibration.isotonic_knots(df.where("y = 1")) is None and calibration.isotonic_knots(df.limit(0)) is None


def test_pooling_in_parts_is_pooling_at_once():
    r = np.random.default_rng(5)
    blocks = [(1.0, float(r.random()), float(i), float(i)) for i in range(200)]
    parts = [b for k in range(0, 200, 17) for b in calibration.pool(blocks[k : k + 17])]
    assert np.allclose(calibration.pool(parts), calibration.pool(blocks))


def test_operating_points(spark):
    cal = spark.createDataFrame([(i % 2, 0.1 + 0.008 * i) for i in range(100)], "y int, p double")
    fit = {r["class"]: r["threshold"] for r in calibration.fit_conformal(cal).collect()}
    for c in (0, 1):
        s = np.array([1 - p if y == 1 else p for y, p in (tuple(r) for r in cal.collect()) if y == c])
        assert abs(fit[c] - np.quantile(s, np.ceil(51 * 0.9) / 50, method="higher")) < 1e-12
    got = {r["fpr"]: r["threshold"] for r in calibration.fit_fpr_thresholds(cal).collect()}
    neg = np.array([p for y, p in (tuple(r) for r in cal.collect()) if y == 0])
    assert all(abs(t - np.quantile(neg, 1 - f, method="higher")) < 1e-12 for f, t in got.items())
    assert {r["threshold"] for r in calibration.fit_fpr_thresholds(cal.where("y = 1")).collect()} == {1.0}
    assert {r["threshold"] for r in calibration.fit_conformal(cal.limit(0)).collect()} == {1.0}
    sel = {r["coverage"]: r["threshold"] for r in calibration.fit_selective_thresholds(cal).collect()}
    conf = np.array([max(p, 1 - p) for _, p in (tuple(r) for r in cal.collect())])
    assert sel[1.0] == 0 and abs(sel[0.8] - np.quantile(conf, 1 - 0.8, method="higher")) < 1e-12


def test_bundle_refuses_others(spark):
    name = {"detector_id": "d", "model_revision": "1", "task": "t", "cohort": "c"}
    df = spark.createDataFrame([(int(i > 30), i / 50) for i in range(50)], "y int, p double")
    b = calibration.fit_bundle(df, **name)
    assert calibration.CalibrationBundle.from_json(b.to_json()) == b
    assert df.select(b.calibrate(F.col("p"), **name)).count() == 50
    with pytest.raises(calibration.CalibrationMismatch):
        b.calibrate(F.col("p"), **{**name, "cohort": "other"})
    with pytest.raises(calibration.CalibrationMismatch):
        calibration.CalibrationBundle.from_json(b.to_json().replace('"cohort": "c"', '"cohort": "x"'))
