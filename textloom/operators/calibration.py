"""Calibration maps and operating points, fitted on one partition and applied frozen to another."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.evidence import clip
from textloom.operators.metrics import COVERAGE_LEVELS, FPR_TARGETS, conformal_level, nonconformity
from textloom.operators.ranks import quantiles
from textloom.session import cut_lineage

#: Pools that one task merges; more go through another round over ranges first.
MOST_POOLS = 200_000


def pool(blocks) -> list[list[float]]:
    """Adjacent blocks ``(weight, mean, first x, last x)``, in order of x, pooled until the means rise."""
    out: list[list[float]] = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            z, a = out.pop(), out.pop()
            w = a[0] + z[0]
            out.append([w, (a[0] * a[1] + z[0] * z[1]) / w, a[2], z[3]])
    return out


def isotonic_pools(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """``(keys, w, m, x0, x1)``: the pools of the exact isotonic fit of the labels on the scores, by keys.

    Rows are aggregated to distinct scores; ranges of these are pooled apart, then the pools together,
    which gives the same fit as pooling all at once. What a task gets in the last step are the pools of one
    key's ranges: a level for each rise of the fit that a range alone can't rule out. If they are more than ``MOST_POOLS``
    of a key, wider ranges are pooled first, again and again.
    """
    g = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, p).agg(F.count("*").cast("double").alias("w"), F.avg(F.col(y).cast("double")).alias("m"))
    g = g.select(*keys, "w", "m", F.col(p).cast("double").alias("x0"), F.col(p).cast("double").alias("x1"))
    kinds = dict(g.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "w double, m double, x0 double, x1 double"])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x0")
        got = pd.DataFrame(pool(pdf[["w", "m", "x0", "x1"]].itertuples(index=False)), columns=["w", "m", "x0", "x1"])
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    ranges = 256
    while ranges > 1:
        cuts = g.agg(F.percentile_approx("x0", F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1))), F.lit(20 * ranges)).alias("_cuts"))  # one row
        part = F.size(F.filter(F.coalesce("_cuts", F.array(F.col("x0"))), lambda c: c < F.col("x0")))
        g = cut_lineage(g.crossJoin(F.broadcast(cuts)).withColumn("_part", part).drop("_cuts").groupBy(*keys, "_part").applyInPandas(lambda pdf: work(pdf.drop(columns="_part")), schema))
        most = g.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        ranges = 1 if most <= MOST_POOLS else ranges // 4
    return g.withColumn("_all", F.lit(1)).groupBy(*(keys or ["_all"])).applyInPandas(lambda pdf: work(pdf.drop(columns="_all")), schema)


def isotonic_knots(df: DataFrame, y: str = "y", p: str = "p") -> list[tuple[float, float]] | None:
    """Knots of the exact isotonic fit: both ends of each pool. None where the labels are of one class or
    there are fewer than two distinct scores, which identify no map; then scores stay as they are."""
    few = df.agg(F.min(y).alias("a"), F.max(y).alias("b"), F.min(p).alias("c"), F.max(p).alias("d")).first()
    if few["a"] is None or few["a"] == few["b"] or few["c"] == few["d"]:
        return None
    return sorted({(x, r["m"]) for r in isotonic_pools(df, [], y, p).collect() for x in (r["x0"], r["x1"])})


def interpolate(p: Column, knots: list[tuple[float, float]] | None) -> Column:
    """Linear between the knots, flat outside, held to [1e-6, 1 - 1e-6]; without knots the score as it is,
    held likewise. The knots are sorted, so each row finds its place by bisection, whatever their number."""
    if not knots:
        return clip(p)
    n, xs, ys = len(knots), F.lit([float(x) for x, _ in knots]), F.lit([float(y) for _, y in knots])
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))])
    # How many knots are at or below p.
    place = F.aggregate(steps, F.lit(0), lambda i, s: F.when((i + s <= n) & (F.get(xs, i + s - 1) <= p), i + s).otherwise(i))

    def value(i):
        x0, y0, x1, y1 = F.get(xs, i - 1), F.get(ys, i - 1), F.get(xs, i), F.get(ys, i)
        between = y0 + F.when(x1 > x0, (p - x0) * (y1 - y0) / (x1 - x0)).otherwise(0.0)
        return F.when(i == 0, F.lit(float(knots[0][1]))).when(i == n, F.lit(float(knots[-1][1]))).otherwise(between)

    return clip(F.get(F.transform(F.array(place), value), 0))


def slope_intercept(df: DataFrame, y: str = "y", p: str = "p") -> dict[str, float]:
    """Slope and intercept of the logistic fit of the labels on the scores' log odds; nan for one class."""
    from textloom.operators.statistics import irls

    q = clip(F.col(p))
    d = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(F.col(y).alias("y"), F.log(q / (1 - q)).alias("x"))
    if d.agg(F.countDistinct("y")).first()[0] < 2:
        return {"calibration_slope": math.nan, "calibration_intercept": math.nan}
    b = irls(d, ["x"], "y")["beta"]
    return {"calibration_slope": float(b[1]), "calibration_intercept": float(b[0])}


def fit_conformal(df: DataFrame, alpha: float = 0.1, mondrian: bool = True, y: str = "y", p: str = "p") -> DataFrame:
    """``(class, threshold, n_calibration)``: of the scores ``nonconformity`` of each class, or of all with
    ``mondrian=False``, the quantile that covers 1 - alpha of new rows; 1 for a class without rows."""
    d = df.where(F.col(y).isin(0, 1)).select(F.col(y).cast("int").alias("class"), nonconformity(F.col(y), F.col(p)).alias("s"))
    classes = df.sparkSession.createDataFrame([(0,), (1,)], "class int")
    n = d.agg(F.count("*").alias("n_calibration"))
    if mondrian:
        t = quantiles(d, ["class"], "s", {"q": conformal_level(alpha)}).select("class", F.col("quantile").alias("threshold"))
        t = classes.join(t, "class", "left")
    else:
        t = classes.crossJoin(quantiles(d, [], "s", {"q": conformal_level(alpha)}).select(F.col("quantile").alias("threshold")))
    return t.crossJoin(n).select("class", F.coalesce("threshold", F.lit(1.0)).alias("threshold"), "n_calibration")


def apply_conformal(df: DataFrame, fit: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``(n, coverage, mean_set_size, singleton_rate, abstention_rate, empty_rate, coverage_0, coverage_1)``
    of other rows under the thresholds of ``fit_conformal``."""
    t = fit.agg(F.max(F.when(F.col("class") == 0, F.col("threshold"))).alias("t0"), F.max(F.when(F.col("class") == 1, F.col("threshold"))).alias("t1"))
    one, zero = 1 - F.col(p) <= F.col("t1"), F.col(p) <= F.col("t0")
    size = one.cast("int") + zero.cast("int")
    covered = F.when(F.col(y) == 1, one).otherwise(zero).cast("double")
    share = lambda c: F.avg(c.cast("double"))
    return df.crossJoin(F.broadcast(t)).agg(F.count("*").alias("n"), F.avg(covered).alias("coverage"), share(size).alias("mean_set_size"), share(size == 1).alias("singleton_rate"), share(size == 2).alias("abstention_rate"), share(size == 0).alias("empty_rate"), F.avg(F.when(F.col(y) == 0, covered)).alias("coverage_0"), F.avg(F.when(F.col(y) == 1, covered)).alias("coverage_1"))


def fit_fpr_thresholds(df: DataFrame, targets: tuple[float, ...] = FPR_TARGETS, y: str = "y", p: str = "p") -> DataFrame:
    """``(fpr, threshold)`` from the negatives of a calibration partition; 1 if it has none."""
    t = quantiles(df.where(F.col(y) == 0), [], p, {str(f): F.lit(1 - f) for f in targets})
    wanted = df.sparkSession.createDataFrame([(str(f), f) for f in targets], "point string, fpr double")
    return wanted.join(t, "point", "left").select("fpr", F.coalesce("quantile", F.lit(1.0)).alias("threshold"))


def tpr_at_thresholds(df: DataFrame, fit: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``(fpr, threshold, tpr)``: the share of positives at or above each frozen threshold."""
    return df.where(F.col(y) == 1).crossJoin(F.broadcast(fit)).groupBy("fpr", "threshold").agg(F.avg((F.col(p) >= F.col("threshold")).cast("double")).alias("tpr"))


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def fit_selective_thresholds(df: DataFrame, coverages: tuple[float, ...] = COVERAGE_LEVELS, p: str = "p") -> DataFrame:
    """``(coverage, threshold)``: the confidence that so large a share of the calibration rows reaches; 0 for all."""
    t = quantiles(df.select(confidence(F.col(p)).alias("c")), [], "c", {str(c): F.lit(1 - c) for c in coverages if c < 1})
    wanted = df.sparkSession.createDataFrame([(str(c), c) for c in coverages], "point string, coverage double")
    return wanted.join(t, "point", "left").select("coverage", F.when(F.col("coverage") >= 1, F.lit(0.0)).otherwise(F.col("quantile")).alias("threshold"))


def apply_selective_thresholds(df: DataFrame, fit: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``(coverage, threshold, n_kept, empirical_coverage, risk, brier)`` of the rows at or above each frozen
    confidence; levels that keep no row are left out."""
    n = df.agg(F.count("*").alias("n_all"))
    keep = df.crossJoin(F.broadcast(fit)).where((F.col("coverage") >= 1) | (confidence(F.col(p)) >= F.col("threshold")))
    wrong = ((F.col(p) >= 0.5).cast("int") != F.col(y)).cast("double")
    g = keep.groupBy("coverage", "threshold").agg(F.count("*").alias("n_kept"), F.avg(wrong).alias("risk"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    return g.crossJoin(F.broadcast(n)).select("coverage", "threshold", "n_kept", (F.col("n_kept") / F.col("n_all")).alias("empirical_coverage"), "risk", "brier")


class CalibrationMismatch(ValueError):
    """A calibration was asked for by another detector, revision, task or cohort than it was fitted for."""


@dataclass(frozen=True)
class CalibrationBundle:
    """A calibration map and operating points, bound to what they were fitted for."""

    detector_id: str
    model_revision: str
    task: str
    cohort: str
    prevalence: float
    alpha: float
    conformal: dict[int, float]
    fpr_thresholds: dict[float, float]
    selective_thresholds: dict[float, float]
    knots: list[tuple[float, float]] | None = field(default=None)

    def identity(self) -> dict[str, str]:
        return {k: getattr(self, k) for k in ("detector_id", "model_revision", "task", "cohort")}

    def calibrate(self, p: Column, **identity: str) -> Column:
        """Calibrated scores; raises unless the caller names the same identity."""
        if identity != self.identity():
            raise CalibrationMismatch(f"fitted for {self.identity()}, not {identity}")
        return interpolate(p, self.knots)

    def to_json(self) -> str:
        body = {**self.identity(), "prevalence": self.prevalence, "alpha": self.alpha, "conformal": {str(k): v for k, v in sorted(self.conformal.items())}, "fpr_thresholds": {str(k): v for k, v in sorted(self.fpr_thresholds.items())}, "selective_thresholds": {str(k): v for k, v in sorted(self.selective_thresholds.items())}, "knots": self.knots}
        return json.dumps({**body, "sha256": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CalibrationBundle:
        """A bundle as written; raises if its content isn't what its hash says."""
        body = json.loads(text)
        named = body.pop("sha256", None)
        if named != hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest():
            raise CalibrationMismatch("the bundle was changed")
        number = lambda d, k: {k(a): b for a, b in d.items()}
        return cls(**{**body, "conformal": number(body["conformal"], int), "fpr_thresholds": number(body["fpr_thresholds"], float), "selective_thresholds": number(body["selective_thresholds"], float), "knots": None if body["knots"] is None else [tuple(k) for k in body["knots"]]})


def fit_bundle(df: DataFrame, detector_id: str, model_revision: str, task: str, cohort: str, alpha: float = 0.1, y: str = "y", p: str = "p") -> CalibrationBundle:
    """The isotonic map of a calibration partition, and its operating points on the calibrated scores."""
    knots = isotonic_knots(df, y, p)
    d = cut_lineage(df.select(F.col(y).alias("y"), interpolate(F.col(p), knots).alias("p")))
    pairs = lambda rows: {r[0]: r[1] for r in rows}
    return CalibrationBundle(
        detector_id, model_revision, task, cohort, float(d.agg(F.avg(F.col("y").cast("double"))).first()[0] or np.nan), alpha,
        pairs(fit_conformal(d, alpha).select("class", "threshold").collect()), pairs(fit_fpr_thresholds(d).collect()), pairs(fit_selective_thresholds(d).collect()), knots,
    )


def operating_report(calibration: DataFrame, test: DataFrame, alpha: float = 0.1, y: str = "y", p: str = "p") -> DataFrame:
    """``(block, point, value)``: conformal coverage and set sizes, true positive rates and selective risks of
    a test partition, all at thresholds fitted on the calibration partition alone."""
    c = apply_conformal(test, fit_conformal(calibration, alpha, y=y, p=p), y, p)
    parts = [c.select(F.lit("conformal").alias("block"), F.explode(F.array(*(F.struct(F.lit(m).alias("point"), F.col(m).cast("double").alias("value")) for m in ("coverage", "mean_set_size", "singleton_rate", "abstention_rate", "empty_rate")))).alias("x")).select("block", "x.*")]
    parts.append(tpr_at_thresholds(test, fit_fpr_thresholds(calibration, y=y, p=p), y, p).select(F.lit("tpr_at_fpr").alias("block"), F.col("fpr").cast("string").alias("point"), F.col("tpr").alias("value")))
    parts.append(apply_selective_thresholds(test, fit_selective_thresholds(calibration, p=p), y, p).select(F.lit("selective_risk").alias("block"), F.col("coverage").cast("string").alias("point"), F.col("risk").alias("value")))
    return parts[0].union(parts[1]).union(parts[2])


def fit_select_calibrate_test(candidates: dict[str, str], df: DataFrame, partition: str = "partition", alpha: float = 0.1, y: str = "y") -> DataFrame:
    """``(selected, block, point, value)``: of the score columns ``candidates`` (name to column, fitted on
    train) the one with the best AUROC on development is calibrated on calibration and reported on test,
    each partition for its one purpose. Ties go to the first name."""
    from textloom.operators.metrics import auroc

    dev = df.where(F.col(partition) == "development")
    best = max(sorted(candidates), key=lambda n: auroc(dev, [], y, candidates[n]).first()[0] or 0.0)
    cal, test = (df.where(F.col(partition) == part) for part in ("calibration", "test"))
    knots = isotonic_knots(cal, y, candidates[best])
    mapped = lambda d: d.select(F.col(y).alias("y"), interpolate(F.col(candidates[best]), knots).alias("p"))
    return operating_report(mapped(cal), mapped(test), alpha).withColumn("selected", F.lit(best))
