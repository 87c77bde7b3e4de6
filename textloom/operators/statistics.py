"""Hypothesis tests and regression diagnostics from one or two aggregation passes.

Data-sized work is aggregated by Spark; what reaches the driver is a row of moments or a matrix of
at most a few dozen columns, on which the closed forms are evaluated.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.metrics import by_score
from textloom.operators.ranks import quantiles, running, same_keys


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 1000):
        for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + e * d or 1e-300)
            c = 1 + e / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    p = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return p if t >= 0 else 1 - p


def welch(df: DataFrame, value: str, split: Column, keys: list[str] | None = None) -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d of ``value`` between rows where ``split`` holds and the others."""
    a = lambda f, c: f(F.when(c, F.col(value)))
    g = df.groupBy(*(keys or [])).agg(F.count(F.when(split, F.col(value))).alias("n1"), F.count(F.when(~split, F.col(value))).alias("n0"), a(F.avg, split).alias("m1"), a(F.avg, ~split).alias("m0"), a(F.var_samp, split).alias("v1"), a(F.var_samp, ~split).alias("v0"))
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return g.select(*(keys or []), "n1", "n0", ((F.col("m1") - F.col("m0")) / F.sqrt(s1 + s0)).alias("t"), ((s1 + s0) * (s1 + s0) / (s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1))).alias("df"), ((F.col("m1") - F.col("m0")) / pooled).alias("cohens_d"))


def mann_whitney(df: DataFrame, value: str, split: Column) -> DataFrame:
    """U of the rows where ``split`` holds, rank-biserial correlation 1 - 2 U / (n1 n0), which is positive
    where their values tend to be lower, and z with tie correction. Ranks are counted over distinct values."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(F.when(split, 1).otherwise(0)).alias("a"), F.sum(F.when(split, 0).otherwise(1)).alias("b"))
    g = running(g, [], value, ["b"]).withColumn("t", F.col("a") + F.col("b"))
    s = g.agg(F.sum(F.col("a") * (F.col("b_below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    sd = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("n1", "n0", "u", (1 - 2 * F.col("u") / (n1 * n0)).alias("rank_biserial"), ((F.col("u") - n1 * n0 / 2) / sd).alias("z"))


def benjamini_hochberg(df: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """``df`` with ``q_value``: the smallest m p / rank over the p values from the row's own on, at most 1;
    null p values keep null. Each family (all rows, if none is named) is one set of tests. Ranks and
    the running minimum are counted over ranges of distinct p values."""
    fam = family or []
    g = running(df.where(F.col(p).isNotNull()).groupBy(*fam, p).agg(F.count("*").alias("rows")), fam, p, ["rows"])
    g = g.withColumn("_q", F.col("all_rows") * F.col(p) / (F.col("rows_below") + F.col("rows")))
    g = least_from(g, fam, p, "_q").select(*(F.col(c).alias(f"{c}_k") for c in [*fam, p]), "_least")
    return df.join(g, same_keys([*fam, p]), "left").withColumn("q_value", F.when(F.col("_least").isNotNull(), F.least(F.lit(1.0), "_least"))).drop("_least", *(f"{c}_k" for c in [*fam, p]))


def least_from(g: DataFrame, keys: list[str], value: str, of: str, ranges: int = 64) -> DataFrame:
    """``g`` with ``_least``: the smallest ``of`` over rows of the same keys with this ``value`` or more."""
    cuts = g.agg(F.percentile_approx(value, F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1))), F.lit(20 * ranges)).alias("_cuts"))
    d = g.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter(F.coalesce("_cuts", F.array(F.col(value))), lambda c: c < F.col(value)))).drop("_cuts")
    per = d.groupBy(*keys, "_part").agg(F.min(of).alias("_m"))
    after = W.partitionBy(*keys).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*(F.col(k).alias(f"{k}_k") for k in keys), F.col("_part").alias("_part_k"), F.min("_m").over(after).alias("_later"))
    d = d.join(per, same_keys([*keys, "_part"])).drop(*(f"{k}_k" for k in [*keys, "_part"]))
    inner = W.partitionBy(*keys, "_part").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return d.withColumn("_least", F.least(F.min(of).over(inner), "_later")).drop("_part", "_later")


def t_quantile(q: float, df: float) -> float:
    """Quantile of Student's t above one half, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < q else (low, mid)
    return (low + high) / 2


def directed(p_two: float, estimate: float, direction: str) -> float:
    """One-sided p from a two-sided one, where the estimate is expected above (``greater``) or below 0 (``lower``)."""
    if direction == "two-sided":
        return p_two
    return p_two / 2 if (estimate > 0) == (direction == "greater") and estimate != 0 else 1 - p_two / 2


def welch_test(df: DataFrame, value: str, split: Column, direction: str = "two-sided") -> dict:
    """Welch's t of the rows where ``split`` holds against the others, its degrees of freedom, the difference
    with its 95 % interval, Cohen's d and the p value."""
    r = welch_moments(df, value, split).first()
    a, b = r["v1"] / r["n1"], r["v0"] / r["n0"]
    n = (a + b) ** 2 / (a * a / (r["n1"] - 1) + b * b / (r["n0"] - 1)) if a + b else 1.0
    diff, se = r["m1"] - r["m0"], math.sqrt(a + b)
    t = diff / se if se else 0.0
    half = t_quantile(0.975, n) * se
    pooled = math.sqrt(((r["n1"] - 1) * r["v1"] + (r["n0"] - 1) * r["v0"]) / max(r["n1"] + r["n0"] - 2, 1))
    return {"t": t, "df": n, "difference": diff, "low": diff - half, "high": diff + half, "cohens_d": diff / pooled if pooled else 0.0, "p_value": directed(min(1.0, 2 * t_sf(abs(t), n)), diff, direction)}


def welch_moments(df: DataFrame, value: str, split: Column) -> DataFrame:
    a = lambda f, c: f(F.when(c, F.col(value)))
    return df.agg(F.count(F.when(split, F.col(value))).alias("n1"), F.count(F.when(~split, F.col(value))).alias("n0"), a(F.avg, split).alias("m1"), a(F.avg, ~split).alias("m0"), a(F.var_samp, split).alias("v1"), a(F.var_samp, ~split).alias("v0"))


def mann_whitney_test(df: DataFrame, value: str, split: Column, direction: str = "two-sided") -> dict:
    """``mann_whitney`` with a p value by the normal approximation, with continuity correction."""
    r = mann_whitney(df, value, split).first()
    sd = (r["u"] - r["n1"] * r["n0"] / 2) / r["z"] if r["z"] else 0.0
    z = max(0.0, abs(r["u"] - r["n1"] * r["n0"] / 2) - 0.5) / abs(sd) if sd else 0.0
    return {**r.asDict(), "p_value": directed(min(1.0, 2 * normal_sf(z)), -r["rank_biserial"], direction)}


def pseudo_r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """``(mcfadden, tjur)``: 1 less the ratio of log likelihoods of the scores and of the base rate; the
    difference of mean scores of both classes, 0 if one is missing."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    g = df.agg(F.sum(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("ll"), F.avg(F.col(y).cast("double")).alias("r"), F.count("*").alias("n"), F.avg(F.when(F.col(y) == 1, F.col(p))).alias("a"), F.avg(F.when(F.col(y) == 0, F.col(p))).alias("b"))
    null = F.col("n") * (F.col("r") * F.log("r") + (1 - F.col("r")) * F.log(1 - F.col("r")))
    inside = (F.col("r") > 0) & (F.col("r") < 1)
    return g.select(F.when(inside, 1 - F.col("ll") / null).otherwise(0.0).alias("mcfadden"), F.when(inside, F.col("a") - F.col("b")).otherwise(0.0).alias("tjur"))


def permutation_manova(df: DataFrame, columns: list[str], group: str, id_: str, permutations: int = 199, seed: int = 13) -> dict:
    """Wilks' lambda and the share of permutations of the groups among the rows with one as small, itself counted in.
    In each permutation a row takes the group of the row whose place by id is its own place by a hash. The
    total cross-products stay the same, so a permutation is told by its groups' sums: all are one job, and
    the driver gets a row per permutation and group."""
    from textloom.operators.ranks import ranked

    d = df.where(" and ".join(f"`{c}` is not null" for c in [*columns, group])).select(id_, group, *columns)
    n, s, m = moments(d, columns)
    total = m - np.outer(s, s) / n
    places = ranked(d.select(id_, group).withColumn("_v", F.lit(0)), [], "_v", id_, "_to").select("_to", F.col(group).alias("_label"))
    mixed = d.drop(group).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_v", F.xxhash64(F.lit(seed), "_k", id_))
    mixed = ranked(mixed, ["_k"], "_v", id_, "_to").join(places, "_to").select("_k", "_label", *columns)
    own = d.select(F.lit(0).alias("_k"), F.col(group).alias("_label"), *columns)
    between: dict[int, np.ndarray] = {}
    for r in own.union(mixed).groupBy("_k", "_label").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(columns))).collect():
        v = np.array([float(r[f"s{i}"]) for i in range(len(columns))])
        between[r["_k"]] = between.get(r["_k"], -np.outer(s, s) / n) + np.outer(v, v) / r["n"]
    values = {k: float(np.linalg.det(total - b) / np.linalg.det(total)) for k, b in between.items()}
    below = sum(v <= values[0] + 1e-12 for k, v in values.items() if k)
    return {"wilks_lambda": values[0], "p_value": (below + 1) / (permutations + 1), "permutations": permutations}


def durbin_watson_permutation(df: DataFrame, value: str, key: str, order: list[str], permutations: int = 199, seed: int = 13) -> DataFrame:
    """``(dw, p_value, permutations)``: the statistic over a key's neighbours, and the share of orders within keys,
    shuffled by hashes, with one as small, itself counted in. All permutations are one job."""
    d = df.withColumn("_e", F.col(value) - F.avg(value).over(W.partitionBy(key))).select(key, *order, "_e")
    d = d.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    place = F.when(F.col("_p") > 0, F.xxhash64(F.lit(seed), "_p", key, *order))
    w = W.partitionBy(key, "_p").orderBy(place, *order)
    g = d.withColumn("_d", F.col("_e") - F.lag("_e").over(w)).groupBy("_p").agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("_e") * F.col("_e"))).alias("dw"))
    own = g.where("_p = 0").select(F.col("dw").alias("_own"))  # one row
    return g.crossJoin(F.broadcast(own)).agg(F.max("_own").alias("dw"), ((F.sum(((F.col("_p") > 0) & (F.col("dw") <= F.col("_own") + 1e-12)).cast("int")) + 1) / (permutations + 1)).alias("p_value"), F.lit(permutations).alias("permutations"))


def calibration_power(df: DataFrame, y: str = "y", p: str = "p", effects: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05), alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``(metric, variance, effect, required_n)``: rows needed to see a difference in the Brier score, by the variance of
    its terms, and in the calibration error, by a proxy from the binomial variances of its bins."""
    from statistics import NormalDist

    from textloom.operators.metrics import reliability

    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    b = df.agg(F.coalesce(F.var_samp((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), F.lit(0.0)).alias("variance")).withColumn("metric", F.lit("brier"))
    n = df.agg(F.count("*").alias("all"))
    c, a = F.col("mean_predicted"), F.col("observed")
    e = reliability(df, [], y, p).crossJoin(F.broadcast(n)).agg((F.sum(F.col("n") / F.col("all") * (c * (1 - c) + a * (1 - a))) * (1 - 2 / math.pi)).alias("variance")).withColumn("metric", F.lit("ece"))
    x = b.unionByName(e).withColumn("effect", F.explode(F.array(*map(F.lit, effects))))
    need = F.ceil(F.lit(z * z) * F.col("variance") / (F.col("effect") * F.col("effect")))
    return x.select("metric", "variance", "effect", F.when(F.col("variance") > 0, need).otherwise(0).alias("required_n"))


def mcnemar(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Counts of rows that only one of two classifiers has right, and the continuity-corrected statistic."""
    c = df.agg(F.sum((a & ~b).cast("int")).alias("only_a"), F.sum((~a & b).cast("int")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    d = F.greatest(F.lit(0.0), F.abs(F.col("only_a") - F.col("only_b")) - 1.0)
    return c.withColumn("chi2", F.when(n > 0, d * d / n).otherwise(0.0))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact binomial below 25 disagreements, else chi square with continuity correction."""
    n, k = only_a + only_b, min(only_a, only_b)
    if not n:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    return chi2_sf(max(0.0, abs(only_a - only_b) - 1) ** 2 / n, 1)


def durbin_watson(df: DataFrame, value: str, key: str, order: list[str]) -> DataFrame:
    """Sum of squared differences of neighbours over the sum of squares about each key's mean."""
    w = W.partitionBy(key)
    d = df.withColumn("_e", F.col(value) - F.avg(value).over(w))
    d = d.withColumn("_d", F.col("_e") - F.lag("_e").over(w.orderBy(*order)))
    return d.agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("_e") * F.col("_e"))).alias("dw"), F.count("*").alias("n"))


def jarque_bera(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Skewness, excess kurtosis, the statistic and its p value (chi square of two degrees)."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    return g.withColumn("jb", F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)).withColumn("p_value", F.exp(-F.col("jb") / 2))


def moments(df: DataFrame, columns: list[str], weight: Column | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, sums and cross-products of the columns, in one pass; a matrix of columns goes
    to the driver."""
    w = weight if weight is not None else F.lit(1.0)
    d = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    k = len(columns)
    aggs = [F.sum(w)] + [F.sum(w * F.col(c)) for c in columns] + [F.sum(w * F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k)]
    row = [float(x or 0) for x in d.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()]
    m = np.zeros((k, k))
    it = iter(row[k + 1 :])
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = next(it)
    return row[0], np.array(row[1 : k + 1]), m


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    n, s, m = moments(df, columns)
    c = m / n - np.outer(s, s) / n**2
    d = np.sqrt(np.clip(np.diag(c), 1e-300, None))
    return c / np.outer(d, d)


def inflations(r: np.ndarray) -> np.ndarray:
    """Variance inflation of each column of a correlation matrix: 1 / (1 - R squared) on the others; a column that the
    others make up has 1e12, also where the matrix is singular."""
    out = []
    for j in range(len(r)):
        rest = [i for i in range(len(r)) if i != j]
        r2 = float(r[j, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=1e-10) @ r[rest, j]) if rest else 0.0
        out.append(1 / max(1 - r2, 1e-12))
    return np.array(out)


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation of each column."""
    return dict(zip(columns, inflations(correlations(df, columns)).tolist()))


def screen_features(df: DataFrame, columns: list[str], most: float = 10.0) -> list[str]:
    """Columns left after dropping the worst until every inflation is at most ``most``."""
    r, left = correlations(df, columns), list(range(len(columns)))
    while len(left) > 1:
        v = inflations(r[np.ix_(left, left)])
        if v.max() <= most:
            break
        left.pop(int(v.argmax()))
    return [columns[i] for i in left]


def condition_number(df: DataFrame, columns: list[str]) -> float:
    e = np.linalg.eigvalsh(correlations(df, columns))
    return float(math.sqrt(e[-1] / max(e[0], 1e-300)))


def ols(df: DataFrame, x: list[str], y: str) -> dict:
    """Coefficients (intercept first), R squared and number of rows, from one pass."""
    n, s, m = moments(df, [*x, y])
    k = len(x)
    a = np.zeros((k + 1, k + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = n, s[:k], s[:k], m[:k, :k]
    b = np.concatenate([[s[k]], m[:k, k]])
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    total = m[k, k] - s[k] ** 2 / n
    rest = m[k, k] - 2 * beta @ b + beta @ a @ beta
    return {"beta": beta, "r2": 1 - rest / total if total else float("nan"), "n": n, "rss": rest}


def irls(df: DataFrame, x: list[str], y: str, ridge: float = 1e-6, rounds: int = 50, tolerance: float = 1e-10) -> dict:
    """Logistic regression by Newton steps; each is one pass that aggregates the normal equations."""
    k = len(x) + 1
    beta = np.zeros(k)
    d = df.where(" and ".join(f"`{c}` is not null" for c in [*x, y]))
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    for step in range(rounds):
        eta = sum((float(b) * c for b, c in zip(beta, cols)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))
        v = d.withColumn("_p", p)
        w, r = F.col("_p") * (1 - F.col("_p")), F.col(y) - F.col("_p")
        aggs = [F.sum(w * cols[i] * cols[j]) for i in range(k) for j in range(i, k)] + [F.sum(r * c) for c in cols] + [F.sum(F.when(F.col(y) == 1, F.log(F.col("_p"))).otherwise(F.log1p(-F.col("_p"))))]
        row = [float(z or 0) for z in v.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()]
        h = np.zeros((k, k))
        it = iter(row)
        for i in range(k):
            for j in range(i, k):
                h[i, j] = h[j, i] = next(it)
        g = np.array(row[-k - 1 : -1]) - ridge * beta
        cov = np.linalg.inv(h + ridge * np.eye(k))
        move = cov @ g
        beta = beta + move
        if np.abs(move).max() < tolerance * (1 + np.abs(beta).max()):
            break
    else:
        raise RuntimeError(f"the fit is not stable after {rounds} rounds; the classes may be separable")
    return {"beta": beta, "cov": cov, "log_likelihood": row[-1], "rounds": step + 1}


def likelihood_ratio_test(df: DataFrame, x: list[str], less: list[str], y: str) -> dict:
    """Whether ``x`` explains ``y`` better than the columns ``less`` alone."""
    full, small = irls(df, x, y), irls(df, less, y)
    stat = 2 * (full["log_likelihood"] - small["log_likelihood"])
    return {"statistic": stat, "df": len(x) - len(less), "p_value": chi2_sf(max(stat, 0.0), len(x) - len(less))}


def link_test(df: DataFrame, x: list[str], y: str, powers: int = 2) -> dict:
    """Whether powers of the fitted linear predictor add anything (link test, or RESET for more)."""
    b = irls(df, x, y)["beta"]
    d = df.withColumn("_eta", sum((float(c) * F.col(n) for c, n in zip(b[1:], x)), F.lit(float(b[0]))))
    d = d.withColumns({f"_eta{k}": F.pow("_eta", F.lit(float(k))) for k in range(2, powers + 1)})
    return likelihood_ratio_test(d, ["_eta", *(f"_eta{k}" for k in range(2, powers + 1))], ["_eta"], y)


def breusch_pagan(df: DataFrame, x: list[str], y: str) -> dict:
    b = ols(df, x, y)["beta"]
    d = df.withColumn("_e", F.col(y) - sum((float(c) * F.col(n) for c, n in zip(b[1:], x)), F.lit(float(b[0])))).withColumn("_e2", F.col("_e") * F.col("_e"))
    r = ols(d, x, "_e2")
    lm = r["n"] * r["r2"]
    return {"lm": lm, "df": len(x), "p_value": chi2_sf(max(lm, 0.0), len(x))}


def hosmer_lemeshow(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Statistic over bins between the exact quantiles of p, the last closed, number of bins and degrees of
    freedom (``chi2_sf`` gives the p value)."""
    qs = quantiles(df, [], p, {str(i): F.lit(i / bins) for i in range(bins + 1)}, higher=False).agg(F.array_sort(F.collect_set("quantile")).alias("q"))  # one row of bins + 1 values
    d = df.crossJoin(F.broadcast(qs))
    b = F.greatest(F.lit(1), F.least(F.size(F.filter("q", lambda e: e <= F.col(p))), F.size("q") - 1))
    g = d.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(p).alias("e"), F.sum(F.col(y)).alias("o"))
    return g.agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / (F.col("e") * (1 - F.col("e") / F.col("n")))).alias("statistic"), F.count("*").alias("bins"), F.greatest(F.count("*") - 2, F.lit(1)).alias("df"))


def hosmer_lemeshow_test(df: DataFrame, y: str, p: str, bins: int = 10) -> dict:
    r = hosmer_lemeshow(df, y, p, bins).first()
    return {**r.asDict(), "p_value": chi2_sf(r["statistic"] or 0.0, r["df"])}


def delong(df: DataFrame, y: str, a: str, b: str) -> dict:
    """Difference of two correlated AUROCs and its z: each row's placement among the other class comes
    from counts over distinct scores."""
    d = df.withColumn("_y", F.col(y).cast("int"))
    for s in (a, b):
        t = by_score(d, [], "_y", s).select(F.col(s).alias("_s"), ((F.col("neg_below") + F.col("neg") / 2) / F.col("all_neg")).alias("_v"), (1 - (F.col("pos_below") + F.col("pos") / 2) / F.col("all_pos")).alias("_w"))
        d = d.join(t, F.col(s) == F.col("_s")).withColumn(f"_{s}_v", F.when(F.col("_y") == 1, F.col("_v")).otherwise(F.col("_w"))).drop("_s", "_v", "_w")
    g = {r["_y"]: r for r in d.groupBy("_y").agg(F.count("*").alias("n"), F.avg(f"_{a}_v").alias("a"), F.avg(f"_{b}_v").alias("b"), F.var_samp(f"_{a}_v").alias("va"), F.var_samp(f"_{b}_v").alias("vb"), F.covar_samp(f"_{a}_v", f"_{b}_v").alias("c")).collect()}
    var = sum((r["va"] + r["vb"] - 2 * r["c"]) / r["n"] for r in g.values())
    diff = g[1]["a"] - g[1]["b"]
    z = diff / math.sqrt(var) if var > 0 else 0.0
    return {"auc_a": g[1]["a"], "auc_b": g[1]["b"], "z": z, "p_value": min(1.0, 2 * normal_sf(abs(z)))}


def wilks_lambda(df: DataFrame, columns: list[str], group: str) -> float:
    """det(within) / det(total), from cross-products by group."""
    n, s, m = moments(df, columns)
    total = m - np.outer(s, s) / n
    means = df.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns))
    between = moments(means.select(*((F.col(c) / F.sqrt(F.col("n"))).alias(c) for c in columns)), columns)[2]
    return float(np.linalg.det(m - between) / np.linalg.det(total))


def cooks_distance(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """``df`` with leverage and Cook's distance of the logistic fit."""
    fit = irls(df, x, y)
    b, cov = fit["beta"], fit["cov"]
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    eta = sum((float(c) * v for c, v in zip(b, cols)), F.lit(0.0))
    d = df.withColumn("_p", 1 / (1 + F.exp(-eta)))
    quad = sum((float(cov[i, j]) * cols[i] * cols[j] for i in range(len(b)) for j in range(len(b))), F.lit(0.0))
    w = F.col("_p") * (1 - F.col("_p"))
    d = d.withColumn("leverage", w * quad)
    r2 = (F.col(y) - F.col("_p")) * (F.col(y) - F.col("_p")) / w
    return d.withColumn("cooks_d", r2 * F.col("leverage") / (len(b) * (1 - F.col("leverage")) * (1 - F.col("leverage")))).drop("_p")
