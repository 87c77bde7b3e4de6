"""Metrics of scored documents (label 0/1 and probability), by group columns.

A window over the rows of a group would be one task; so ranks are counted over distinct scores, in
ranges of them (``ranks``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranks import quantiles, ranked, running

#: Bin edges i / 10 as a linear space gives them.
EDGES = tuple(i * 0.1 for i in range(11))
# Levels of coverage and rates of false positives that are reported.
COVERAGE_LEVELS = (1.0, 0.95, 0.9, 0.8, 0.7, 0.5)
FPR_TARGETS = (0.001, 0.01, 0.05)


def by_score(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Per group and distinct score: positives and negatives, and how many lie below it."""
    g = df.groupBy(*keys, p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    return running(g, keys, p, ["pos", "neg"])


def auroc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """``(keys, auroc)``: rank statistic with ties counted half; null where a class is missing."""
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return by_score(df, keys, y, p).groupBy(*keys).agg((area / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    s = by_score(df, keys, y, p)
    tp = F.col("all_pos") - F.col("pos_below")
    fp = F.col("all_neg") - F.col("neg_below")
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return s.groupBy(*keys).agg(F.when(both, F.sum(F.col("pos") * tp / (tp + fp)) / F.max("all_pos")).alias("auprc"))


def bin_of(p: Column) -> Column:
    """Number of the bin [edge, next edge); a probability of 1 is in none."""
    b = F.lit(None).cast("int")
    for i in range(10):
        b = F.when((p >= EDGES[i]) & (p < (EDGES[i + 1] if i < 9 else 1.0)), i).otherwise(b)
    return b


def reliability(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    d = df.withColumn("bin", bin_of(F.col(p))).where("bin is not null")
    return d.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"))


def calibration_error(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    r = reliability(df, keys, y, p).groupBy(*keys).agg(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))).alias("e"))
    n = df.groupBy(*keys).agg(F.count("*").alias("n_all"))
    joined = n.join(r, keys, "left") if keys else n.crossJoin(r)
    return joined.select(*keys, (F.coalesce("e", F.lit(0.0)) / F.col("n_all")).alias("ece"))


def adaptive_error(df: DataFrame, y: str = "y", p: str = "p", id_: str = "doc_id", bins: int = 10) -> DataFrame:
    """Error over bins of equal mass; rows of equal score come in the order of their id's digest."""
    r = ranked(df, [], p, id_, "i").withColumn("bin", F.floor(((F.col("i") + 1) * bins - 1) / F.col("all_rows")).cast("int"))
    b = r.groupBy("bin").agg(F.count("*").alias("m"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"), F.max("all_rows").alias("n"))
    return b.agg(F.sum(F.col("m") / F.col("n") * F.abs(F.col("mp") - F.col("my"))).alias("adaptive_ece"), F.count("*").alias("bins"))


def threshold_at_fpr(df: DataFrame, keys: list[str], fpr: float, y: str = "y", p: str = "p") -> DataFrame:
    """``(keys, threshold)``: the "higher" quantile at 1 - fpr of the negatives' scores."""
    return quantiles(df.where(F.col(y) == 0), keys, p, {"q": F.lit(1 - fpr)}).select(*keys, F.col("quantile").alias("threshold"))


def tpr_at_fpr(df: DataFrame, keys: list[str], fpr: float, y: str = "y", p: str = "p") -> DataFrame:
    t = threshold_at_fpr(df, keys, fpr, y, p)
    pos = df.where(F.col(y) == 1)
    j = pos.join(F.broadcast(t), keys) if keys else pos.crossJoin(F.broadcast(t))  # a row per group
    return j.groupBy(*keys).agg(F.avg((F.col(p) >= F.col("threshold")).cast("double")).alias("tpr"))


def binary_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """AUROC, average precision, Brier, calibration error, accuracy and true positive rates, by group. Where
    a class is missing, ranking metrics are null."""
    d = df.withColumn("_all", F.lit(1)) if not keys else df
    ks = keys or ["_all"]
    base = d.groupBy(*ks).agg(F.count("*").alias("n"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"))
    out = base.join(auroc(d, ks, y, p), ks, "left").join(average_precision(d, ks, y, p), ks, "left").join(calibration_error(d, ks, y, p), ks, "left")
    for name, f in (("tpr_at_01fpr", 0.001), ("tpr_at_1fpr", 0.01), ("tpr_at_5fpr", 0.05)):
        out = out.join(tpr_at_fpr(d, ks, f, y, p).withColumnRenamed("tpr", name), ks, "left")
    return out.drop("_all")


def worst_groups(df: DataFrame, key: str, least: int = 4, y: str = "y", p: str = "p") -> DataFrame:
    """Worst AUROC, Brier and calibration error over groups with both classes and enough rows."""
    ok = df.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(y).alias("k")).where(f"n >= {least} and k > 1").select(key)
    m = binary_metrics(df.join(ok, key, "left_semi"), [key], y, p)
    return m.agg(F.count("*").alias("groups"), F.min("auroc").alias("worst_auroc"), F.max("brier").alias("worst_brier"), F.max("ece").alias("worst_ece"))


def slices(df: DataFrame, columns: list[str], least: int = 4, y: str = "y", p: str = "p") -> DataFrame:
    """Brier, accuracy and base rate of each value of several columns: grouping sets in one pass."""
    long = df.select(y, p, F.explode(F.array(*(F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s")).select(y, p, "s.*")
    g = long.groupBy("slice", "value").agg(F.count("*").alias("n"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.avg(F.col(y).cast("double")).alias("base_rate"))
    return g.where(F.col("n") >= least)


def coverage_curve(df: DataFrame, y: str = "y", p: str = "p", steps: int = 10) -> DataFrame:
    ts = [0.5 + i * 0.49 / (steps - 1) for i in range(steps)]
    conf = F.greatest(F.col(p), 1 - F.col(p))
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")
    d = df.select(conf.alias("c"), right.alias("r"))
    n = d.agg(F.count("*").alias("n_all"))
    d = d.select("r", F.explode(F.filter(F.array(*(F.struct(F.lit(i).alias("step"), F.lit(t).alias("t")) for i, t in enumerate(ts))), lambda s: F.col("c") >= s.t)).alias("s"))
    return d.groupBy("s.step").agg(F.count("*").alias("n_kept"), F.avg(F.col("r").cast("double")).alias("accuracy")).crossJoin(F.broadcast(n)).select("step", "n_kept", (F.col("n_kept") / F.col("n_all")).alias("coverage"), "accuracy")


def nonconformity(y: Column, p: Column) -> Column:
    return F.when(y == 1, 1 - p).otherwise(p)


def conformal_level(alpha: float) -> Column:
    """The quantile of ``all_rows`` scores that covers 1 - alpha of new ones."""
    n = F.col("all_rows")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n))


def conformal(df: DataFrame, alpha: float = 0.1, y: str = "y", p: str = "p") -> DataFrame:
    """Split conformal sets: threshold, mean set size, coverage, singleton and abstention rates."""
    d = df.withColumn("s", nonconformity(F.col(y), F.col(p)))
    t = quantiles(d, [], "s", {"q": conformal_level(alpha)}).select(F.col("quantile").alias("threshold"))
    x = d.crossJoin(F.broadcast(t))  # one row
    one, zero = 1 - F.col(p) <= F.col("threshold"), F.col(p) <= F.col("threshold")
    size = one.cast("int") + zero.cast("int")
    covered = F.when(F.col(y) == 1, one).otherwise(zero)
    return x.agg(F.max("threshold").alias("threshold"), F.avg(size.cast("double")).alias("mean_set_size"), F.avg(covered.cast("double")).alias("coverage"), F.avg((size == 1).cast("double")).alias("singleton_rate"), F.avg((size == 2).cast("double")).alias("abstention_rate"))


def sliced_conformal(df: DataFrame, columns: list[str], alpha: float = 0.1, least: int = 30, y: str = "y", p: str = "p") -> DataFrame:
    """``(slice, value, n, coverage, gap)``: coverage of the pooled threshold in each value of several
    columns with at least ``least`` rows, and how far that is from 1 - alpha; the slice ``pooled``
    is all rows."""
    d = df.withColumn("s", nonconformity(F.col(y), F.col(p)))
    t = quantiles(d, [], "s", {"q": conformal_level(alpha)}).select(F.col("quantile").alias("threshold"))
    parts = [F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("value")) for c in columns]
    long = d.crossJoin(F.broadcast(t)).select((F.col("s") <= F.col("threshold")).cast("double").alias("ok"), F.explode(F.array(F.struct(F.lit("pooled").alias("slice"), F.lit("all").alias("value")), *parts)).alias("x"))
    g = long.groupBy("x.slice", "x.value").agg(F.count("*").alias("n"), F.avg("ok").alias("coverage"))
    return g.where((F.col("n") >= least) | (F.col("slice") == "pooled")).withColumn("gap", F.col("coverage") - (1 - alpha))


def selective_risk(df: DataFrame, coverages: tuple[float, ...] = COVERAGE_LEVELS, y: str = "y", p: str = "p", id_: str = "doc_id") -> DataFrame:
    """Error and Brier score among the most confident share of rows, ties in the order of the id's digest."""
    d = df.select(id_, (-F.greatest(F.col(p), 1 - F.col(p))).alias("c"), ((F.col(p) >= 0.5).cast("int") != F.col(y)).cast("int").alias("wrong"), ((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"))
    r = ranked(d, [], "c", id_, "r")
    keep = F.filter(F.array(*map(F.lit, coverages)), lambda q: F.col("r") < F.greatest(F.lit(1), F.ceil(q * F.col("all_rows") - 1e-9)))
    return r.select("wrong", "sq", F.explode(keep).alias("coverage")).groupBy("coverage").agg(F.count("*").alias("n_kept"), F.avg(F.col("wrong").cast("double")).alias("risk"), F.avg("sq").alias("brier"))


def poisson(u: Column) -> Column:
    """Poisson(1) by inversion; beyond 12 its chance is below what 32 bits of ``u`` can tell."""
    cdf, k, out = 0.0, 1.0, F.lit(0)
    for i in range(13):
        k = k / i if i else 1.0
        cdf += 0.36787944117144233 * k
        out = out + F.when(u >= cdf, 1).otherwise(0)
    return out


def _drawn(s: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """Rows of ``s`` once for each replicate in which their group is drawn, with the multiplicity ``m``."""
    s = s.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("replicate").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return s.withColumn("m", poisson(u)).where("m > 0")


def group_bootstrap(df: DataFrame, group: str, replicates: int = 200, seed: int = 11, y: str = "y", p: str = "p") -> DataFrame:
    """``(replicate, brier, accuracy)``: whole groups are drawn again with Poisson(1) multiplicities by
    hash; rows are first reduced to each group's sums. Null groups are in no replicate."""
    s = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"), F.sum(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")).alias("ok"))
    s = _drawn(s, group, replicates, seed)
    return s.groupBy("replicate").agg((F.sum(F.col("m") * F.col("sq")) / F.sum(F.col("m") * F.col("n"))).alias("brier"), (F.sum(F.col("m") * F.col("ok")) / F.sum(F.col("m") * F.col("n"))).alias("accuracy"))


def bootstrap_auroc(df: DataFrame, group: str, replicates: int = 200, seed: int = 11, y: str = "y", p: str = "p") -> DataFrame:
    """``(replicate, auroc)`` over whole groups drawn as in ``group_bootstrap``; replicates with one class
    are left out. Each replicate ranks its own rows, so this costs as much as its replicates do."""
    s = df.where(F.col(group).isNotNull()).groupBy(group, p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    g = _drawn(s, group, replicates, seed).groupBy("replicate", p).agg(F.sum(F.col("m") * F.col("pos")).alias("pos"), F.sum(F.col("m") * F.col("neg")).alias("neg"))
    g = running(g, ["replicate"], p, ["pos", "neg"]).where("all_pos > 0 and all_neg > 0")
    return g.groupBy("replicate").agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)) / (F.max("all_pos") * F.max("all_neg"))).alias("auroc"))


def interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """``(low, high, n_boot)``: percentile interval of a statistic over replicates, of which there are few."""
    a = (1 - level) / 2
    q = F.percentile(value, F.array(F.lit(a), F.lit(1 - a)))
    return replicates.agg(q[0].alias("low"), q[1].alias("high"), F.count(value).alias("n_boot"))


def group_bootstrap_ci(df: DataFrame, group: str, replicates: int = 200, seed: int = 11, level: float = 0.95, y: str = "y", p: str = "p") -> DataFrame:
    """``(metric, point, low, high, n_boot)`` of AUROC, Brier score and accuracy over resampled groups."""
    d = df.where(F.col(group).isNotNull())
    point = binary_metrics(d, [], y, p).select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in ("auroc", "brier", "accuracy")))).alias("x")).select("x.*")
    sums, ranks_ = group_bootstrap(d, group, replicates, seed, y, p), bootstrap_auroc(d, group, replicates, seed, y, p)
    parts = [interval(r, m, level).withColumn("metric", F.lit(m)) for r, m in ((ranks_, "auroc"), (sums, "brier"), (sums, "accuracy"))]
    return point.join(parts[0].union(parts[1]).union(parts[2]), "metric").select("metric", "point", "low", "high", "n_boot")


def paired_bootstrap(df: DataFrame, group: str, a: str, b: str, replicates: int = 200, seed: int = 11, level: float = 0.95, y: str = "y") -> DataFrame:
    """``(metric, diff, low, high, p_value, n_boot)``: metric(a) - metric(b) of two scores on the same
    resampled groups, and twice the smaller share of replicates on either side of no difference."""
    d = df.where(F.col(group).isNotNull())
    out = None
    for metric, make in (("auroc", bootstrap_auroc), ("brier", group_bootstrap), ("accuracy", group_bootstrap)):
        # Under one name, since the two scores' plans stem from the same columns.
        one = lambda c: d.select(group, y, F.col(c).alias("_p"))
        x, z = (make(one(c), group, replicates, seed, y, "_p").select("replicate", F.col(metric).alias(n)) for c, n in ((a, "x"), (b, "z")))
        diffs = x.join(z, "replicate").select((F.col("x") - F.col("z")).alias("d"))
        tails = diffs.agg(F.avg((F.col("d") <= 0).cast("double")).alias("le"), F.avg((F.col("d") >= 0).cast("double")).alias("ge"))
        points = [binary_metrics(one(c), [], y, "_p").select(F.col(metric).alias(n)) for c, n in ((a, "x"), (b, "z"))]
        row = points[0].crossJoin(points[1]).crossJoin(interval(diffs, "d", level)).crossJoin(tails)  # one row each
        row = row.select(F.lit(metric).alias("metric"), (F.col("x") - F.col("z")).alias("diff"), "low", "high", F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p_value"), "n_boot")
        out = row if out is None else out.union(row)
    return out


def prevalence_metrics(df: DataFrame, prevalences: tuple[float, ...] = (0.01, 0.1, 0.5), y: str = "y", p: str = "p") -> DataFrame:
    """Brier, log loss and accuracy with the classes weighted to a prevalence."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    c = df.groupBy(y).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("b"), F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))).alias("l"), F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("a"))
    c = c.withColumn("prevalence", F.explode(F.array(*map(F.lit, prevalences)))).withColumn("w", F.when(F.col(y) == 1, F.col("prevalence")).otherwise(1 - F.col("prevalence")))
    return c.groupBy("prevalence").agg(*(F.sum(F.col(x) * F.col("w")).alias(n) for x, n in (("b", "brier"), ("l", "log_loss"), ("a", "accuracy"))))
