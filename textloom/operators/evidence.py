"""Evidence arithmetic, dependence of segments, mixtures, transport between cohorts, models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.ranks import ranked, same_keys

# Prevalences that evidence is weighed at, and shares of foreign words in mixtures.
PREVALENCES = (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75)
RATES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def clip(p: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))


def log_likelihood_ratio(p: Column) -> Column:
    return F.log(clip(p) / (1 - clip(p)))


def posterior(lr: Column, prevalence: Column) -> Column:
    odds = lr * prevalence / (1 - prevalence)
    return odds / (1 + odds)


def prior_sensitivity(df: DataFrame, p: str, id_: str = "doc_id") -> DataFrame:
    """Posterior of each document under a grid of prevalences."""
    d = df.select(id_, F.exp(log_likelihood_ratio(F.col(p))).alias("lr"), F.explode(F.array(*map(F.lit, PREVALENCES))).alias("prevalence"))
    return d.select(id_, "prevalence", posterior(F.col("lr"), F.col("prevalence")).alias("posterior"))


def accumulate(df: DataFrame, p: str, id_: str = "doc_id", order: str = "segment_no") -> DataFrame:
    """Per document: sum of log likelihood ratios, and that sum shrunk to the effective number of
    independent segments, n / (1 + (n - 1) rho), with the lag-one correlation rho held to [0, 1]
    from three segments on."""
    w = W.partitionBy(id_)
    d = df.withColumn("_l", log_likelihood_ratio(F.col(p)))
    d = d.withColumn("_e", F.col("_l") - F.avg("_l").over(w)).withColumn("_f", F.lag("_e").over(w.orderBy(order)))
    g = d.groupBy(id_).agg(F.count("*").alias("n"), F.sum("_l").alias("naive"), F.sum(F.col("_e") * F.col("_f")).alias("_ef"), F.sum(F.col("_e") * F.col("_e")).alias("_ee"))
    rho = F.when((F.col("n") >= 3) & (F.col("_ee") > 1e-12), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ef") / F.col("_ee")))).otherwise(0.0)
    g = g.withColumn("rho", rho)
    return g.select(id_, "n", "naive", "rho", (F.col("naive") / (1 + (F.col("n") - 1) * F.col("rho"))).alias("shrunk"))


def overlap_corrected(df: DataFrame, p: str, start: str, end: str, id_: str = "doc_id") -> DataFrame:
    """Mean log odds per token of a document whose windows overlap: every token counts once, with the
    mean of the windows over it. Done over the stretches between window edges, not over tokens."""
    d = df.select(id_, F.col(start).alias("s"), F.col(end).alias("e"), log_likelihood_ratio(F.col(p)).alias("l")).where("e > s")
    edge = d.select(id_, F.col("s").alias("x"), F.col("l").alias("dl"), F.lit(1).alias("dn")).union(d.select(id_, "e", -F.col("l"), F.lit(-1)))
    edge = edge.groupBy(id_, "x").agg(F.sum("dl").alias("dl"), F.sum("dn").alias("dn"))
    w = W.partitionBy(id_).orderBy("x")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    s = edge.withColumns({"sl": F.sum("dl").over(run), "sn": F.sum("dn").over(run), "len": F.lead("x").over(w) - F.col("x")}).where("sn > 0 and len > 0")
    return s.groupBy(id_).agg(F.sum("len").alias("tokens"), (F.sum(F.col("sl") / F.col("sn") * F.col("len")) / F.sum("len")).alias("log_odds"))


def mix_words(human: Column, ai: Column, rate: Column, workflow: str = "ai_prefix") -> Column:
    """Words of the human text with the rounded share of its length replaced by words of the other text:
    at the start (``ai_prefix``), at the end (``ai_suffix``), or in turns with blocks of an eighth of the
    human text, the foreign words first (``interleave``). Without human words the other text is the
    mixture at rate 1, else there is none."""
    n = F.size(human)
    k = F.least(F.bround(n * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))).cast("int"), F.size(ai))
    none = F.array().cast("array<string>")
    part = lambda w, at, m: F.when(m > 0, F.slice(w, at, F.greatest(m, F.lit(0)))).otherwise(none)
    if workflow == "ai_prefix":
        mixed = F.concat(part(ai, F.lit(1), k), part(human, k + 1, n - k))
    elif workflow == "ai_suffix":
        mixed = F.concat(part(human, F.lit(1), n - k), part(ai, F.lit(1), k))
    elif workflow == "interleave":
        # While foreign words are left, each block is foreign; then come the human words from their start.
        mixed = F.slice(F.concat(part(ai, F.lit(1), k), human), F.lit(1), n)
    else:
        raise ValueError(f"no workflow {workflow!r}")
    return F.when(n > 0, mixed).when(rate >= 1, ai).otherwise(human)


WORKFLOWS = ("ai_prefix", "ai_suffix", "interleave")


def prompt_pairs(df: DataFrame, group: Column, id_: str = "record_id") -> DataFrame:
    """``(group, kind, human_id, ai_id)``: of each group and kind that has both labels, every row with one
    of the other label, in the order of the ids' digests: the smaller side starts anew when it is used
    up. So a group gives as many pairs as its larger side has rows; how many could be formed,
    ``pair_groups`` tells, and the pairs are its rows of either label crossed."""
    d = df.withColumn("_g", group).where("_g is not null and label in (0, 1)")
    n = pair_groups(df, group)
    r = ranked(d.select("_g", "kind", "label", id_).withColumn("_v", F.lit(0)), ["_g", "kind", "label"], "_v", id_, "_r")
    r = r.join(n.withColumnsRenamed({"group": "_g", "kind": "_kind"}), "_g").where(F.col("kind").eqNullSafe(F.col("_kind")))
    many, own = F.greatest("humans", "ais"), F.when(F.col("label") == 0, F.col("humans")).otherwise(F.col("ais"))
    # A row stands at its rank and every so many places further; places are distinct on both sides.
    r = r.withColumn("_k", F.explode(F.sequence("_r", many - 1, own)))
    side = lambda label, name: r.where(F.col("label") == label).select("_g", "kind", "_k", F.col(id_).alias(name))
    ai = side(1, "ai_id").withColumnsRenamed({c: f"{c}_k" for c in ("_g", "kind", "_k")})
    return side(0, "human_id").join(ai, same_keys(["_g", "kind", "_k"])).select(F.col("_g").alias("group"), "kind", "human_id", "ai_id")


def pair_groups(df: DataFrame, group: Column) -> DataFrame:
    """``(group, kind, humans, ais, pairs)`` of groups with both labels: their rows and all pairs these form."""
    d = df.withColumn("_g", group).where("_g is not null and label in (0, 1)")
    g = d.groupBy(F.col("_g").alias("group"), "kind").agg(F.sum((1 - F.col("label")).cast("bigint")).alias("humans"), F.sum(F.col("label").cast("bigint")).alias("ais"))
    return g.where("humans > 0 and ais > 0").withColumn("pairs", F.col("humans") * F.col("ais"))


def mixture_curve(pairs: DataFrame, words: DataFrame, score, workflow: str = "ai_prefix", id_: str = "record_id") -> DataFrame:
    """``(rate, n, mean_estimated, std_estimated)``: scores of the pairs' mixtures at each rate. ``words`` has
    the columns id and ``w``, the text's words; ``score`` makes a score of a column with the mixture."""
    x = pairs.join(words.withColumnsRenamed({id_: "human_id", "w": "h"}), "human_id").join(words.withColumnsRenamed({id_: "ai_id", "w": "a"}), "ai_id")
    x = x.select("h", "a", F.explode(F.array(*map(F.lit, RATES))).alias("rate"))
    m = score(x.select("rate", F.array_join(mix_words(F.col("h"), F.col("a"), F.col("rate"), workflow), " ").alias("text")))
    return m.groupBy("rate").agg(F.count("*").alias("n"), F.avg("score").alias("mean_estimated"), F.stddev_pop("score").alias("std_estimated"))


def tracking(curve: DataFrame) -> DataFrame:
    """``(correlation, slope, mae)`` of a curve's mean scores against its rates."""
    return curve.agg(F.corr("rate", "mean_estimated").alias("correlation"), F.regr_slope("mean_estimated", "rate").alias("slope"), F.avg(F.abs(F.col("rate") - F.col("mean_estimated"))).alias("mae"))


def transport_cells(df: DataFrame, cohort: str, y: str = "y", p: str = "p") -> DataFrame:
    """Metrics of each cohort, and their difference to all other cohorts together. The others' sums
    are totals less the cohort's own."""
    sq = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    ok = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("int")
    g = df.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(F.count("*").alias("n"), F.sum(sq).alias("sq"), F.sum(ok).alias("ok"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("sq").alias("tsq"), F.sum("ok").alias("tok"))
    x = g.crossJoin(F.broadcast(t))
    return x.select(cohort, "n", (F.col("sq") / F.col("n")).alias("brier"), (F.col("ok") / F.col("n")).alias("accuracy"), (F.col("sq") / F.col("n") - (F.col("tsq") - F.col("sq")) / (F.col("tn") - F.col("n"))).alias("brier_delta"))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``(label, n, centroid)``: mean vectors, element by element."""
    e = df.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return e.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("centroid"))


def nearest_family(df: DataFrame, vector: str, label: str, id_: str = "vec_id") -> DataFrame:
    """``(id, label, nearest, distance)``: the family with the nearest centroid. All centroids, a row per
    family, stand beside each row in one array; more than ``MOST_FAMILIES`` are refused."""
    c = centroids(df, vector, label).select(F.struct(F.col(label).alias("nearest"), "centroid").alias("f")).agg(F.collect_list("f").alias("_all"))
    c = c.withColumn("_all", F.when(F.size("_all") <= MOST_FAMILIES, F.col("_all")).otherwise(F.raise_error(F.lit("too many families for one array"))))
    far = lambda f: F.aggregate(F.zip_with(vector, f["centroid"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("_all", lambda f: F.struct(far(f).alias("d"), f["nearest"].alias("nearest"))))
    return df.crossJoin(F.broadcast(c)).select(id_, label, best.alias("x")).select(id_, label, F.col("x.nearest").alias("nearest"), F.sqrt("x.d").alias("distance"))


#: Families whose centroids go to every task.
MOST_FAMILIES = 10_000


def required_n(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows per arm for a two-proportion test."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return math.ceil(z * z * (p1 * (1 - p1) + p2 * (1 - p2)) / (p1 - p2) ** 2)


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """``df`` with weights 1 / size of the row's group, scaled to mean 1."""
    g = df.groupBy(group).agg(F.count("*").alias("_n"))
    t = g.agg(F.sum("_n").alias("_t"), F.count("*").alias("_g"))
    return df.join(g, group).crossJoin(F.broadcast(t)).withColumn("weight", F.col("_t") / (F.col("_g") * F.col("_n"))).drop("_n", "_t", "_g")


class GroupDRO:
    """Weights of groups by exponentiated gradient on their losses."""

    def __init__(self, groups: list[str], rate: float = 0.01):
        self.groups, self.rate = groups, rate
        self.q = np.full(len(groups), 1 / len(groups))

    def update(self, losses: dict[str, float]) -> float:
        v = np.array([losses.get(g, 0.0) for g in self.groups])
        self.q = self.q * np.exp(self.rate * v)
        self.q /= self.q.sum()
        return float(self.q @ v)


def train_logistic(df: DataFrame, features: list[str], y: str, c: float = 1.0):
    """L2 logistic regression on features scaled to unit deviation: a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = df.count()
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol=y, regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100, predictionCol="predicted", probabilityCol="probability", rawPredictionCol="_raw")]).fit(df)


def train_boosted(df: DataFrame, features: list[str], y: str, rounds: int = 50, validation: str | None = None, tolerance: float = 0.01):
    """Gradient-boosted trees of depth 3. With ``validation``, the name of a boolean column, training stops early once
    the loss on the rows where it holds falls by less than ``tolerance``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = GBTClassifier(featuresCol="_x", labelCol=y, maxDepth=3, stepSize=0.06, maxIter=rounds, predictionCol="predicted").setProbabilityCol("probability").setRawPredictionCol("_raw")
    if validation:
        trees = trees.setValidationIndicatorCol(validation).setParams(validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), trees]).fit(df)
