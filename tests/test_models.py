import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import hypotheses, models


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(0)
    out = []
    for i in range(240):
        y = i % 2
        out.append((i, f"g{i // 6}", y, ["human", "m1", "m2", "m3"][0 if not y else 1 + i // 2 % 3], float(r.normal(y * 1.5, 1)), float(r.normal(0, 1))))
    return spark.createDataFrame(out, "doc_id bigint, group string, y int, family string, a double, b double").cache()


def fit(train):
    """A model that remembers which groups it saw."""
    seen = {r[0] for r in train.select("group").distinct().collect()}
    mid = train.agg(F.avg("a")).first()[0]
    return lambda d: d.withColumn("p", 1 / (1 + F.exp(-(F.col("a") - mid)))).withColumn("p", F.when(F.col("group").isin(*seen), F.lit(None).cast("double")).otherwise(F.col("p")))


def test_out_of_fold_never_sees_its_groups(rows):
    s = models.out_of_fold(rows, "group", fit)
    assert s.count() == 240 and s.where("p is null").count() == 0 and s.select("fold").distinct().count() == 5
    assert models.cross_validate(rows, "group", fit).first()["auroc"] > 0.7


def test_protocol_keeps_partitions_apart(rows):
    m, o = models.evaluate_protocol(rows, "group", fit)
    assert m.first()["auroc"] > 0.7 and {r["block"] for r in o.collect()} == {"conformal", "tpr_at_fpr", "selective_risk"}


def test_f1_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "family string, predicted string")
    r = {x["class"]: x for x in models.f1_report(df).collect()}
    assert abs(r["a"]["f1"] - 2 / 3) < 1e-12 and r["b"]["precision"] == 1 / 3 and r["c"]["f1"] == 0.0
    assert abs(r["macro"]["f1"] - (2 / 3 + 0.5 + 0) / 3) < 1e-12 and r["macro"]["recall"] == 0.5
    assert {tuple(x) for x in models.confusion(df).collect()} == {("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "b", 1)}


def test_attribution_and_origin(rows):
    p = models.attribution_cv(rows, "group", ["a", "b"])
    assert p.count() == 240 and p.where("predicted is null").count() == 0
    o = models.origin_probe(rows.withColumn("side", F.when(F.col("a") > 0.7, "high").otherwise("low")), "group", ["a", "b"], "side").first()
    assert o["accuracy"] > 0.9 and o["chance"] == 0.5


def test_shrunk_covariance_against_definition(rows):
    x = np.array([[r["a"], r["b"]] for r in rows.collect()])
    z = x - x.mean(0)
    n, k = z.shape
    cov = z.T @ z / n
    mu = np.trace(cov) / k
    d2 = ((cov - mu * np.eye(k)) ** 2).sum()
    b2 = min(sum(((np.outer(v, v) - cov) ** 2).sum() for v in z) / n**2, d2)
    want = np.linalg.inv(b2 / d2 * mu * np.eye(k) + (1 - b2 / d2) * cov)
    assert np.allclose(models.shrunk_precision(rows, ["a", "b"]), want, atol=1e-9)


def test_a_far_family_is_rejected(spark):
    r = np.random.default_rng(2)
    data = [(f"g{i}", f"f{i % 3}", float(r.normal([0, 1, 40][i % 3], 1)), float(r.normal(0, 1))) for i in range(150)] + [("h", "human", 0.0, 0.0)]
    df = spark.createDataFrame(data, "group string, family string, a double, b double")
    got = {x["held_out"]: x for x in models.leave_one_family_out(df, ["a", "b"]).collect()}
    assert got["f2"]["auroc"] > 0.99 and got["f2"]["n_seen"] == 100 and set(got) == {"f0", "f1", "f2"}


def test_geometry(spark):
    g = {"scaler_mean": [1.0, 2.0], "scaler_scale": [2.0, 1.0], "pca_mean": [0.0, 0.0], "pca_components": [[1.0, 0.0], [0.0, 1.0]], "centroids": {"x": [0.0, 0.0], "y": [5.0, 0.0]}, "covariances": {"x": [[1.0, 0.0], [0.0, 1.0]], "y": [[1.0, 0.0], [0.0, 1.0]]}}
    df = spark.createDataFrame([(1.0, 2.0), (11.0, 2.0), (500.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(models.geometry_membership(["a", "b"], g)).collect()]
    assert got[0]["membership"]["x"] > 0.99 and got[0]["unknown"] < 1e-6 and got[1]["membership"]["y"] > 0.99 and got[2]["unknown"] == 1.0


def test_small_expressions(spark, rows):
    e = spark.createDataFrame([([1.0, 1.0],), ([50.0, 50.0],), ([91.0, 1.0],)], "a array<double>").select(models.evidential(F.col("a")).alias("e")).collect()
    assert e[0]["e"]["vacuity"] == 1.0 and e[1]["e"]["dissonance"] > 0.9 and e[2]["e"]["dissonance"] == 0.0 and e[1]["e"]["probability"] == [0.5, 0.5]
    c = spark.createDataFrame([("aé",), ("",), (None,)], "t string").select(models.char_ids(F.col("t"), 4)).collect()
    assert [r[0] for r in c] == [[97, 127, 0, 0], [0] * 4, [0] * 4]
    assert models.power_gate(3140)["required_n"] == 3140 and models.power_gate(3140)["passes"] and not models.power_gate(3139)["passes"]
    s = rows.select("doc_id", F.lit(0.5).alias("p"))
    assert models.joined_scores(rows, s).where("p = 0.5").count() == 240
    with pytest.raises(Exception, match="no score for"):
        models.joined_scores(rows, s.limit(3)).collect()
    d = rows.limit(1).select(models.calibrated_distribution(F.lit(0.8), F.lit(0.05), [(0.0, 0.0), (1.0, 1.0)], F.lit("text"), F.lit(False)).alias("d"), models.calibrated_distribution(F.lit(0.8), F.lit(0.05), None, F.lit("code"), F.lit(False)).alias("n")).first()
    assert abs(sum(d["d"]) - 1) < 1e-12 and d["n"] is None


def test_battery(spark):
    from textloom.operators import features

    docs = [(i, " ".join(["however" if (i % 2 and k % 9 == 0) else ["town", "river", "light", "extraordinary"][(k * 7 + i) % 4] for k in range(50 + i % 5)]), "text", i % 2, ["human", "m"][i % 2]) for i in range(40)]
    df = features.extract(spark.createDataFrame(docs, "doc_id bigint, text string, kind string, label int, family string")).cache()
    reg = [h for h in hypotheses.REGISTRY if h["id"] in ("H1", "H2", "H5")] + [{"id": "HX", "test": "welch_t", "direction": "two_sided", "feature": "digits", "kind": "code"}]
    r = {h["id"]: h for h in hypotheses.run_battery(df, reg)}
    assert r["H1"]["decision"] == "rejected" and r["H1"]["q_value"] >= r["H1"]["p_value"] and r["HX"]["p_value"] == 1.0 and r["HX"]["statistic"] is None
    assert hypotheses.render(list(r.values())).count("\n") == 5 and json.dumps([h["q_value"] for h in r.values()])
    c = hypotheses.comparison_battery(spark.createDataFrame([(i % 2, 0.9 if i % 2 else 0.1, 0.4) for i in range(20)], "y int, a double, b double"), "y", "a", "b")
    assert c["only_a"] == 10 and c["only_b"] == 0 and c["mcnemar_p"] < 0.01 and c["auc_a"] == 1.0


def test_trained_models(spark, rows):
    from textloom.operators import evidence

    for model in (evidence.train_logistic(rows, ["a", "b"], "y"), evidence.train_boosted(rows.withColumn("v", F.col("doc_id") % 4 == 0), ["a", "b"], "y", 10, "v")):
        right = model.transform(rows).agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
        assert right > 0.7


def test_group_weights_of_losses(spark):
    from textloom.operators import evidence

    g = evidence.GroupDRO(["a", "b"], rate=0.5)
    first = g.update({"a": 1.0, "b": 3.0})
    assert abs(g.q.sum() - 1) < 1e-12 and g.q[1] > g.q[0] and 1.0 < first < 3.0
    for _ in range(50):
        g.update({"a": 1.0, "b": 3.0})
    assert g.q[1] > 0.99
    w = evidence.group_weights(spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "g string"), "g").collect()
    assert abs(sum(r["weight"] for r in w) - 4) < 1e-9 and {round(r["weight"], 6) for r in w if r["g"] == "b"} == {2.0}


def test_regression_diagnostics(spark):
    from textloom.operators import statistics as S

    r = np.random.default_rng(7)
    x, z = r.normal(size=400), r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, x, z)], "y int, x double, z double").cache()
    assert S.likelihood_ratio_test(df, ["x", "z"], ["z"], "y")["p_value"] < 1e-6 < S.likelihood_ratio_test(df, ["x", "z"], ["x"], "y")["p_value"]
    assert S.link_test(df, ["x"], "y")["p_value"] > 0.001 and S.breusch_pagan(df, ["x"], "z")["p_value"] > 0.001
    assert abs(S.correlations(df, ["x", "z"])[0, 1] - np.corrcoef(x, z)[0, 1]) < 1e-9 and S.condition_number(df, ["x", "z"]) < 1.5
    c = S.cooks_distance(df, ["x"], "y").agg(F.min("cooks_d"), F.max("leverage"), F.sum("leverage")).first()
    assert c[0] >= 0 and c[1] < 1 and abs(c[2] - 2) < 1e-3  # leverages add up to the number of coefficients
    assert 0 < S.hosmer_lemeshow_test(df.withColumn("p", 1 / (1 + F.exp(-(0.3 + 1.2 * F.col("x"))))), "y", "p")["p_value"] <= 1
    assert S.vif(df.withColumn("w", F.col("x") + 0.01 * F.col("z")), ["x", "w", "z"])["x"] > 100
    assert S.screen_features(df.withColumn("w", F.col("x") + 0.01 * F.col("z")), ["x", "w", "z"]) != ["x", "w", "z"]


def test_permuted_groups(rows):
    from textloom.operators import statistics as S

    r = S.permutation_manova(rows, ["a", "b"], "family", "doc_id", 19)
    assert abs(r["wilks_lambda"] - S.wilks_lambda(rows, ["a", "b"], "family")) < 1e-9 and r["p_value"] == 0.05
    none = S.permutation_manova(rows.withColumn("k", F.xxhash64("doc_id") % 3), ["a", "b"], "k", "doc_id", 19)
    assert none["p_value"] > 0.05
