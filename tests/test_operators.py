import hashlib
import json
import random

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import corpus, evidence, metrics, splits, statistics


def scored(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        y = r.random() < 0.4
        rows.append((i, int(y), round(min(1.0, max(0.0, r.gauss(0.6 if y else 0.4, 0.2))), 2), f"g{i % 7}"))
    return rows, spark.createDataFrame(rows, "doc_id bigint, y int, p double, g string")


def test_auroc_and_precision(spark):
    rows, df = scored(spark)
    pos, neg = [p for _, y, p, _ in rows if y], [p for _, y, p, _ in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    m = metrics.binary_metrics(df, []).first()
    assert abs(m["auroc"] - want) < 1e-12
    ap, last = 0.0, 0.0
    for t in sorted({p for _, _, p, _ in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert abs(m["auprc"] - ap) < 1e-12
    t = np.quantile(neg, 0.95, method="higher")
    assert abs(m["tpr_at_5fpr"] - np.mean(np.array(pos) >= t)) < 1e-12


def test_conformal_covers(spark):
    _, df = scored(spark)
    assert metrics.conformal(df).first()["coverage"] >= 0.9


def test_probability_one_is_in_no_bin(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.3), (1, 0.30000000000000004)], "y int, p double")
    assert [(r["bin"], r["n"]) for r in metrics.reliability(df, []).orderBy("bin").collect()] == [(2, 1), (3, 1)]


def test_mcnemar_delong_and_tails(spark):
    assert abs(statistics.mcnemar_p(2, 10) - 158 / 4096) < 1e-12
    assert abs(statistics.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(statistics.t_sf(2.0, 10) - 0.03669401738537018) < 1e-9
    d = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.8, 0.2), (0, 0.2, 0.8), (0, 0.1, 0.9)], "y int, a double, b double")
    r = statistics.delong(d, "y", "a", "b")
    assert r["auc_a"] == 1 and r["auc_b"] == 0


def test_false_discovery_rates(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r["k"]: r["q_value"] for r in statistics.benjamini_hochberg(d, "p").collect()}
    assert abs(got["a"] - 0.03) < 1e-12 and abs(got["b"] - 0.04) < 1e-12 and abs(got["c"] - 0.04) < 1e-12 and got["d"] is None


def test_logistic_and_inflation(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(a + 1e-6 * c), int(k)) for (a, b), c, k in zip(x, r.normal(size=400), y)], "a double, b double, c double, y int")
    beta = statistics.irls(df, ["a", "b"], "y")["beta"]
    b = np.zeros(3)
    design = np.column_stack([np.ones(400), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ b))
        b += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(3), design.T @ (y - p) - 1e-6 * b)
    assert np.allclose(beta, b, atol=1e-6)
    assert len(statistics.screen_features(df, ["a", "b", "c"])) == 2


def test_mann_whitney(spark):
    d = spark.createDataFrame([(1, True), (2, True), (2, False), (3, False), (None, True)], "v int, s boolean")
    assert statistics.mann_whitney(d, "v", F.col("s")).first()["u"] == 0.5


def test_replay_keeps_position_after_deletion():
    ops = lambda *o: json.dumps({"eventName": "text-change", "eventSource": "user", "textDelta": {"ops": list(o)}})
    lines = [json.dumps({"eventName": "system-initialize", "currentDoc": "Hello."}), ops({"retain": 6}, {"insert": " You"}), json.dumps({"eventName": "suggestion-select", "eventSource": "api", "textDelta": {"ops": [{"retain": 10}, {"insert": " there"}]}}), ops({"retain": 6}, {"delete": 4})]
    assert corpus.replay(lines) == ("Hello. there", "PPPPPPAAAAAA")
    assert corpus.replay(["not json"]) is None


def test_merkle_root(spark):
    def root(hs):
        hs = sorted(hs)
        if not hs:
            return hashlib.sha256(b"").hexdigest()
        while len(hs) > 1:
            hs = [hashlib.sha256((a + (hs[2 * i + 1] if 2 * i + 1 < len(hs) else a)).encode()).hexdigest() for i, a in enumerate(hs[::2])]
        return hs[0]

    for n in (0, 1, 2, 3, 5, 8):
        hs = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(hs,)], "h array<string>")
        assert df.select(corpus.merkle_root(F.col("h"))).first()[0] == root(hs)


def test_clusters_subsample_and_leaks(spark):
    base = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, base), (2, base + " more"), (3, " ".join(f"other{i}" for i in range(80))), (4, ""), (5, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["cluster"] for r in splits.near_duplicate_clusters(df).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == got[5]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    nodes = spark.range(42).withColumnRenamed("id", "doc_id")
    assert {r["cluster"] for r in splits.components(chain, nodes).collect()} == {0, 41}
    g = spark.createDataFrame([(i, f"g{i // 10}") for i in range(100)], "doc_id bigint, g string")
    s = splits.group_subsample(g, "g", 35).groupBy("g").count().collect()
    assert len(s) == 3 and all(r["count"] == 10 for r in s)
    assert splits.leaks(g.withColumn("partition", F.col("doc_id") % 2), "g").count() == 10


def test_hygiene_by_source(spark):
    long = " ".join(["word"] * 60)
    df = spark.createDataFrame([(1, ""), (2, f"As an AI language model {long}"), (3, long), (4, f" {long} "), (5, "short"), (6, None), (7, "short"), (8, f"APIConnectionError {long}")], "doc_id bigint, text string")
    got = lambda k: {r["doc_id"]: r["reason"] for r in corpus.hygiene(df, "doc_id", k).collect()}
    assert got("mage") == {1: "empty", 2: "marker", 3: "keep", 4: "duplicate", 5: "short", 6: "empty", 7: "short", 8: "keep"}
    assert got("defactify") == {1: "empty", 2: "keep", 3: "keep", 4: "duplicate", 5: "short", 6: "empty", 7: "duplicate", 8: "marker"}
    assert got("raid")[2] == got("raid")[8] == "keep" and got("raid")[7] == "duplicate"


def test_overlapping_windows_count_tokens_once(spark):
    df = spark.createDataFrame([(1, 0.9, 0, 10), (1, 0.5, 5, 15)], "doc_id int, p double, s int, e int")
    r = evidence.overlap_corrected(df, "p", "s", "e").first()
    want = (5 * np.log(9) + 5 * np.log(9) / 2) / 15
    assert r["tokens"] == 15 and abs(r["log_odds"] - want) < 1e-9


def test_stream_windows(spark, tmp_path):
    from textloom.streaming import events as E

    df = spark.sql("select cast(id as bigint) event_id, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) ts, id % 3 user_id, 'a' event_type, 1.0D value from range(300)")
    df.write.parquet(str(tmp_path / "in"))
    q = E.windowed_counts(E.read_stream(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").outputMode("complete").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == E.windowed_counts(df, None).agg(F.sum("n")).first()[0]
