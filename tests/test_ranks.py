import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import metrics, ranks, statistics


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(r.random() < 0.4), float(r.choice([r.random(), 0.5, 0.25])), ["a", "b", None][i % 3]) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id bigint, y int, p double, k string").cache()


def test_running_sums(scored):
    g = scored.groupBy("k", "p").agg(F.count("*").alias("n"))
    rows = [r.asDict() for r in ranks.running(g, ["k"], "p", ["n"], ranges=7).collect()]
    assert len(rows) == g.count()
    for r in rows:
        mine = [x for x in rows if x["k"] == r["k"]]
        assert r["n_below"] == sum(x["n"] for x in mine if x["p"] < r["p"]) and r["all_n"] == sum(x["n"] for x in mine)
    assert ranks.running(g.limit(0), ["k"], "p", ["n"]).count() == 0


def test_ranks_split_a_value_that_many_rows_share(scored):
    r = ranks.ranked(scored, ["k"], "p", "doc_id").collect()
    for k in ("a", "b", None):
        mine = sorted((x for x in r if x["k"] == k), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(300)) and all(a["p"] <= b["p"] for a, b in zip(mine, mine[1:])) and mine[0]["all_rows"] == 300


def test_quantiles_like_numpy(scored):
    p = np.array([r["p"] for r in scored.collect()])
    points = {str(q): F.lit(q) for q in (0.0, 0.1, 0.33, 0.5, 0.95, 1.0)}
    for higher, method in ((True, "higher"), (False, "linear")):
        got = {r["point"]: r["quantile"] for r in ranks.quantiles(scored, [], "p", points, higher).collect()}
        assert all(abs(v - np.quantile(p, float(k), method=method)) < 1e-12 for k, v in got.items()) and len(got) == 6
    assert ranks.quantiles(scored.where("p > 5"), [], "p", points).count() == 0


def test_auroc_and_fdr_against_brute_force(scored):
    rows = scored.collect()
    pos, neg = [r["p"] for r in rows if r["y"]], [r["p"] for r in rows if not r["y"]]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.auroc(scored, []).first()[0] - want) < 1e-9
    assert metrics.auroc(scored.where("y = 1"), []).first()[0] is None
    m = len(rows)
    order = sorted(r["p"] for r in rows)
    q = {r["doc_id"]: (r["p"], r["q_value"]) for r in statistics.benjamini_hochberg(scored.select("doc_id", "p"), "p").collect()}
    last = {p: k + 1 for k, p in enumerate(order)}
    want = {p: min(1.0, min(m * x / last[x] for x in last if x >= p)) for p in last}
    assert all(abs(v - want[p]) < 1e-12 for p, v in q.values())


def test_no_window_spans_all_scores(spark, scored):
    """Windows without keys order the ranges, of which there are at most 64, never scores."""
    frames = [metrics.binary_metrics(scored, []), metrics.conformal(scored), metrics.selective_risk(scored), metrics.adaptive_error(scored), statistics.mann_whitney(scored, "p", F.col("y") == 1), statistics.hosmer_lemeshow(scored, "y", "p"), statistics.benjamini_hochberg(scored, "p")]
    for df in frames:
        windows = []

        def walk(node):
            if node.nodeName() == "Window":
                windows.append((node.partitionSpec().isEmpty(), node.orderSpec().mkString(",")))
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(df._jdf.queryExecution().optimizedPlan())
        assert windows and all(o.lstrip().startswith("_part#") or not o for empty, o in windows if empty), windows


def test_bootstrap_counts_groups_whole(spark):
    rows = [(i, i % 2, 0.3 + 0.4 * (i % 2), f"g{i // 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, y int, p double, g string")
    got = {r["metric"]: r for r in metrics.group_bootstrap_ci(df, "g", 40).collect()}
    assert got["auroc"]["point"] == got["auroc"]["low"] == got["auroc"]["high"] == 1.0 and got["auroc"]["n_boot"] == 40
    assert abs(got["brier"]["point"] - 0.09) < 1e-9 and got["brier"]["low"] <= 0.09 + 1e-9
    p = {r["metric"]: r for r in metrics.paired_bootstrap(df.withColumn("q", 1 - F.col("p")), "g", "p", "q", 40).collect()}
    assert p["auroc"]["diff"] == 1.0 and p["auroc"]["p_value"] == 0.0


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (4.0, True), (3.0, False), (5.0, False), (7.0, False)], "v double, s boolean")
    r = statistics.welch_test(df, "v", F.col("s"), "lower")
    assert abs(r["difference"] + 8 / 3) < 1e-12 and r["low"] < r["difference"] < r["high"] and 0 < r["p_value"] < 0.5
    assert abs(statistics.t_quantile(0.975, 10) - 2.228139) < 1e-5
    m = statistics.mann_whitney_test(df, "v", F.col("s"))
    assert m["u"] == 1.0 and abs(m["rank_biserial"] - (1 - 2 / 9)) < 1e-12 and m["p_value"] > 0.05
    with pytest.raises(RuntimeError):
        statistics.irls(spark.createDataFrame([(float(i), int(i > 3)) for i in range(8)], "x double, y int"), ["x"], "y", ridge=0.0, rounds=3)
    dw = statistics.durbin_watson_permutation(spark.createDataFrame([(k, i, float(i)) for k in range(6) for i in range(8)], "k int, i int, v double"), "v", "k", ["i"], 30).first()
    assert dw["dw"] < 0.5 and dw["p_value"] <= 2 / 31
