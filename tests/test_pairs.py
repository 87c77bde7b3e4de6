from pyspark.sql import functions as F

from textloom.operators import evidence


def test_every_row_is_in_a_pair(spark):
    rows = [(i, "a", "text", int(i >= 3)) for i in range(10)] + [(20 + i, "b", "text", int(i >= 5)) for i in range(7)] + [(30, "c", "text", 0), (31, "c", "code", 1), (32, None, "text", 1), (33, "d", "text", 1)]
    df = spark.createDataFrame(rows, "record_id bigint, g string, kind string, label int")
    got = [(r["group"], r["human_id"], r["ai_id"]) for r in evidence.prompt_pairs(df, F.col("g")).collect()]
    assert len(got) == len(set(got)) == 12
    assert {h for g, h, _ in got if g == "a"} == {0, 1, 2} and sorted(a for g, _, a in got if g == "a") == list(range(3, 10))
    assert sorted(h for g, h, _ in got if g == "b") == list(range(20, 25)) and {a for g, _, a in got if g == "b"} == {25, 26}
    assert sorted((r["group"], r["humans"], r["ais"], r["pairs"]) for r in evidence.pair_groups(df, F.col("g")).collect()) == [("a", 3, 7, 21), ("b", 5, 2, 10)]


def test_workflows_mix_words(spark):
    h, a = [f"h{i}" for i in range(8)], [f"a{i}" for i in range(20)]
    df = spark.createDataFrame([(h, a), ([], a), (h, [])], "h array<string>, a array<string>")
    for rate, flow, want in [(0.25, "ai_prefix", a[:2] + h[2:]), (0.25, "ai_suffix", h[:6] + a[:2]), (0.25, "interleave", a[:2] + h[:6]), (0.0, "ai_prefix", h), (1.0, "ai_suffix", a[:8]), (0.0625, "ai_prefix", h)]:
        got = [r[0] for r in df.select(evidence.mix_words(F.col("h"), F.col("a"), F.lit(rate), flow)).collect()]
        assert got == [want, a if rate == 1 else [], h], (rate, flow)
