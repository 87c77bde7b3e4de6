import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import mixing, oversized, packing

TOKEN = re.compile(r"\w+|[^\w\s]")


@given(st.integers(1, 400), st.lists(st.integers(1, 399), max_size=40), st.integers(2, 60), st.integers(0, 59))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_and_overlap(n, cuts, limit, overlap):
    overlap = min(overlap, limit - 1)
    cuts = sorted({c for c in cuts if c < n})
    p = oversized.plan_pieces(0, n, cuts, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == n and all(b - a <= limit for a, b, _ in p)
    assert all(y[0] == x[1] - overlap for x, y in zip(p, p[1:]))
    assert all(x[1] in cuts or x[1] - x[0] == limit for x in p[:-1])


def test_windows(spark):
    s = "one two three four. "
    long = s * 80
    records = [(1, long), (1, long), (2, "w " * 300), (3, None), (4, ""), (5, "short")]
    windows = [(1, 0, 0, 300), (1, 0, 0, 300), (1, 1, 100, None), (2, 0, None, 9999), (2, 1, 0, 256), (3, 0, 0, None), (4, 0, 0, None), (5, 0, 0, 400), (99, 0, 0, 400)]
    got = oversized.split_windows(spark.createDataFrame(records, "record_id bigint, text string"), spark.createDataFrame(windows, "record_id bigint, window_no int, token_start int, token_end int"))
    rows = got.collect()
    assert {(r["record_id"], r["window_no"], r["cut"]) for r in rows} == {(1, 0, "boundary"), (1, 1, "boundary"), (2, 0, "forced")}
    texts = dict(records)
    for r in rows:
        assert texts[r["record_id"]][r["char_start"] : r["char_end"]] == r["piece"] and len(TOKEN.findall(r["piece"])) == r["token_end"] - r["token_start"] <= 256
    with pytest.raises(ValueError):
        oversized.split_windows(spark.createDataFrame(records, "record_id bigint, text string"), spark.createDataFrame(windows, "record_id bigint, window_no int, token_start int, token_end int"), 32, 32)
    assert got.where("record_id = 99").count() == 0


def test_two_texts_of_one_record(spark):
    """Deliveries that differ in their text are each cut by their own tokens; every piece tells how it ends."""
    a, b = "word " * 300, "wo d " * 300
    r = spark.createDataFrame([(1, a), (1, b)], "record_id bigint, text string")
    w = spark.createDataFrame([(1, 0, 0, None)], "record_id bigint, window_no int, token_start int, token_end int")
    rows = oversized.split_windows(r, w).collect()
    assert len(a) == len(b) and all(x["piece"] == (a if "word" in x["piece"] else b)[x["char_start"] : x["char_end"]] for x in rows)
    assert {x["natural"] for x in rows if x["piece_no"] == 0} == {False} and {x["cut"] for x in rows} == {"forced"}
    assert {x["piece"] for x in oversized.split_windows(r, w, with_text=False).collect()} == {None}


def test_decimal_point_is_no_boundary():
    t = "pay 3.5 now. Then\nstop"
    spans = [m.span() for m in TOKEN.finditer(t)]
    a, b = [x for x, _ in spans], [y for _, y in spans]
    assert oversized.boundaries(t, a, b) == [6, 7]


@pytest.mark.parametrize("caps", [[64], [16, 32, 64]])
def test_best_fit_holds_all_items(caps):
    r = random.Random(3)
    h: dict = {}
    for _ in range(3000):
        k = min(64, 1 + int(r.expovariate(1 / 18)))
        h[k] = h.get(k, 0) + 1
    groups = packing.best_fit(h, caps)
    placed: dict = {}
    for g in groups:
        assert g.capacity in caps and sum(k * n for k, n in g.lengths) <= g.capacity
        for k, n in g.lengths:
            placed[k] = placed.get(k, 0) + n * g.many
    assert placed == h
    used = sum(k * n for k, n in h.items()) / sum(g.many * g.capacity for g in groups)
    assert used > 0.98


def test_packing_rows(spark):
    sizes = [(i, n) for i, n in enumerate([10] * 40 + [3, 0, None, 100, 64, 65])]
    df = spark.createDataFrame([*sizes, (0, 10)], "doc_id bigint, n_tokens bigint")
    rows = packing.pack_items(df, {"one": [64], "two": [32, 64]}).collect()
    for name in ("one", "two"):
        mine = [r for r in rows if r["pack_name"] == name]
        assert {r["doc_id"] for r in mine} == {i for i, _ in sizes}
        assert all(len([x for x in mine if x["doc_id"] == i]) == 1 for i, n in sizes if (n or 0) <= 64 and i)
        boxes: dict = {}
        for r in mine:
            boxes.setdefault(r["container_no"], []).append((r["offset"], r["offset"] + r["token_end"] - r["token_start"], r["capacity"]))
        for b in boxes.values():
            b.sort()
            assert all(x[1] <= y[0] for x, y in zip(b, b[1:])) and b[-1][1] <= b[0][2] and len({x[2] for x in b}) == 1
    assert packing.pack_items(df.limit(0), {"one": [64]}).count() == 0


def test_all_capacities_together(spark):
    assert packing.joint_name({"a": 1}) == "joint" and packing.joint_name({"joint": 1}) == "joint+"
    docs = spark.createDataFrame([(i, "word " * (i % 40)) for i in range(80)], "doc_id bigint, text string")
    packs = spark.createDataFrame([("small", 16), ("large", 64), (None, 8)], "pack_name string, capacity_tokens int")
    used = {(r["pack_name"], r["capacity"]): r["used_share"] for r in packing.usage(packing.pack_documents(docs, packs)).collect()}
    assert {k for k, _ in used} == {"small", "large", "joint"} and {c for k, c in used if k == "joint"} <= {16, 64}


def test_thresholds_hit_the_rate():
    tokens = {s: 10 for s in range(mixing.STEPS)}
    have = sum(tokens.values())
    for rate in (0.05, 0.7, 1.9, 2.99, 3.0, 8.0):
        ts = mixing.fit_thresholds(tokens, rate * have, 3)
        got = sum(10 * mixing.taken((s + 0.5) / mixing.STEPS, ts) for s in tokens)
        assert abs(got - min(rate, 3) * have) <= 0.002 * have and len(ts) == 3


def test_wanted_shares():
    rows = [{"share": 0.5, "available": 1000, "most": 1}, {"share": 0.4, "available": 1000, "most": 2}, {"share": 0.1, "available": 10, "most": 4}, {"share": 0.3, "available": 0, "most": 4}]
    mixing.want(rows, None)
    assert rows[2]["wanted"] == 40 and rows[3]["wanted"] == 0 and abs(sum(r["wanted"] for r in rows) - 2010) < 1e-6 or rows[0]["wanted"] == 1000
    mixing.want(rows, "exact")
    assert abs(rows[0]["wanted"] / rows[2]["wanted"] - 5) < 1e-9 and rows[2]["wanted"] <= 40 + 1e-9


def test_mix(spark):
    docs = [(i, "some words here " * (i % 5), ["Big-Source ", "big_source", "small", None, "other"][i % 5], 1) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame([("big-source", 0.5, 1), ("small", 0.5, 3), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t)
    assert {r["source"] for r in m.select("source").distinct().collect()} == {"big-source", "small"}
    assert m.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    got = {r["source"]: r["n"] for r in m.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    rep = {r["source"]: r for r in mixing.mix_report(d, t).collect()}
    assert all(rep[k]["selected_tokens"] == v for k, v in got.items()) and rep["gone"]["available_tokens"] == 0
    assert mixing.mix(d.limit(0), t).count() == 0
