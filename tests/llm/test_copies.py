import random
import re

import numpy as np

from textloom.llm import canonical, cross_split

WORDS = re.compile(r"[^\W_]+")


def sentence(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) for _ in range(n))


def test_fields_in_any_order():
    a = '{"title": "Straße 1", "claim": "two, three"}'
    b = "CLAIM: TWO THREE\nTitle: strasse 1!"
    c = '{"claim": "two three", "title": "Strasse 1",\n}'
    assert canonical.digests(a)[2] == canonical.digests(b)[2] is not None
    assert canonical.digests(c)[2] is None  # no valid object, and no line per field
    assert canonical.digests('{"a": {"x": 1, "y": 2}, "b": 3}')[2] is None
    n = lambda t: canonical.digests(t, nested=True)[2]
    assert n('{"a": {"x": 1, "y": [1, 2]}, "b": 3}') == n('{"b": 3, "a": {"y": [1, 2], "x": 1}}') != n('{"b": 3, "a": {"y": [2, 1], "x": 1}}')
    assert canonical.fields_of("no fields here\njust: one") is None


def test_formatting_classes(spark):
    r = random.Random(5)
    t = sentence(r, 40)
    f = "\n".join(f"{n}: {sentence(r, 12)}" for n in ("one", "two", "three"))
    lines = f.split("\n")
    rows = [(9, t), (3, t.upper() + "!!"), (5, re.sub(" ", "  \n", t)), (5, re.sub(" ", "  \n", t)), (7, t + " x"), (8, "few words"), (11, None), (12, ""),
            (20, f), (21, "\n".join(reversed(lines))), (22, f.replace(":", "")), (None, t)]
    df = spark.createDataFrame([(*x, "z", 1) for x in rows], "record_id bigint, text string, plain string, class_id int")
    got = sorted(tuple(x) for x in canonical.formatting_pairs(df).collect())
    assert got == [(3, 5), (3, 9), (20, 21), (20, 22)]
    assert {x["record_id"]: x["n_copies"] for x in canonical.collapsed(df).collect()} == {3: 3, 7: 1, 20: 3}
    assert canonical.formatting_pairs(df.limit(0)).count() == 0


def test_equal_digests_of_different_records_are_told_apart(spark):
    t = "one two three"
    d = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", "f"), (4, "b", "f"), (5, "c", "f")], "record_id bigint, plain string, by_fields string")
    texts = spark.createDataFrame([(1, t), (2, t.upper() + "!"), (3, "x: 1\ny: 2"), (4, "Y: 2\nX: 1"), (5, "x: 2\ny: 1")], "record_id bigint, text string")
    classes = {r["record_id"]: r["class_id"] for r in canonical.classes_of(canonical.confirmed(d, texts)).collect()}
    assert classes[1] == classes[2] and classes[3] == classes[4] and len({classes[i] for i in (1, 3, 5)}) == 3


def runs(t):
    w = WORDS.findall(t.casefold())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_cross_split_pairs_against_brute_force(spark):
    r = random.Random(7)
    rows, k = [], 0
    for _ in range(150):
        words = sentence(r, r.choice([20, 31, 60, 150])).split()
        for _ in range(r.choice([1, 2, 3])):
            w = list(words)
            for _ in range(int(len(w) * r.choice([0, 0, 0.02, 0.06, 0.1, 0.2]))):
                w[r.randrange(len(w))] = r.choice(["new", "other", "words"])
            k += 1
            rows.append((k, " ".join(w) if r.random() < 0.8 else " ".join(w).upper() + ".", r.choice(["train", "Train ", "test", "development", "calibration", None, "odd"])))
    rows += [(k + 1, None, "train"), (k + 2, "", "test"), rows[0]]
    df = spark.createDataFrame(rows, "record_id bigint, text string, split string")
    want = set()
    ok = [(i, t, s.strip().lower()) for i, t, s in dict.fromkeys(rows) if t and s and s != "odd" and len(WORDS.findall(t)) >= 30]
    for i, t, s in ok:
        for j, u, v in ok:
            if s == "train" and v != "train":
                a, b = runs(t), runs(u)
                if len(a & b) >= 0.6 * len(a | b) or "".join(WORDS.findall(t.casefold())) == "".join(WORDS.findall(u.casefold())):
                    want.add((j, i))
    got = cross_split.cross_split_pairs(df)
    assert {(x["eval_id"], x["train_id"]) for x in got.collect()} == want and len(want) > 10
    rep = cross_split.overlap_report(df.selectExpr("*", "'f' as family")).collect()
    assert sum(x["pairs"] for x in rep) == len(want)
    assert cross_split.cross_split_pairs(df.limit(0)).count() == 0


def test_index_misses_hardly_any_pair():
    r = np.random.default_rng(1)
    found = 0
    for _ in range(400):
        both, own = r.integers(0, 2**63, 120, dtype=np.uint64), r.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = np.unique(np.concatenate([both, own[:40]])), np.unique(np.concatenate([both, own[40:]]))  # similarity 0.6
        x, y = cross_split.signature(a), cross_split.signature(b)
        same = 256 - sum(bin(p ^ q).count("1") for p, q in zip(x[1], y[1]))
        found += any(p == q for p, q in zip(x[0], y[0])) and same >= cross_split.sketch_floor(0.6)
    assert found >= 398


def test_growing_sides_of_joins_are_not_sent_to_the_driver(spark):
    records = spark.createDataFrame([(i, " ".join(f"w{i * 7 % 5}{j}" for j in range(40)), "train" if i % 2 else "test") for i in range(20)], "record_id bigint, text string, split string")
    reps = cross_split.index_records(records)
    pairs = cross_split.candidate_pairs(reps)
    sets = cross_split.run_sets(records)
    classes = canonical.classes_of(reps.select("record_id", "plain", "by_fields"))
    for df in (pairs, cross_split.measured(pairs, sets), classes):
        df.collect()  # joins may turn into broadcasts as late as that
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
