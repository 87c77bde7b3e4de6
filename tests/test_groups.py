import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.operators import splits

WORD = re.compile("[a-z0-9']+")


def runs(t, n):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or set(w)


@pytest.fixture(scope="module")
def family(spark):
    """Texts with near copies at several distances, exact copies, empty and short ones."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = [r.choice(vocab) for _ in range(r.choice([20, 80, 200]))]
        for _ in range(r.choice([1, 3])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.2]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "one two")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


def classes(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_measured_clusters_against_brute_force(family):
    docs = {r["doc_id"]: r["text"] or "" for r in family.collect()}
    s = {i: runs(t, 5) for i, t in docs.items()}
    edges = [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    got = {r["doc_id"]: r["cluster"] for r in splits.near_duplicate_clusters(family, words=5, similarity=0.8).collect()}
    assert got == classes(docs, edges)


def test_recall_of_bands(family):
    """Pairs of similarity 0.8 share a band all but surely."""
    docs = {r["doc_id"]: r["text"] or "" for r in family.collect()}
    s = {i: runs(t, 3) for i, t in docs.items()}
    near = [(a, b) for a in s for b in s if a < b and s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    c = {r["doc_id"]: r["cluster"] for r in splits.near_duplicate_clusters(family).collect()}
    assert near and sum(c[a] == c[b] for a, b in near) >= 0.99 * len(near)


def test_signatures_against_definition(spark):
    sign = splits.Signer(16)
    text = "one two three four five six seven"
    a, b = splits.coefficients(16)
    h = sign.runs(text)
    want = [min(((int(x) * int(m) + int(c)) % 2**64) % splits.PRIME for x in h) for m, c in zip(a, b)]
    assert sign(text).tolist() == want and len(h) == 5 and (sign("") == np.iinfo(np.uint64).max).all()
    rows = splits.minhash(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), perms=16).collect()
    assert [x % 2**64 for x in rows[0]["signature"]] == want and rows[1]["n"] == 0


def greedy(sizes, k):
    load, out = [0] * k, {}
    for g, n in sizes:
        f = load.index(min(load))
        load[f] += n
        out[g] = f
    return out


def test_folds_against_greedy(spark):
    import hashlib

    r = random.Random(2)
    groups = {f"g{i}": r.choice([1, 1, 1, 2, 3, 9, 40]) for i in range(120)}
    df = spark.createDataFrame([(g,) for g, n in groups.items() for _ in range(n)] + [(None,)], "g string")
    got = {x["g"]: x["fold"] for x in splits.grouped_folds(df, "g", 4).collect()}
    order = sorted(groups.items(), key=lambda x: (-x[1], hashlib.md5(x[0].encode()).hexdigest()))
    assert got == greedy(order, 4)
    assert {x["fold"] for x in splits.grouped_folds(df.where("g in ('g1', 'g2')"), "g").collect()} == {0, 1}


def test_holdout_and_protocol(spark):
    df = spark.createDataFrame([(f"g{i // 3}", i % 2) for i in range(120)], "g string, label int")
    n = {r["partition"]: r["count"] for r in splits.holdout(df, "g").groupBy("partition").count().collect()}
    assert n == {"test": 8, "calibration": 8, "train": 24}
    with pytest.raises(ValueError):
        splits.holdout(df.where("g in ('g1', 'g2')"), "g")
    assert {r["fold"] for r in splits.protocol_splits(df, "g").collect()} == {0}
    few = df.where("g < 'g2'")
    p = splits.protocol_splits(few, "g").collect()
    groups = few.select("g").distinct().count()
    assert groups < splits.NESTED_BELOW and len(p) == 5 * groups and {r["fold"] for r in p} == set(range(5))
    tests = [r["group"] for r in p if r["partition"] == "test"]
    assert len(tests) == len(set(tests)) == groups


def test_nested_calibration_has_both_classes(spark):
    df = spark.createDataFrame([(f"g{i}", int(i < 4)) for i in range(20) for _ in range(3)], "g string, label int")
    m = {r["g"]: r["majority"] for r in splits.majority_labels(df, "g").collect()}
    p = splits.nested_folds(df, "g").collect()
    for f in range(5):
        cal = [r["g"] for r in p if r["fold"] == f and r["partition"] == "calibration"]
        rest = [r for r in p if r["fold"] == f and r["partition"] != "test"]
        assert len(cal) == max(2, len(rest) // 4) and {m[g] for g in cal} == {0, 1}


def test_stratified_subsample(spark):
    rows = [(f"g{i // 5}", ["x", "y"][i // 5 % 2], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, d string, label int")
    s = splits.stratified_subsample(df, "g", ["d", "label"], 60)
    n = {r["d"]: r["count"] for r in s.groupBy("d").count().collect()}
    assert n == {"x": 30, "y": 30} and s.groupBy("g").count().where("count <> 5").count() == 0
    assert splits.stratified_subsample(df, "g", ["d"], 500).count() == 200


def test_groups_are_excluded_and_capped(spark):
    df = spark.createDataFrame([(f"g{i // 2}",) for i in range(20)] + [(None,)], "group string")
    assert splits.exclude_groups(df, "group", df.where("group = 'g1'"), df.where("group = 'g2'")).count() == 17
    assert splits.cap_rows(df, "group", 6).count() == 6 and splits.cap_rows(df, "group", None).count() == 21 and splits.cap_rows(df, "group", 21).count() == 21


def test_stories_against_brute_force(spark):
    r = random.Random(9)
    vocab = [f"term{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(30)]
        texts += [" ".join(base), " ".join(r.sample(base, 24) + [r.choice(vocab) for _ in range(6)])]
    texts += ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs = [re.findall(r"\w{2,}", (t or "").lower()) for t in texts]
    docs = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in docs]
    n = len(docs)
    df_ = {t: sum(t in d for d in docs) for d in docs for t in d}
    vec = []
    for d in docs:
        v = {t: (1 + np.log(d.count(t))) * (np.log((1 + n) / (1 + df_[t])) + 1) for t in set(d) if df_[t] > 1}
        z = np.sqrt(sum(x * x for x in v.values())) or 1.0
        vec.append({t: x / z for t, x in v.items()})
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) >= 0.45]
    got = {x["doc_id"]: x["cluster"] for x in splits.story_groups(df).collect()}
    assert got == classes(range(n), edges) and len(set(got.values())) < n


def test_components_that_need_too_many_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        splits.components(chain, spark.range(41).withColumnRenamed("id", "doc_id"), max_rounds=2)
    assert splits.leaks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "g int, partition string"), "g").count() == 1


def test_jaccard_moves_texts_and_sends_none_to_the_driver(spark):
    texts = {1: "One two three four", 2: "one TWO three, four five", 3: "a b", 4: "A b c", 5: "", 6: None, 7: "b a", 8: "x's 1 2 3 x's 1 2"}
    find = lambda t: re.findall("[a-z0-9']+", (t or "").lower())
    runs = {i: {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w := find(t)) > 2 else set(w) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    got = splits.jaccard(spark.createDataFrame([*pairs, (None, 1), (1, None)], "a bigint, b bigint"), df)
    assert {(x["a"], x["b"]): x["similarity"] for x in got.collect()} == {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) if runs[a] | runs[b] else 1.0 for a, b in pairs}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "array_distinct" not in plan


def test_stories_of_several_blocks_form_no_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(splits, "STORY_BLOCK", 3)
    monkeypatch.setattr(splits, "STORY_DENSE", 0.3)
    made = []
    cut = splits.cut_lineage
    monkeypatch.setattr(splits, "cut_lineage", lambda df: made.append(df.count()) or cut(df))
    # All texts share a word, so all pairs of them share a term; those of a story share most.
    texts = {10 * g + i: " ".join(["all"] + [f"s{g}w{k}" for k in range(12)] + [f"own{i}"]) for g in range(8) for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: x["cluster"] for x in splits.story_groups(df).collect()}
    assert got == {i: i - i % 10 for i in texts} and max(made) < len(texts) * (len(texts) - 1) / 2


def brute_stories(texts):
    docs = {i: re.findall(r"\w{2,}", (t or "").lower()) for i, t in texts.items()}
    docs = {i: w + [f"{a} {b}" for a, b in zip(w, w[1:])] for i, w in docs.items()}
    n, df_ = len(docs), Counter(t for d in docs.values() for t in set(d))
    vec = {i: {t: (1 + np.log(k)) * (np.log((1 + n) / (1 + df_[t])) + 1) for t, k in Counter(d).items() if df_[t] > 1} for i, d in docs.items()}
    size = {i: np.sqrt(sum(x * x for x in v.values())) or 1.0 for i, v in vec.items()}
    edges = [(a, b) for a in texts for b in texts if a < b and sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / size[a] / size[b] >= 0.45]
    return classes(sorted(texts), edges)


def test_stories_of_several_languages_with_loose_bounds(spark, monkeypatch):
    monkeypatch.setattr(splits, "STORY_BLOCK", 5)
    monkeypatch.setattr(splits, "STORY_WIDTHS", (8, 32))
    r, texts = random.Random(4), {}
    for i in range(90):
        words = [f"{'abc'[i % 3]}w{k}" for k in range(40)]
        base = [r.choice(words) for _ in range(r.choice([3, 12, 30]))]
        texts[3 * i + 2] = " ".join(base)
        if i % 2:  # a rewrite, partly in another language
            texts[3 * i + 1] = " ".join(r.sample(base, len(base) * 2 // 3) + [f"{r.choice('abc')}w{r.randrange(40)}" for _ in range(len(base) // 3)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: x["cluster"] for x in splits.story_groups(df).collect()}
    assert got == brute_stories(texts) and 3 < len(set(got.values())) < len(got)


def test_stories_measure_equal_texts_once(spark, monkeypatch):
    packed = []
    cut = splits.cut_lineage
    monkeypatch.setattr(splits, "cut_lineage", lambda df: (packed.extend(len(x["ids"]) for x in df.collect()) if "ids" in df.columns else None) or cut(df))
    texts = {i: ["the same words again", "The Same words again", "quite other words here", "", None, "x"][i % 6] for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {x["doc_id"]: x["cluster"] for x in splits.story_groups(df).collect()}
    assert got == brute_stories(texts) and sum(packed) == 2
    # Copies whose terms aren't among the most frequent ones have no vector, so nothing links them.
    texts = {1: "rare pair", 2: "rare pair", 3: "often seen", 4: "often seen", 5: "often seen"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {x["doc_id"]: x["cluster"] for x in splits.story_groups(df, terms=3).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}


def test_bounds_of_stories_are_no_less_than_the_products():
    r = np.random.default_rng(5)
    n, terms = 60, 300
    size = r.integers(1, 40, n)
    row = np.repeat(np.arange(n), size)
    term = np.concatenate([np.sort(r.choice(terms, k, replace=False)) for k in size]).astype(np.int32)
    tf, idf = r.integers(1, 300, len(term)), r.uniform(1, 9, terms)
    w = splits._story_weights(row, term, tf, n, idf)
    _, _, column, _ = splits._story_layout(row, term, w, n, terms, 0.45)
    x = splits._StoryBlock(n, tuple(splits._packed(v) for v in (size, term, tf)), idf)
    full = np.zeros((n, terms))
    full[row, term] = w
    true = full @ full.T
    some = np.array([7, 3, 50])
    for c in column:
        for m in (c, c % 8):
            t = x.table(m)
            assert (t @ t.T >= true - 1e-5).all() and np.allclose(x.table(m, some), t[some])
    a, b = np.triu_indices(n, 1)
    assert (x.linked(a, x, b, 0.2, terms) == (true[a, b] >= 0.2)).all() and 0 < (true[a, b] >= 0.2).sum() < len(a)
    low = x.forest(x, a, b, true[a, b], 0.2, terms)
    e = [(i, j) for i, j in zip(a, b) if true[i, j] >= 0.2]
    assert dict(enumerate(low)) == classes(range(n), e)
