import hashlib
import math
import re

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import detectors, features, watermarks

TEXTS = ["", "One word", "It's a test. However, the naïve café closed!\n- item\n- other item", "x = 1\ndef f(a):\n    return a\n", "ab‌cd ef 12", "a" * 30 + " " + "b c. " * 200, None]


def frame(spark):
    return spark.createDataFrame([(i, t, "code" if t and "def " in t else "text") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, kind string")


def test_tokens_as_unicode_words(spark):
    rows = frame(spark).select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("k"), T.word_tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()
    for r in rows:
        t = TEXTS[r["doc_id"]] or ""
        assert r["k"] == re.findall(r"\w+|[^\w\s]", t)
        assert r["w"] == re.findall(r"\b[\w']+\b", t.lower())


def test_content_type_and_language(spark):
    got = {r[0]: r[1:] for r in frame(spark).select("doc_id", T.content_type(F.coalesce("text", F.lit(""))), T.language(F.coalesce("text", F.lit("")))).collect()}
    assert got[3][0] == "mixed" and got[2][0] == "prose" and got[0] == ("prose", "unknown") and got[1][1] == "en"


def test_code_lines_by_hand(spark):
    """One line in three looks like code: mixed; ``return`` and ``public`` alone don't; a hint needs its blank."""
    texts = {"var x\nplain\nplain": "mixed", "public static\nplain": "code", "return x\npublic x\nprivate x": "prose", "def\nclass\nfn": "prose", "let it be": "code", "a => b\n" + "plain\n" * 8: "prose", "x;  \n\n \ny": "code", "{\n" + "plain\n" * 2: "mixed"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in df.select("t", T.content_type("t")).collect()}
    assert got == texts
    named = spark.createDataFrame([("plain words", "a.PY", None), ("plain words", "a.txt", None), ("plain words", None, None), ("let x", "a.py", "prose")], "t string, f string, o string")
    assert [r[0] for r in named.select(T.content_type("t", F.col("f"), F.col("o"))).collect()] == ["code", "prose", "prose", "prose"]
    assert named.select(T.language("t", F.lit("code"), F.col("f"))).first()[0] == "python"


def test_windows_tile_the_tokens(spark):
    rows = spark.range(0, 700).select("id", T.window_starts(F.col("id").cast("int"), 160, 32).alias("s")).collect()
    for n, s in rows:
        want, at = [], 0
        while at < n:
            want.append(at)
            if at + 160 >= n:
                break
            at += 128
        assert list(s) == want


def plain_features(t, kind):
    words = re.findall(r"\b[\w']+\b", t.lower())
    if not words:
        return dict.fromkeys(features.FEATURES, 0.0)
    n, counts = len(words), {w: words.count(w) for w in set(words)}
    sl = [len(re.findall(r"\b[\w']+\b", s)) for s in re.split(r"[.!?]+", t) if s.strip()]
    ll = [len(x) for x in t.splitlines() if x.strip()]
    sd = lambda v: 0.0 if len(v) < 2 else math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1))
    return {"unique_ratio": len(counts) / n, "token_entropy": -sum(c / n * math.log2(c / n) for c in counts.values()), "hapax_ratio": sum(c == 1 for c in counts.values()) / n, "sentence_len_sd": sd(sl), "line_sd": sd(ll), "log_words": math.log1p(n), "short_sentences": sum(x < 14 for x in sl) / len(sl), "structured": 1.0 if kind == "code" else sum(t.count(m) for m in features.MARKERS) / max(len(t) / 80, 1)}


def test_features_against_plain_python(spark):
    for r in features.extract(frame(spark)).collect():
        for k, v in plain_features(TEXTS[r["doc_id"]] or "", r["kind"]).items():
            assert abs(r[k] - v) < 1e-9, (r["doc_id"], k)


def test_short_text_abstains(spark):
    got = {r["doc_id"]: r for r in detectors.prose_score(frame(spark)).collect()}
    assert got[1]["abstain_reason"] == "insufficient" and got[1]["raw_score"] == 0.5
    assert got[5]["abstain_reason"] is None and 0.02 <= got[5]["raw_score"] <= 0.98


def test_analysis_adds_up(spark):
    for r in detectors.analyze(frame(spark)).collect():
        assert abs(r["human"] + r["ai_generated"] + r["ai_refined_or_mixed"] - 1) < 1e-9


def test_green_counts(spark):
    got = {r["doc_id"]: r for r in watermarks.kgw_detect(frame(spark), key="k").collect()}
    toks = re.findall(r"\w+|[^\w\s]", TEXTS[5])
    want = sum(hashlib.sha256(f"k::{p}::{t}".encode()).digest()[0] < 128 for p, t in zip(["", *toks], toks))
    assert got[5]["green"] == want and got[5]["n_tokens"] == len(toks)
    assert got[1]["green"] is None and got[1]["z"] is None and got[0]["power"] is None


def test_zero_width_round_trip(spark):
    t = frame(spark).withColumn("text", watermarks.embed_zero_width(F.coalesce("text", F.lit(""))))
    got = {r["doc_id"]: r for r in watermarks.zero_width(t).collect()}
    assert got[5]["present"] and got[5]["payload_match"] == 1.0 and not got[1]["present"]
    off = {r["doc_id"]: r for r in watermarks.zero_width(t.withColumn("text", watermarks.strip_invisible(F.col("text")))).collect()}
    assert all(r["n_marks"] == 0 for r in off.values())
