"""Tests for statistical and zero-width text watermarks, attacks on them, and a bigram student."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.functions.text import let, tokens, window_starts

#: The key of the green list; a deployment passes its own.
KEY = "demo-key"
MIN_TOKENS, SEGMENT_TOKENS = 50, 20
_Z99, _Z975 = NormalDist().inv_cdf(0.99), NormalDist().inv_cdf(0.975)
# The two zero-width bits, the signature they spell, invisible characters, look-alikes.
ZERO, ONE = "‌", "​"
SIGNATURE = (1, 0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 0, 1, 0, 1, 0)
INVISIBLE = "​‌‍﻿⁠­‎‏"


# Letters of other scripts that look like Latin ones, and words for words in rewrites.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "н": "h", "к": "k", "м": "m", "т": "t", "в": "b", "ο": "o", "α": "a", "ε": "e", "ρ": "p", "ν": "v"}
SYNONYMS = {
    "said": "stated", "say": "suggest", "says": "suggests", "new": "recent", "more": "additional", "also": "likewise", "big": "large", "small": "little", "show": "demonstrate", "shows": "demonstrates",
    "find": "discover", "found": "discovered", "use": "utilize", "used": "utilized", "help": "assist", "make": "create", "made": "created", "get": "obtain", "need": "require", "important": "significant",
    "many": "numerous", "good": "beneficial", "bad": "harmful", "great": "excellent", "first": "initial", "last": "final", "long": "extended", "short": "brief", "high": "elevated", "low": "reduced",
    "old": "ancient", "young": "youthful", "people": "individuals", "city": "municipality", "team": "squad", "study": "investigation", "report": "account", "according": "per", "about": "regarding",
    "after": "following", "before": "preceding", "during": "throughout", "because": "since", "but": "however", "so": "therefore", "if": "provided", "when": "upon", "while": "whereas", "this": "the",
    "that": "which", "these": "those", "their": "its", "they": "these", "them": "those", "have": "possess", "has": "possesses", "will": "shall", "would": "might", "could": "might", "can": "may",
    "over": "throughout", "under": "beneath",
}


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


def greens(toks: Column, key: str = KEY) -> Column:
    """For each token whether it is on the green list that the token before it selects."""
    prev = lambda i: F.when(i > 0, F.get(toks, i - 1)).otherwise("")
    return F.transform(toks, lambda t, i: F.substring(F.sha2(F.encode(F.concat(F.lit(f"{key}::"), prev(i), F.lit("::"), t), "utf-8"), 256), 1, 1) < "8")


def _z(green: Column, n: Column) -> Column:
    return (green - n * 0.5) / F.sqrt(n * 0.25)


def kgw_counts(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``df`` with n_tokens, green, z, green_rate, effect, dilution and the 95 % Wilson interval of the
    rate; all but n_tokens are null under 50 tokens (not tested, never 0)."""
    # The counts are bound in one expression, so that a later filter on them computes them once.
    counts = let(tokens(F.coalesce(F.col(text), F.lit(""))), lambda k: F.struct(F.size(k).alias("n"), F.when(F.size(k) >= MIN_TOKENS, F.size(F.filter(greens(k, key), lambda g: g))).cast("double").alias("g")))
    d = df.withColumn("_k", F.explode(F.array(counts))).withColumn("n_tokens", F.col("_k.n")).withColumn("green", F.col("_k.g"))
    n, g = F.col("n_tokens"), F.col("green")
    p, z2 = g / n, _Z975 * _Z975
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    margin = _Z975 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    d = d.withColumns({"z": _z(g, n), "green_rate": p, "effect": p - 0.5, "dilution": F.when(g.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - 0.5) / 0.5))), "rate_low": F.when(g.isNotNull(), F.greatest(F.lit(0.0), centre - margin)), "rate_high": F.when(g.isNotNull(), F.least(F.lit(1.0), centre + margin))})
    return d.drop("_k")


def kgw_detect(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """``kgw_counts`` with the p value (at least 1e-16) and the power at level 0.01."""
    d = kgw_counts(df, text, key)
    n, r = F.col("n_tokens"), F.col("green_rate")
    n = F.when(n > 0, n)
    critical = _Z99 * F.sqrt(0.25 / n) + 0.5
    alt = F.sqrt(F.greatest(r * (1 - r), F.lit(1e-9)) / n)
    return d.withColumn("p_value", F.greatest(F.lit(1e-16), F.least(F.lit(1.0), 1 - normal_cdf(F.col("z"))))).withColumn("power", 1 - normal_cdf((critical - r) / alt))


def screen(df: DataFrame, keys: list[str], z: float = 1.6448536269514722, text: str = "text", key: str = KEY) -> DataFrame:
    """``(keys, tested, reject_rate, mean_z, mean_green_rate)`` over the documents long enough to be tested."""
    k = kgw_counts(df, text, key).where("z is not null")
    return k.groupBy(*keys).agg(F.count("*").alias("tested"), F.avg((F.col("z") > z).cast("double")).alias("reject_rate"), F.avg("z").alias("mean_z"), F.avg("green_rate").alias("mean_green_rate"))


def flagged(df: DataFrame, most: int = 50, id_: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """The ``most`` documents with the highest z, ties by id."""
    k = kgw_counts(df, text, key).where("z is not null").select(id_, "n_tokens", "green", "z")
    return k.orderBy(F.desc(F.round("z", 6)), id_).limit(most)


def kgw_segments(df: DataFrame, id_: str = "doc_id", text: str = "text", key: str = KEY, size: int = 160, overlap: int = 32) -> DataFrame:
    """``(id, segment_no, n_tokens, green, z)`` of each window of tokens; z is null under 20 tokens."""
    d = df.select(id_, tokens(F.coalesce(F.col(text), F.lit(""))).alias("k")).withColumn("g", greens(F.col("k"), key))
    d = d.select(id_, "g", F.posexplode_outer(window_starts(F.size("g"), size, overlap)).alias("segment_no", "s")).where("s is not null")
    d = d.withColumn("w", F.slice("g", F.col("s") + 1, size)).select(id_, "segment_no", F.size("w").alias("n_tokens"), F.size(F.filter("w", lambda g: g)).alias("green"))
    return d.withColumn("z", F.when(F.col("n_tokens") >= SEGMENT_TOKENS, _z(F.col("green"), F.col("n_tokens"))))


def embed_zero_width(text: Column) -> Column:
    """One bit of the signature before each word between blanks."""
    marks = F.array(*(F.lit(ONE if b else ZERO) for b in SIGNATURE))
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w, i: F.concat(F.get(marks, i % len(SIGNATURE)), w)), " ")


def zero_width(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_marks, payload_match (0 under 8 marks) and present (match of at least 0.9)."""
    bits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[{ZERO}{ONE}]"), F.lit(0))
    sig = F.array(*(F.lit(ONE if b else ZERO) for b in SIGNATURE))
    d = df.withColumn("_b", bits).withColumn("n_marks", F.size("_b"))
    hit = F.size(F.filter(F.transform("_b", lambda b, i: b == F.get(sig, i % len(SIGNATURE))), lambda x: x))
    d = d.withColumn("payload_match", F.when(F.col("n_marks") >= 8, hit / F.col("n_marks")).otherwise(0.0))
    return d.withColumn("present", F.col("payload_match") >= 0.9).drop("_b")


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def unicode_scrub(text: Column) -> Column:
    """Without invisible characters, look-alikes as the Latin letters they look like."""
    return F.translate(strip_invisible(text), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def synonyms(text: Column, rate: float, id_: Column, seed: int = 13) -> Column:
    """Text with about ``rate`` of the words that have a synonym replaced by it; words then stand a blank
    apart, marks at the word before. A text without tokens stays. Choices come from hashes."""
    table = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    word = lambda t: t.rlike(r"^[\p{L}\p{N}_]+$")
    swap = lambda t, i: F.when(word(t) & (_unit(seed, id_.cast("string"), i.cast("string")) < rate), F.coalesce(F.try_element_at(table, F.lower(t)), t)).otherwise(t)
    parts = lambda k: F.transform(F.transform(k, swap), lambda t, i: F.when(word(t) & (i > 0), F.concat(F.lit(" "), t)).otherwise(t))
    return let(tokens(text), lambda k: F.when(F.size(k) > 0, F.array_join(parts(k), "")).otherwise(text))


def _unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a hash, the same in any engine with SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def attack(text: Column, name: str, id_: Column, seed: int = 7, rate: float = 0.2) -> Column:
    """Text after an edit: truncate, drop_tokens, strip_punctuation, lowercase, shuffle_sentences,
    strip_invisible. Random choices come from hashes of seed, id and position."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    if name == "truncate":
        return F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) * 0.5).cast("int"))), " ")
    if name == "drop_tokens":
        return F.array_join(F.filter(words, lambda w, i: _unit(seed, id_.cast("string"), i.cast("string")) >= rate), " ")
    if name == "strip_punctuation":
        return F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}]", "")
    if name == "lowercase":
        return F.lower(text)
    if name == "strip_invisible":
        return strip_invisible(text)
    if name == "shuffle_sentences":
        s = F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda x, i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), id_.cast("string"), i.cast("string")), 256).alias("h"), x.alias("s")))
        return F.array_join(F.transform(F.array_sort(s), lambda x: x.s), " ")
    if name == "unicode_scrub":
        return unicode_scrub(text)
    if name in ("synonym_30", "synonym_60"):
        return synonyms(text, int(name[-2:]) / 100, id_)
    if name == "truncate_75":
        return F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.floor(F.size(words) * 0.75).cast("int"))), " ")
    if name == "none":
        return text
    raise ValueError(name)


ATTACKS = ("none", "unicode_scrub", "synonym_30", "synonym_60", "truncate", "drop_tokens", "strip_punctuation", "lowercase", "shuffle_sentences", "strip_invisible")
#: Edits that a detector's robustness is measured under.
TRANSFORMS = ("none", "truncate_75", "truncate", "drop_tokens", "lowercase", "strip_punctuation", "shuffle_sentences")


def attacked(df: DataFrame, names: tuple[str, ...], id_: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, attack, text)``: each document once under each attack."""
    t = F.coalesce(F.col(text), F.lit(""))
    each = F.array(*(F.struct(F.lit(a).alias("attack"), attack(t, a, F.col(id_)).alias("text")) for a in names))
    return df.select(id_, *keep, F.explode(each).alias("_x")).select(id_, *keep, "_x.*")


def robustness_curve(df: DataFrame, score, id_: str = "doc_id", text: str = "text", y: str = "label") -> DataFrame:
    """Metrics of a detector by transform, and the difference of its AUROC to that of the texts as they
    are. ``score`` adds a column ``p`` to rows with ``text``."""
    from textloom.operators.metrics import binary_metrics

    s = score(attacked(df, TRANSFORMS, id_, text, (y,))).select("attack", F.col(y).alias("y"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p"))).alias("p"))
    m = binary_metrics(s, ["attack"])
    base = m.where("attack = 'none'").select(F.col("auroc").alias("_base"))  # one row
    return m.crossJoin(F.broadcast(base)).withColumn("delta_auroc", F.col("auroc") - F.col("_base")).drop("_base")


def degradation(df: DataFrame, id_: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """``(attack, tested, mean_z, detect_rate, z_kept)``: the watermark test under each attack, its rejections at
    z > 1.6449, and the share of the untouched texts' mean z that is left."""
    k = kgw_counts(attacked(df, ATTACKS, id_, text), "text", key).where("z is not null")
    g = k.groupBy("attack").agg(F.count("*").alias("tested"), F.avg("z").alias("mean_z"), F.avg((F.col("z") > 1.6448536269514722).cast("double")).alias("detect_rate"))
    base = g.where("attack = 'none'").select(F.col("mean_z").alias("_base"))  # one row
    return g.crossJoin(F.broadcast(base)).select("attack", "tested", "mean_z", "detect_rate", (F.col("mean_z") / F.col("_base")).alias("z_kept"))


def attenuation(before: DataFrame, after: DataFrame, id_: str = "doc_id") -> DataFrame:
    """``(pairs, mean_before, mean_after, attenuation, kept_rate)`` of z scores of texts that were tested before
    and after a change; attenuation is 1 less the ratio of the means."""
    x = before.where("z is not null").select(id_, F.col("z").alias("a")).join(after.where("z is not null").select(id_, F.col("z").alias("b")), id_)
    return x.agg(F.count("*").alias("pairs"), F.avg("a").alias("mean_before"), F.avg("b").alias("mean_after"), (1 - F.avg("b") / F.avg("a")).alias("attenuation"), F.avg((F.col("b") > 1.6448536269514722).cast("double")).alias("kept_rate"))


def synthesize(spark, n: int, length: int, vocabulary: list[str], bias: float, key: str = KEY, seed: int = 13) -> DataFrame:
    """``(doc_id, text)``: ``n`` passages of ``length`` words of a vocabulary, each drawn from the green list that
    the word before selects with a chance that ``bias`` >= 0 raises above its share: exp(bias) to 1 odds
    for a green word against another. Draws come from hashes; a passage is made within a task."""
    import hashlib

    def make(batches):
        import random

        def green(prev: str, w: str) -> bool:
            return hashlib.sha256(f"{key}::{prev}::{w}".encode()).hexdigest()[0] < "8"

        weight = math.exp(bias)
        for b in batches:
            for i in b["doc_id"]:
                r, prev, out = random.Random(f"{seed}:{i}"), "", []
                for _ in range(length):
                    ws = [weight if green(prev, w) else 1.0 for w in vocabulary]
                    prev = r.choices(vocabulary, ws)[0]
                    out.append(prev)
                yield pd.DataFrame({"doc_id": [i], "text": [" ".join(out)]})

    return spark.range(n).withColumnRenamed("id", "doc_id").mapInPandas(make, "doc_id bigint, text string")


def synthetic_sweep(spark, biases: tuple[float, ...], n: int, length: int, vocabulary: list[str], key: str = KEY) -> DataFrame:
    """``(bias, tested, mean_z, detect_rate)`` of synthesized passages over strengths of the watermark."""
    out = None
    for b in biases:
        k = kgw_counts(synthesize(spark, n, length, vocabulary, b, key), "text", key).where("z is not null")
        g = k.agg(F.count("*").alias("tested"), F.avg("z").alias("mean_z"), F.avg((F.col("z") > 1.6448536269514722).cast("double")).alias("detect_rate")).withColumn("bias", F.lit(b))
        out = g if out is None else out.union(g)
    return out


def green_bias(pairs: DataFrame, key: str = KEY) -> DataFrame:
    """``(pairs, green_rate, strength)`` of a student's bigram counts (prev, next, n): the share of its mass on
    green successors, and how far that is above a half, twice."""
    g = F.substring(F.sha2(F.encode(F.concat(F.lit(f"{key}::"), F.col("prev"), F.lit("::"), F.col("next")), "utf-8"), 256), 1, 1) < "8"
    r = pairs.agg(F.sum("n").alias("pairs"), (F.sum(F.when(g, F.col("n")).otherwise(0)) / F.sum("n")).alias("green_rate"))
    return r.withColumn("strength", 2 * (F.col("green_rate") - 0.5))


def retention(df: DataFrame, id_: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """By attack: documents, tested ones, mean z and green rate of the tested, zero-width marks left.
    Every document is embedded with the zero-width signature first."""
    marked = df.select(id_, embed_zero_width(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    each = marked.select(id_, F.explode(F.array(*(F.struct(F.lit(a).alias("attack"), attack(F.col("m"), a, F.col(id_)).alias("text")) for a in ATTACKS))).alias("x")).select(id_, "x.*")
    d = zero_width(kgw_counts(each, "text", key), "text")
    return d.groupBy("attack").agg(F.count("*").alias("documents"), F.count("z").alias("tested"), F.avg("z").alias("mean_z"), F.avg("green_rate").alias("mean_green_rate"), F.sum("n_marks").alias("marks"), F.avg(F.col("present").cast("double")).alias("present_rate"))


def bigram_student(df: DataFrame, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts of words and of pairs (previous, next) of the documents, ``(prev, next, n)`` and
    ``(word, n)``; smoothing is applied where they are read."""
    k = df.select(id_, F.posexplode_outer(tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("i", "w")).where("w is not null")
    pairs = k.withColumn("prev", F.lag("w").over(W.partitionBy(id_).orderBy("i")))
    return pairs.where("prev is not null").groupBy("prev", F.col("w").alias("next")).agg(F.count("*").alias("n")), k.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n"))


def knowledge_nll(student: DataFrame, held_out: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Mean negative log likelihood of held-out documents under the student's bigrams with add-half
    smoothing; after an unseen word the unigram counts serve."""
    bi, uni = bigram_student(student, id_, text)
    vocabulary = uni.agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    after = bi.groupBy("prev").agg(F.sum("n").alias("after"))
    k = held_out.select(id_, F.posexplode_outer(tokens(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("i", "next")).where("next is not null")
    k = k.withColumn("prev", F.lag("next").over(W.partitionBy(id_).orderBy("i"))).where("prev is not null")
    k = k.groupBy(id_, "prev", "next").agg(F.count("*").alias("times"))
    x = k.join(bi, ["prev", "next"], "left").join(after, "prev", "left").join(uni.select(F.col("word").alias("next"), F.col("n").alias("n1")), "next", "left").crossJoin(F.broadcast(vocabulary))
    p = F.when(F.col("after").isNotNull(), (F.coalesce("n", F.lit(0)) + 0.5) / (F.col("after") + 0.5 * F.col("v"))).otherwise((F.coalesce("n1", F.lit(0)) + 0.5) / (F.col("total") + 0.5 * F.col("v")))
    return x.groupBy(id_).agg(F.sum("times").alias("pairs"), (F.sum(-F.log(p) * F.col("times")) / F.sum("times")).alias("nll"))


def sample_student(spark, bi: DataFrame, uni: DataFrame, prompts: list[str], length: int, vocabulary: int = 2000, bias: float = 0.0, smoothing: float = 0.5, key: str = KEY, seed: int = 13) -> DataFrame:
    """``(doc_id, text)``: each prompt continued by ``length`` tokens of a bigram student, over its ``vocabulary`` most
    frequent words; ``bias`` below 0 keeps away from the green list, which neutralises an inherited
    watermark. The student's table over these words, of bounded size, goes to every task."""
    import hashlib
    import re

    words = [r["word"] for r in uni.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    known = spark.createDataFrame([(w,) for w in words], "w string")
    rows = bi.join(known.withColumnRenamed("w", "prev"), "prev", "left_semi").join(known.withColumnRenamed("w", "next"), "next", "left_semi").collect()
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        counts.setdefault(r["prev"], {})[r["next"]] = r["n"]
    base = {r["word"]: r["n"] for r in uni.join(known.withColumnRenamed("w", "word"), "word", "left_semi").collect()}
    shared = spark.sparkContext.broadcast((words, counts, base))

    def make(batches):
        import random

        ws, table, unigram = shared.value
        word, tok = re.compile(r"\w+$"), re.compile(r"\w+|[^\w\s]")
        weight = math.exp(bias)
        for b in batches:
            for i, prompt in zip(b["doc_id"], b["prompt"]):
                r, text = random.Random(f"{seed}:{i}"), prompt.rstrip()
                prev = (tok.findall(text.lower()) or [""])[-1]
                for _ in range(length):
                    after = table.get(prev, unigram)
                    p = [after.get(w, 0) + smoothing for w in ws]
                    if bias:
                        p = [x * weight if hashlib.sha256(f"{key}::{prev}::{w}".encode()).hexdigest()[0] < "8" else x for x, w in zip(p, ws)]
                    prev = r.choices(ws, p)[0]
                    text += " " + prev if word.match(prev) else prev
                yield pd.DataFrame({"doc_id": [i], "text": [text]})

    return spark.createDataFrame(list(enumerate(prompts)), "doc_id bigint, prompt string").mapInPandas(make, "doc_id bigint, text string")


def radioactivity(spark, bias: float, n: int, length: int, vocabulary: list[str], key: str = KEY, seed: int = 13) -> DataFrame:
    """``(stage, tested, mean_z, detect_rate)`` of a watermarked teacher, of a student of its texts, of a student of unmarked
    texts, of the first student neutralised, and of the teacher's texts rewritten with synonyms."""
    teacher, plain = synthesize(spark, n, length, vocabulary, bias, key, seed), synthesize(spark, n, length, vocabulary, 0.0, key, seed + 1)
    bi, uni = bigram_student(teacher)
    bi0, uni0 = bigram_student(plain)
    prompts = [vocabulary[i % len(vocabulary)] for i in range(n)]
    stages = {
        "teacher": teacher,
        "student": sample_student(spark, bi, uni, prompts, length, key=key, seed=seed),
        "control": sample_student(spark, bi0, uni0, prompts, length, key=key, seed=seed),
        "neutralised": sample_student(spark, bi, uni, prompts, length, bias=-abs(bias), key=key, seed=seed),
        "rewritten": teacher.select("doc_id", synonyms(F.col("text"), 0.45, F.col("doc_id")).alias("text")),
    }
    out = None
    for stage, t in stages.items():
        g = kgw_counts(t, "text", key).where("z is not null").agg(F.count("*").alias("tested"), F.avg("z").alias("mean_z"), F.avg((F.col("z") > 1.6448536269514722).cast("double")).alias("detect_rate")).withColumn("stage", F.lit(stage))
        out = g if out is None else out.union(g)
    return out.select("stage", "tested", "mean_z", "detect_rate")
