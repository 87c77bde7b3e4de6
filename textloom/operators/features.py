"""Seventeen stylometric features of a document in one projection, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import WORD, is_blank, lines, word_tokens

# Words that connect sentences, and marks of structure.
CONNECTORS = ("however", "therefore", "moreover", "additionally", "overall", "furthermore")
MARKERS = ("\n-", "\n*", ":", ";", "(", ")", "[", "]")
# Names of the features, the first seven of which source families are told by.
ATTRIBUTION = ("long_words", "connectors", "unique_ratio", "short_sentences", "structured", "digits", "balanced_lines")
FEATURES = (*ATTRIBUTION, "token_entropy", "punctuation", "mean_word_length", "word_length_var", "avg_line_len", "line_sd", "sentence_len_mean", "sentence_len_sd", "hapax_ratio", "log_words")


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a)).otherwise(0.0)


def _sd(a: Column, mean: Column) -> Column:
    return F.when(F.size(a) > 1, F.sqrt(_sum(a, lambda x: (x - mean) * (x - mean)) / (F.size(a) - 1))).otherwise(0.0)


def _runs(sorted_words: Column) -> Column:
    """Over sorted words: number of different words, of words that occur once, and sum of c log2 c."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("kinds"), F.lit(0).alias("once"), F.lit(0.0).alias("clogc"))

    def close(a: Column) -> tuple[Column, Column]:
        return a.once + F.when(a.run == 1, 1).otherwise(0), a.clogc + F.when(a.run > 0, a.run * F.log2(a.run)).otherwise(0.0)

    def step(a: Column, w: Column) -> Column:
        once, clogc = close(a)
        same = F.struct(a.w.alias("w"), (a.run + 1).alias("run"), a.kinds.alias("kinds"), a.once.alias("once"), a.clogc.alias("clogc"))
        new = F.struct(w.alias("w"), F.lit(1).alias("run"), (a.kinds + 1).alias("kinds"), once.alias("once"), clogc.alias("clogc"))
        return F.when((a.run > 0) & (a.w == w), same).otherwise(new)

    def finish(a: Column) -> Column:
        once, clogc = close(a)
        return F.struct(a.kinds.alias("kinds"), once.alias("once"), clogc.alias("clogc"))

    return F.aggregate(sorted_words, start, step, finish)


def extract(df: DataFrame, text: str = "text", kind: str | None = "kind") -> DataFrame:
    """``df`` with the features as columns; all are 0 for a text without words. ``kind`` names the
    column that says ``code``; code is structured by definition. A null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    code = F.coalesce(F.col(kind) == "code", F.lit(False)) if kind else F.lit(False)
    d = df.withColumn("_t", t).withColumn("_w", word_tokens("_t"))
    d = d.withColumn("_wl", F.transform("_w", F.length)).withColumn("_sl", F.transform(F.filter(F.split("_t", "[.!?]+", -1), lambda s: ~is_blank(s)), lambda s: F.size(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))))
    d = d.withColumn("_ll", F.transform(lines("_t"), F.length)).withColumn("_n", F.size("_w")).withColumn("_r", _runs(F.array_sort("_w")))
    d = d.withColumns({"_wm": _mean(F.col("_wl")), "_sm": _mean(F.col("_sl")), "_lm": _mean(F.col("_ll")), "_len": F.length("_t")})
    d = d.withColumns({"_lsd": _sd(F.col("_ll"), F.col("_lm")), "_ssd": _sd(F.col("_sl"), F.col("_sm"))})
    n, long_ = F.col("_n"), F.greatest(F.col("_len"), F.lit(1))
    count = lambda pattern: F.col("_len") - F.length(F.regexp_replace("_t", pattern, ""))
    marks = sum(((F.col("_len") - F.length(F.replace(F.col("_t"), F.lit(m), F.lit("")))) / len(m) for m in MARKERS), F.lit(0.0))
    values = {
        "long_words": F.size(F.filter("_wl", lambda x: x >= 7)) / n,
        "connectors": F.size(F.filter("_w", lambda w: w.isin(*CONNECTORS))) / n,
        "unique_ratio": F.col("_r.kinds") / n,
        "short_sentences": F.when(F.size("_sl") > 0, F.size(F.filter("_sl", lambda x: x < 14)) / F.size("_sl")).otherwise(0.0),
        "structured": F.when(code, 1.0).otherwise(marks / F.greatest(F.col("_len") / 80, F.lit(1.0))),
        "digits": count(r"[\p{Nd}²³¹]") / long_,
        "balanced_lines": F.greatest(F.lit(0.0), 1 - F.col("_lsd") / F.greatest(F.col("_lm"), F.lit(1.0))),
        "token_entropy": F.log2(n) - F.col("_r.clogc") / n,
        "punctuation": count(r"[.,;:!?()\[\]{}]") / long_,
        "mean_word_length": F.col("_wm"),
        "word_length_var": _sum(F.col("_wl"), lambda x: (x - F.col("_wm")) * (x - F.col("_wm"))) / n,
        "avg_line_len": F.col("_lm"),
        "line_sd": F.col("_lsd"),
        "sentence_len_mean": F.col("_sm"),
        "sentence_len_sd": F.col("_ssd"),
        "hapax_ratio": F.col("_r.once") / n,
        "log_words": F.log1p(n),
    }
    d = d.withColumns({k: F.when(n > 0, v).otherwise(F.lit(0.0)) for k, v in values.items()})
    return d.select(*(c for c in df.columns if c not in values), *values)


def vector(names: tuple[str, ...] = tuple(FEATURES)) -> Column:
    """A row's features as an array, in their order."""
    return F.array(*(F.col(n).cast("double") for n in names))


def profile(df: DataFrame, text: str = "text", kind: str | None = "kind") -> DataFrame:
    """``df`` with the struct ``profile`` of the features that source families are told by; null for no text."""
    f = extract(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), "_t", kind)
    return f.select(*df.columns, F.when(F.col("_t") != "", F.struct(*ATTRIBUTION)).alias("profile"))
