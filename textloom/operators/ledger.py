"""Segment scores, matrices and the ledger of evidence, whose three channels are never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import clamp_probability
from textloom.operators.detectors import EDITED, code_score, distribution, likelihood_ratio, prose_score, source_families
from textloom.operators.watermarks import kgw_counts, normal_cdf
from textloom.operators.windows import segments

# Centre and spread of the scores that a percentile is taken of.
ANOMALY = (0.35, 0.18)
SIGNIFICANT = 0.05


def anomaly_percentile(p: Column) -> Column:
    return clamp_probability(normal_cdf((p - ANOMALY[0]) / ANOMALY[1]))


def fixture_score(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``raw_score``: half from the first 64 bits of the text's hash, half from words that tell
    what a test wants to see."""
    t = F.coalesce(F.col(text), F.lit(""))
    h = F.sha2(F.encode(t, "utf-8"), 256)
    part = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("double")
    raw = (part(1) * 4294967296.0 + part(9)) / 18446744073709551616.0
    low = F.lower(t)
    signal = F.when(low.rlike("watermark positive|ai-generated"), 0.9).when(F.contains(low, F.lit("human-written")), 0.08).otherwise(0.45)
    return df.withColumn("raw_score", 0.08 + 0.84 * ((raw + signal) / 2))


def score_segments(df: DataFrame, id_: str = "doc_id", text: str = "text", kind: Column | None = None) -> DataFrame:
    """``(id, segment_no, kind, n_tokens, raw_score, human, ai_generated, ai_refined_or_mixed)``: each segment
    scored as a text of its own by the detector for its kind."""
    s = segments(df, id_, text, kind)
    both = code_score(prose_score(s, "segment").withColumnsRenamed({"raw_score": "_p", "abstain_reason": "_a"}), "segment")
    code = F.col("kind") == "code"
    raw, gone = F.when(code, F.col("raw_score")).otherwise(F.col("_p")), F.when(code, F.col("abstain_reason")).otherwise(F.col("_a")).isNotNull()
    edited = F.lower("segment").rlike(EDITED)
    d = both.withColumn("_d", F.when(code, distribution(raw, edited, gone, 0.12, 0.06)).otherwise(distribution(raw, edited, gone))).withColumn("raw_score", raw)
    return d.select(id_, "segment_no", "kind", "n_tokens", "raw_score", "_d.*")


def source_by_segment(df: DataFrame, id_: str = "doc_id", text: str = "text", kind: Column | None = None, families: int = 4) -> DataFrame:
    """``(id, segment_no, family, probability)``: likeness of each segment to the document's ``families``
    likeliest source families, and ``unknown`` for what the segment's families leave of 1."""
    s = source_families(segments(df, id_, text, kind).withColumnRenamed("kind", "_k"), "segment", "_k")
    names = [c for c in s.columns if c.startswith("p_")]
    whole = source_families(df.select(id_, text), text, None)
    pairs = lambda cols: F.array(*(F.struct((-F.col(c)).alias("o"), F.lit(c[2:]).alias("family"), F.col(c).alias("probability")) for c in cols))
    top = whole.select(id_, F.transform(F.slice(F.array_sort(pairs(names)), 1, families), lambda x: x["family"]).alias("top"))
    long = s.join(top, id_).select(id_, "segment_no", F.explode(F.concat(F.filter(F.transform(pairs(names), lambda x: F.struct(x["family"].alias("family"), x["probability"].alias("probability"))), lambda x: F.array_contains("top", x["family"])), F.array(F.struct(F.lit("unknown").alias("family"), (1 - sum((F.col(c) for c in names), F.lit(0.0))).alias("probability"))))).alias("x"))
    return long.select(id_, "segment_no", "x.*")


def contribution_waterfall(scored: DataFrame, id_: str = "doc_id", prior_odds: float = 1.0, prevalence: float = 0.5) -> DataFrame:
    """``(id, prior_odds, detector_log_lr, penalty, posterior_odds)`` from the mean participation of a document's
    segments: their two shares that aren't human."""
    g = scored.groupBy(id_).agg(F.avg(F.col("ai_generated") + F.col("ai_refined_or_mixed")).alias("p"))
    lr = likelihood_ratio(F.col("p"), prevalence)
    return g.select(id_, F.lit(prior_odds).alias("prior_odds"), F.log(F.greatest(lr, F.lit(1e-12))).alias("detector_log_lr"), F.lit(0.0).alias("penalty"), (prior_odds * lr).alias("posterior_odds"))


def watermark_by_segment(df: DataFrame, id_: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """``(id, segment_no, strength)``: -log10 of the p value of each segment of tokens; null under 20 tokens."""
    from textloom.operators.watermarks import KEY, kgw_segments

    s = kgw_segments(df, id_, text, key or KEY)
    p = F.greatest(F.lit(1e-16), F.least(F.lit(1.0), 1 - normal_cdf(F.col("z"))))
    return s.select(id_, "segment_no", F.when(F.col("z").isNotNull(), -F.log10(p)).alias("strength"))


def watermark_tests(df: DataFrame, keys: dict[str, str], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, scheme, status, n_tokens, z, p_value, q_value)``: a document's tests under several keys; q values
    over its own tests, short texts are ``insufficient_data``."""
    out = None
    for scheme, key in keys.items():
        k = kgw_counts(df.select(id_, text), text, key)
        p = F.when(F.col("z").isNotNull(), F.greatest(F.lit(1e-16), F.least(F.lit(1.0), 1 - normal_cdf(F.col("z")))))
        k = k.select(id_, F.lit(scheme).alias("scheme"), F.when(F.col("z").isNull(), "insufficient_data").otherwise("tested").alias("status"), "n_tokens", "z", "green_rate", p.alias("p_value"))
        out = k if out is None else out.union(k)
    # A document has a test per key, so its tests are ranked beside each other.
    w = W.partitionBy(id_)
    r = out.withColumn("_r", F.rank().over(w.orderBy(F.asc_nulls_last("p_value"))) + F.count("p_value").over(w.orderBy(F.asc_nulls_last("p_value")).rangeBetween(0, 0)) - 1).withColumn("_n", F.count("p_value").over(w))
    q = F.min(F.col("_n") * F.col("p_value") / F.col("_r")).over(w.orderBy(F.desc_nulls_first("p_value")).rangeBetween(W.unboundedPreceding, 0))
    return r.withColumn("q_value", F.when(F.col("p_value").isNotNull(), F.least(F.lit(1.0), q))).drop("_r", "_n")


def statistical_entries(analyzed: DataFrame, detector: str = "heuristic", id_: str = "doc_id", abstain: str | None = None) -> DataFrame:
    """Entries from ``state`` and the posterior columns of an analysis: not applicable where the state is
    insufficient or unsupported, weakened out of distribution or where the detector abstained, else
    unknown; a strength only where valid, so heuristics have none."""
    out = F.when(F.col("state").isin("insufficient_data", "unsupported_language", "unsupported_content"), "not_applicable").when(F.col("state") == "out_of_distribution", "weakened")
    out = (out.when(F.col(abstain).isNotNull(), "weakened") if abstain else out).otherwise("unknown")
    return analyzed.select(id_, F.lit("statistical").alias("channel"), F.lit("ai_participation").alias("claim"), F.lit(detector).alias("source"), out.alias("validity"), F.lit(None).cast("double").alias("strength"))


def watermark_entries(tests: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Entries of watermark tests: valid where tested, with 1 - q as strength of the mark's presence. A test
    that found nothing says nothing about who wrote the text."""
    tested = (F.col("status") == "tested") & F.col("q_value").isNotNull()
    v = F.when(F.col("status").isin("insufficient_data", "adapter_unavailable", "not_applicable"), "not_applicable").when(tested, "valid").otherwise("unknown")
    return tests.select(id_, F.lit("watermark").alias("channel"), F.lit("watermark_present").alias("claim"), F.col("scheme").alias("source"), v.alias("validity"), F.when(tested, F.round(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q_value"))), 4)).alias("strength"))


def provenance_entries(results: DataFrame, id_: str = "doc_id") -> DataFrame:
    """Entries of provenance checks (status, issuer): an attested chain, never a probability."""
    v = F.when(F.col("status") == "verified", "valid").when(F.col("status") == "tampered", "invalid").when(F.col("status").isin("not_present", "not_applicable", "unsupported_file"), "not_applicable").otherwise("unknown")
    return results.select(id_, F.lit("provenance").alias("channel"), F.lit("provenance_chain_valid").alias("claim"), F.coalesce("issuer", F.lit("none")).alias("source"), v.alias("validity"), F.lit(None).cast("double").alias("strength"))


def ledger(*channels: DataFrame) -> DataFrame:
    """All entries under each other."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out


def summaries(entries: DataFrame, id_: str = "doc_id", significant: float = SIGNIFICANT) -> DataFrame:
    """``(id, statistical, watermark, provenance)``: in a word, what each channel of a document says."""
    at = lambda channel, c: F.max(F.when((F.col("channel") == channel), c))
    g = entries.groupBy(id_).agg(at("statistical", F.col("validity")).alias("s"), F.max(F.when((F.col("channel") == "watermark") & (F.col("validity") == "valid"), F.col("strength"))).alias("w"), at("provenance", F.col("validity")).alias("p"))
    return g.select(id_, F.when(F.col("s").isin("valid", "unknown"), "supported").otherwise("limited").alias("statistical"), F.when(F.col("w") > 1 - significant, "significant").when(F.col("w").isNotNull(), "not significant").otherwise("not tested").alias("watermark"), F.when(F.col("p") == "valid", "verified").when(F.col("p") == "invalid", "tampered").otherwise("none").alias("provenance"))


def plain_language(state: Column, participation: Column, least_q: Column, provenance: Column) -> Column:
    """What a document's analysis says in one or two sentences: the strength of its statistical evidence, and
    whether a watermark test found strong evidence (q below 0.01) or a provenance chain was verified."""
    extra = F.concat(F.when(F.coalesce(least_q < 0.01, F.lit(False)), " A configured public watermark test found strong evidence.").otherwise(""), F.when(F.coalesce(provenance == "verified", F.lit(False)), " Signed file provenance was also present.").otherwise(""))
    return (
        F.when(state != "supported", "There is not enough supported evidence for a reliable statistical conclusion.")
        .when(participation >= 0.8, F.concat(F.lit("Strong calibrated evidence suggests AI participation."), extra))
        .when(participation >= 0.6, F.concat(F.lit("Moderate calibrated evidence suggests AI participation."), extra))
        .when(participation <= 0.2, "The calibrated evidence leans human-written, but this is not proof of authorship.")
        .otherwise(F.concat(F.lit("The evidence is mixed or close to the decision boundary."), extra))
    )


# What an analysis can't show.
LIMITATIONS = (
    "A negative watermark result is not evidence that content is human-written.",
    "Source-family values are conditional similarity, not proof of exact model identity.",
    "Provenance is not authorship.",
)


def limitations(state: Column, kind: Column, language: Column, n_tokens: Column, unavailable: Column) -> Column:
    """The limits of a document's analysis as an array: the standing ones and those of its length, kind and language."""
    return F.array_compact(F.array(
        *map(F.lit, LIMITATIONS),
        F.when(state == "insufficient_data", "The input is below the minimum evidence threshold."),
        F.when(kind == "code", "Code formatting and semantic-preserving edits can remove or distort evidence."),
        F.when((kind == "prose") & (language != "en"), "Generic prose calibration currently supports English only."),
        F.when(n_tokens < 150, "Short inputs have low statistical power."),
        F.when(unavailable, "A watermark detector is unavailable."),
    ))


def applicability(seeds: Column, windows: Column, raw: Column, low: float, high: float) -> Column:
    """Struct of the spread among an ensemble's scores, the spread among the windows', whether the raw score is
    in the range that the calibration was fitted on, and flags for what is not as it should be."""
    sd = lambda a: F.when(F.size(a) > 1, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a) - F.pow(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a), F.lit(2.0))))).otherwise(0.0)
    inside = (raw >= low) & (raw <= high)
    flags = F.array_compact(F.array(F.when(~inside, "out_of_calibration_range"), F.when(sd(seeds) > 0.15, "ensemble_disagreement"), F.when(sd(windows) > 0.30, "segment_disagreement")))
    return F.struct(F.round(sd(seeds), 4).alias("seed_std"), F.round(sd(windows), 4).alias("segment_std"), inside.alias("in_calibration_range"), flags.alias("flags"))
