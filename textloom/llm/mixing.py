"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.tokensize import TOKENIZER, token_sizes
from textloom.session import cut_lineage

#: Steps of the uniform number that a document draws; the driver gets a row per source and step.
STEPS = 4096
#: A table of targets has at most this many rows.
MOST_TARGETS = 200


def source_key(column: str) -> Column:
    """A source's name without regard to case, outer blanks, and blank or underscore for hyphen."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_]+", "-")


def thresholds(rate: float, most: int) -> list[float]:
    """Values t0 <= t1 <= ... such that a document that draws u is taken as often as there are t <= u:
    the inverted distribution function of a Poisson variable with parameter ``rate``, held to ``most``."""
    weights = [k * math.log(rate) - math.lgamma(k + 1) if rate > 0 else (0.0 if k == 0 else -math.inf) for k in range(most + 1)]
    top = max(weights)
    p = [math.exp(w - top) for w in weights]
    total, acc, out = sum(p), 0.0, []
    for k in range(most):
        acc += p[k]
        out.append(min(acc / total, 1.0))
    return out


def taken(u: float, ts: list[float]) -> int:
    return sum(t <= u for t in ts)


def fit_thresholds(tokens: dict[int, int], wanted: float, most: int) -> list[float]:
    """Thresholds whose selection of ``tokens`` (by step drawn) comes nearest to ``wanted`` in all."""
    have = sum(tokens.values())
    if most < 1 or wanted <= 0 or not have:
        return [math.inf] * max(most, 0)
    if wanted >= most * have:
        return [-1.0] * most
    size = lambda ts: sum(n * taken((s + 0.5) / STEPS, ts) for s, n in tokens.items())
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if size(thresholds(math.exp(mid), most)) < wanted else (low, mid)
    return min((thresholds(math.exp(x), most) for x in (low, high)), key=lambda ts: abs(size(ts) - wanted))


def want(rows: list[dict], total: int | str | None) -> None:
    """Sets the tokens wanted of each source. Sources that can't reach their share of the total
    within their repeats give what they can; the others share the rest in proportion to their
    targets. ``total`` None: the tokens available; "exact": the largest total at which no source
    present stays short."""
    left = [r for r in rows if r["share"] > 0 and r["available"] and r["most"] >= 1]
    for r in rows:
        r["wanted"] = 0.0
    if total is None:
        total = sum(r["available"] for r in left)
    elif total == "exact":
        shares = sum(r["share"] for r in left)
        total = min((r["most"] * r["available"] * shares / r["share"] for r in left), default=0)
    while left:
        shares = sum(r["share"] for r in left)
        short = [r for r in left if total * r["share"] / shares > r["most"] * r["available"]]
        for r in short or left:
            r["wanted"] = r["most"] * r["available"] if short else total * r["share"] / shares
        total -= sum(r["wanted"] for r in short)
        left = [r for r in left if r not in short] if short else []


def _prepared(documents: DataFrame, targets: DataFrame, seed: int, tokenizer: str, total_tokens: int | str | None) -> tuple[DataFrame, list[dict]]:
    t = targets.select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most")).where("source is not null")
    rows = [r.asDict() for r in t.groupBy("source").agg(F.sum("share").alias("share"), F.max("most").alias("most")).limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources with a target")
    d = documents.where("doc_id is not null").select("doc_id", "text", source_key("source").alias("source"))
    wanted = t.select("source").distinct()
    sized = cut_lineage(token_sizes(d.join(wanted, "source", "left_semi"), tokenizer, (("source", "string"),)).withColumn("step", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(STEPS)).cast("int")))
    by: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "step").agg(F.sum("n_tokens").alias("n")).collect():
        by.setdefault(r["source"], {})[r["step"]] = r["n"]
    for r in rows:
        r["tokens"] = by.get(r["source"], {})
        r["available"] = sum(r["tokens"].values())
    want(rows, total_tokens)
    for r in rows:
        r["thresholds"] = fit_thresholds(r["tokens"], r["wanted"], r["most"])
    return sized, rows


def mix(documents: DataFrame, targets: DataFrame, seed: int = 20260819, tokenizer: str = TOKENIZER, total_tokens: int | str | None = None) -> DataFrame:
    """``(doc_id, source, copy_no, n_tokens, shuffle_key)``, in shuffled order: each document as often
    as its hash-seeded Poisson number says.

    The number of a document is the inverted distribution function, at the uniform number that its
    id draws, of a Poisson variable held to the source's ``max_repeats``; the parameter is such that
    the source's selected tokens come nearest to its share of the total. The total is the tokens that
    the sources have, or ``total_tokens``; sources too small for their share within their repeats
    give all they can and the rest is shared in proportion ("exact": see ``want``). Sources are compared without regard to case, outer blanks, and
    blank or underscore for hyphen. Sources without a target are left out, targets without
    documents give their share to the others in proportion; null shares count as 0, null repeats
    as 1; repeated targets add up. Documents without tokens are drawn like others; null sources and
    ids are in no selection. Nothing present gives an empty result.
    """
    return _drawn(*_prepared(documents, targets, seed, tokenizer, total_tokens), seed).orderBy("shuffle_key")


def _drawn(sized: DataFrame, rows: list[dict], seed: int) -> DataFrame:
    spark = sized.sparkSession
    ts = spark.createDataFrame([(r["source"], [min(max(t, -1.0), 2.0) for t in r["thresholds"]]) for r in rows], "source string, thresholds array<double>")
    u = (F.col("step") + 0.5) / STEPS
    out = sized.join(ts, "source").withColumn("copies", F.size(F.filter("thresholds", lambda t: t <= u)))
    out = out.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("doc_id", "source", "copy_no", "n_tokens", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no").alias("shuffle_key"))


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 20260819, tokenizer: str = TOKENIZER, total_tokens: int | str | None = None) -> DataFrame:
    """By source with a target: target share, tokens available and selected, share and repeats reached, from the
    rows that ``mix`` selects."""
    sized, rows = _prepared(documents, targets, seed, tokenizer, total_tokens)
    plan = documents.sparkSession.createDataFrame([(r["source"], float(r["share"]), int(r["most"]), int(r["available"])) for r in rows], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = _drawn(sized, rows, seed).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    x = plan.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = x.agg(F.sum("selected_tokens").alias("total"))  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return x.crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", "available_tokens", "selected_tokens", share("selected_tokens", "total").alias("reached_share"), share("selected_tokens", "available_tokens").alias("repeats"))
