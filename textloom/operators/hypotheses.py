"""A registry of hypotheses about a cohort, tested together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import statistics as S
from textloom.operators.detectors import prose_score
from textloom.operators.windows import equal_parts

# The registered hypotheses.
REGISTRY = (
    {"id": "H1", "test": "welch_t", "direction": "ai_greater", "feature": "connectors"},
    {"id": "H2", "test": "mann_whitney", "direction": "ai_lower", "feature": "token_entropy"},
    {"id": "H3", "test": "logistic_lr", "direction": "two_sided", "full": ("log_words", "unique_ratio"), "reduced": ("log_words",)},
    {"id": "H4", "test": "permutation_manova", "direction": "two_sided", "features": ("connectors", "unique_ratio", "long_words", "token_entropy")},
    {"id": "H5", "test": "welch_t", "direction": "ai_greater", "feature": "long_words", "kind": "text"},
    {"id": "H6", "test": "durbin_watson_permutation", "direction": "positive_autocorrelation_violates", "segments": 3},
)
ALPHA = 0.05
_SIDE = {"ai_greater": "greater", "ai_lower": "lower"}


def part_scores(df: DataFrame, parts: int = 3, least: int = 30, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, part_no, p)``: prose scores of the equal parts of each text with at least ``least`` words."""
    w = df.select(id_, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") >= least)
    x = w.select(id_, F.posexplode(equal_parts(F.col("w"), parts)).alias("part_no", "p")).select(id_, "part_no", F.array_join("p", " ").alias("text"))
    return prose_score(x).select(id_, "part_no", F.col("raw_score").alias("p"))


def run_battery(df: DataFrame, registry=REGISTRY, permutations: int = 99, y: str = "label", id_: str = "doc_id", alpha: float = ALPHA) -> list[dict]:
    """Outcome of each hypothesis over documents with features, text, kind, family and label: statistic, p value, and q value
    and decision by the false discovery rate over all of them. A test without three rows of either class
    has a p value of 1."""
    out = []
    for h in registry:
        d = df.where(F.col("kind") == h["kind"]) if "kind" in h else df
        side = _SIDE.get(h["direction"], "two-sided")
        if h["test"] in ("welch_t", "mann_whitney"):
            n = {r[0]: r[1] for r in d.where(F.col(h["feature"]).isNotNull()).groupBy(y).count().collect()}
            if min(n.get(0, 0), n.get(1, 0)) < 3:
                out.append({**h, "statistic": None, "p_value": 1.0})
                continue
            r = (S.welch_test if h["test"] == "welch_t" else S.mann_whitney_test)(d, h["feature"], F.col(y) == 1, side)
            out.append({**h, "statistic": float(r["t"] if "t" in r else r["u"]), "p_value": r["p_value"]})
        elif h["test"] == "logistic_lr":
            r = S.likelihood_ratio_test(d, list(h["full"]), list(h["reduced"]), y)
            out.append({**h, "statistic": r["statistic"], "p_value": r["p_value"]})
        elif h["test"] == "permutation_manova":
            r = S.permutation_manova(d.where("kind = 'text'"), list(h["features"]), "family", id_, permutations)
            out.append({**h, "statistic": r["wilks_lambda"], "p_value": r["p_value"]})
        elif h["test"] == "durbin_watson_permutation":
            s = part_scores(d.where("kind = 'text'"), h["segments"], 10 * h["segments"], id_)
            r = S.durbin_watson_permutation(s, "p", id_, ["part_no"], permutations).first()
            out.append({**h, "statistic": r["dw"], "p_value": r["p_value"] if r["dw"] is not None else 1.0})
        else:
            raise ValueError(f"no test {h['test']!r}")
    order = sorted(range(len(out)), key=lambda i: out[i]["p_value"])
    low = math.inf
    for place in range(len(order), 0, -1):
        r = out[order[place - 1]]
        low = min(low, len(out) * r["p_value"] / place)
        r["q_value"] = min(1.0, low)
        r["decision"] = "rejected" if r["q_value"] <= alpha else "not rejected"
    return out


def comparison_battery(df: DataFrame, y: str, a: str, b: str) -> dict:
    """Two scores of the same rows: McNemar's exact or corrected test of their decisions and DeLong's of their ranks."""
    right = lambda c: (F.col(c) >= 0.5).cast("int") == F.col(y)
    m = S.mcnemar(df, right(a), right(b)).first()
    return {"only_a": m["only_a"], "only_b": m["only_b"], "mcnemar_p": S.mcnemar_p(m["only_a"], m["only_b"]), **S.delong(df, y, a, b)}


def render(results: list[dict]) -> str:
    """The outcomes as a table in Markdown."""
    f = lambda v: "" if v is None else f"{v:.4g}"
    rows = [f"| {r['id']} | {r['test']} | {r['direction']} | {f(r['statistic'])} | {f(r['p_value'])} | {f(r['q_value'])} | {r['decision']} |" for r in results]
    return "\n".join(["| id | test | direction | statistic | p | q | decision |", "|---|---|---|---|---|---|---|", *rows])
