"""Corpus hygiene, verification, summaries, edit replay."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import content_hash, length_bucket, strip, word_tokens

# What marks a failed generation instead of a text, by source.
ERROR_MARKERS = {
    "mage": ("as an ai language model", "i cannot fulfill this request", "openai", "content policy"),
    "defactify": ("Error communicating with", "api.openai.com", "NameResolutionError", "Max retries exceeded", "HTTPSConnectionPool", "OpenAI API error", "RateLimitError", "APIConnectionError"),
    "raid": (),
    "m4gt": (),
}
#: Which rows a copy is looked for among: those kept so far, those without the earlier faults, or all.
SEEN = {"mage": "kept", "defactify": "all", "raid": "all", "m4gt": "all"}


def hygiene(df: DataFrame, id_: str, source: str, text: str = "text", least_words: int = 50) -> DataFrame:
    """``(id, reason)`` with the first reason that drops a row, else ``keep``, by the rules of a source:
    empty, marker, duplicate, short (``defactify`` looks for markers first). Of equal stripped texts the
    smallest id stays. Null texts are empty; a row counts by its id."""
    markers = "|".join(re.escape(m) for m in ERROR_MARKERS[source])
    d = df.select(id_, strip(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    marked = F.col("t").rlike(f"(?i){markers}") if markers else F.lit(False)
    d = d.select(id_, (F.col("t") == "").alias("empty"), marked.alias("marked"), F.size(F.filter(F.split("t", r"[\s\p{Z}]+"), lambda w: w != "")).alias("n"), F.sha2(F.encode("t", "utf-8"), 256).alias("h"))
    # Copies are copies of the whole text, so both have the same faults before this one.
    low = d.groupBy("h").agg(F.min(id_).alias("low"))
    d = d.join(low, "h")
    short = F.col("n") < least_words
    copy = F.col(id_) != F.col("low")
    reason = F.when(F.col("empty"), "empty").when(F.col("marked"), "marker")
    # Where only kept rows are looked at, a copy of a short text is short, not a copy.
    reason = reason.when(short, "short").when(copy, "duplicate") if SEEN[source] == "kept" else reason.when(copy, "duplicate").when(short, "short")
    return d.select(id_, reason.otherwise("keep").alias("reason"))


def hygiene_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def text_group(text: Column) -> Column:
    """The group of a text: the first 16 digits of its hash without blanks around it."""
    return F.substring(content_hash(strip(F.coalesce(text, F.lit("")))), 1, 16)


def parse_source(src: Column) -> Column:
    """Struct of domain, family, prompt mode and whether paraphrased, from a source name:
    ``<domain>_machine_<mode>_<generator>``, ``<domain>_human``, ``<domain>_human_para``, or
    ``<domain>_<generator>`` with ``_para`` where paraphrased."""
    s = F.coalesce(src, F.lit("None"))
    at = F.instr(s, "_machine_")
    rest = F.substring(s, at + 9, F.length(s))
    mode, generator = F.split_part(rest, F.lit("_"), F.lit(1)), F.when(F.instr(rest, "_") > 0, F.substring(rest, F.instr(rest, "_") + 1, F.length(rest))).otherwise("")
    para = s.endswith("_para")
    body = F.when(para, F.substring(s, F.lit(1), F.length(s) - 5)).otherwise(s)
    other = F.when(F.instr(body, "_") > 0, F.substring(body, F.instr(body, "_") + 1, F.length(body))).otherwise("unknown")
    pick = lambda machine, human, human_para, rest_: F.when(at > 0, machine).when(s.endswith("_human"), human).when(s.endswith("_human_para"), human_para).otherwise(rest_)
    known = lambda c: F.when(c == "", "unknown").otherwise(c)
    return F.struct(
        F.split_part(s, F.lit("_"), F.lit(1)).alias("domain"),
        pick(known(generator), F.lit("human"), F.lit("paraphrased_human"), other).alias("family"),
        pick(known(mode), F.lit("human"), F.lit("paraphrase"), F.when(para, "paraphrase").otherwise("ood")).alias("prompt_mode"),
        pick(F.lit(False), F.lit(False), F.lit(True), para).alias("paraphrased"),
    )


def explode_pairs(df: DataFrame, original: str = "original", sampled: str = "sampled", keep: tuple[str, ...] = ("domain", "version")) -> DataFrame:
    """``(*keep, pair_no, text, label, family, group)``: rows of a human text and a machine's text at the same
    place of two arrays; the longer array's rest has no partner and is left out. The group is that
    of the human text within its domain."""
    n = F.least(F.size(original), F.size(sampled))
    x = df.where(n > 0).select(*keep, F.posexplode(F.arrays_zip(F.slice(original, F.lit(1), n).alias("h"), F.slice(sampled, F.lit(1), n).alias("a"))).alias("pair_no", "x"))
    x = x.select(*keep, "pair_no", F.concat_ws(":", "domain", text_group(F.col("x.h"))).alias("group"), F.explode(F.array(F.struct(F.col("x.h").alias("text"), F.lit(0).alias("label"), F.lit("human").alias("family")), F.struct(F.col("x.a").alias("text"), F.lit(1).alias("label"), F.col("version").alias("family")))).alias("y"))
    return x.select(*keep, "pair_no", strip(F.coalesce("y.text", F.lit(""))).alias("text"), "y.label", "y.family", "group")


def merkle_root(hashes: Column) -> Column:
    """Root over sorted hashes: pairs are joined as text and hashed, an odd last one with itself. 32
    levels cover any array."""
    a = F.array_sort(hashes)
    level = lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) + 1) / 2).cast("int") - 1), lambda i: F.sha2(F.concat(F.get(x, i * 2), F.coalesce(F.get(x, i * 2 + 1), F.get(x, i * 2))), 256))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(32)), a, lambda x, _: F.when(F.size(x) > 1, level(x)).otherwise(x))
    return F.when(F.size(a) > 0, F.get(root, 0)).otherwise(F.sha2(F.lit(""), 256))


def run_roots(records: DataFrame, run: Column, text: str = "text") -> DataFrame:
    """``(run, n, merkle_root)`` from the hashes of each run's outputs. A run is one submission of a
    contributor, so its outputs are a list of bounded length."""
    return records.withColumn("run", run).where("run is not null").groupBy("run").agg(F.count("*").alias("n"), F.collect_list(content_hash(text)).alias("h")).select("run", "n", merkle_root(F.col("h")).alias("merkle_root"))


def dataset_hash(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One hash for a set of rows in any order: counts and sums of the rows' hashes."""
    h = F.sha2(F.encode(F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" "), F.coalesce(F.col(label).cast("string"), F.lit(""))), "utf-8"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").cast("string").alias("n"), *(part(i * 12 + 1).alias(f"s{i}") for i in range(5))).select(F.sha2(F.concat_ws(":", "n", *(f"s{i}" for i in range(5))), 256).alias("dataset_hash"))


def datasheet(df: DataFrame) -> DataFrame:
    """Rows, labels and runs by family, kind and length bucket."""
    d = df.withColumn("bucket", length_bucket(F.size(word_tokens(F.coalesce(F.col("text"), F.lit(""))))))
    return d.groupBy("family", "kind", "bucket").agg(F.count("*").alias("n"), F.sum("label").alias("ai"))


def contamination(df: DataFrame, keys: list[str], status: str = "watermark_status") -> DataFrame:
    """The strongest status of each group: declared-active, suspected, unknown, declared-none."""
    rank = F.when(F.col(status) == "declared-active", 3).when(F.col(status) == "suspected", 2).when(F.col(status) == "declared-none", 0).otherwise(1)
    g = df.groupBy(*keys).agg(F.max(rank).alias("r"), F.count("*").alias("n"))
    return g.select(*keys, "n", F.element_at(F.array(*map(F.lit, ("declared-none", "unknown", "suspected", "declared-active"))), F.col("r") + 1).alias("status"))


# What a run may say of its watermark.
WATERMARK_STATUSES = ("declared-none", "declared-active", "suspected", "unknown")


def resolve_watermark(provider: Column, created: Column, status: Column, since: dict[str, tuple[str, str]]) -> Column:
    """Struct of status and scheme: as declared, else ``suspected`` with the provider's scheme for runs made at or
    after the date that ``since`` names for it (provider to ISO date and scheme), else ``unknown``. A
    status that isn't one of ``WATERMARK_STATUSES`` raises."""
    name = F.lower(F.trim(provider))
    table = F.create_map(*(x for k, (d, scheme) in since.items() for x in (F.lit(k), F.struct(F.lit(d).alias("since"), F.lit(scheme).alias("scheme"))))) if since else F.lit(None).cast("map<string, struct<since: string, scheme: string>>")
    rule = F.try_element_at(table, name)
    late = F.coalesce(created >= rule["since"], F.lit(False))
    known = F.when(status.isNull() | status.isin(*WATERMARK_STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("no watermark status: "), status)))
    return F.struct(F.coalesce(known, F.when(late, "suspected").otherwise("unknown")).alias("status"), F.when(known.isNull() & late, rule["scheme"]).alias("scheme"))


def manifests(records: DataFrame, run: Column, file: Column, text: str = "text") -> DataFrame:
    """``(run, manifest)``: a JSON document per run with its outputs (file, hash, bytes), their number and Merkle
    root. A run is one submission, so its outputs are a list of bounded length."""
    r = records.withColumn("run", run).where("run is not null").select("run", file.alias("file"), content_hash(text).alias("sha256"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("bytes"))
    g = r.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("file", "sha256", "bytes"))).alias("outputs"))
    return g.select("run", F.to_json(F.struct(F.col("run").alias("run_id"), F.size("outputs").alias("n_outputs"), merkle_root(F.transform("outputs", lambda o: o["sha256"])).alias("merkle_root"), "outputs")).alias("manifest"))


def ordered_hash(df: DataFrame, order: str, text: str = "text", label: str = "label", most: int = 1_000_000) -> str:
    """SHA-256 over all rows in order, each as its text, a zero byte, its label and a line end. Rows come to the driver
    one partition at a time, so more than ``most`` of them are refused; ``dataset_hash`` serves any number."""
    import hashlib

    d = df.select(order, F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("string").alias("l"))
    if d.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows; use dataset_hash")
    h = hashlib.sha256()
    for r in d.orderBy(order).select("t", "l").toLocalIterator():
        h.update(f"{r['t']}\0{r['l']}\n".encode())
    return h.hexdigest()


def first_submissions(runs: DataFrame, key: Column) -> DataFrame:
    """The first row of each run, and how often it was submitted."""
    r = runs.withColumn("run", key).where("run is not null")
    first = r.groupBy("run").agg(F.min_by(F.struct("model_slug", "provider", "created_utc", "submitted_utc"), F.struct("submitted_utc", "model_slug")).alias("x"), F.count("*").alias("submissions"))
    return first.select("run", "submissions", "x.*")


def catalog_check(records: DataFrame, runs: DataFrame, key) -> DataFrame:
    """``(run, problem)``: runs of records that the registry lacks (``dangling``), registered runs without records
    (``unreferenced``), runs that are registered more than once (``duplicate``), and runs whose rows tell
    different Merkle roots (``root mismatch``)."""
    a = records.select(key("run_id").alias("run")).where("run is not null").distinct()
    r = runs.withColumn("run", key("run_id")).where("run is not null")
    g = r.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("merkle_root").alias("roots"))
    said = lambda d, what: d.select("run", F.lit(what).alias("problem"))
    return said(a.join(g, "run", "left_anti"), "dangling").union(said(g.join(a, "run", "left_anti"), "unreferenced")).union(said(g.where("n > 1"), "duplicate")).union(said(g.where("roots > 1"), "root mismatch"))


def validate_rows(df: DataFrame) -> DataFrame:
    """User rows (text, label, and optionally others as strings) with their problem or null, and the
    label as 0 or 1."""
    label = F.lower(F.trim(F.col("label").cast("string")))
    y = F.when(label.isin("0", "human"), 0).when(label.isin("1", "ai"), 1)
    n = F.length("text")
    problem = F.when(F.col("text").isNull() | (n < 1), "text").when(n > 200_000, "text too long").when(y.isNull(), "label")
    return df.withColumn("y", y).withColumn("problem", problem)


def replay(lines: list[str]) -> tuple[str, str] | None:
    """Text and its mask (P prompt, U user, A assistant, a letter per character) after the edits of a
    session; None if an event can't be read. A deletion leaves the position where it is."""
    text: list[str] = []
    mask: list[str] = []
    for line in lines:
        try:
            e = json.loads(line)
        except ValueError:
            return None
        if not isinstance(e, dict):
            return None
        doc = e.get("currentDoc")
        if e.get("eventName") == "system-initialize" and isinstance(doc, str):
            text, mask = list(doc), ["P"] * len(doc)
            continue
        delta = e.get("textDelta")
        if not isinstance(delta, dict):
            continue
        who, at = "A" if e.get("eventSource") == "api" else "U", 0
        for op in delta.get("ops") or []:
            if "retain" in op:
                at += int(op["retain"])
            elif isinstance(op.get("insert"), str):
                s = op["insert"]
                text[at:at] = list(s)
                mask[at:at] = [who] * len(s)
                at += len(s)
            elif "delete" in op:
                k = int(op["delete"])
                del text[at : at + k]
                del mask[at : at + k]
    return "".join(text), "".join(mask)


def replay_sessions(events: DataFrame, session: str = "session_id", order: str = "seq", line: str = "line") -> DataFrame:
    """``(session, text, human_chars, ai_chars, prompt_chars, ai_fraction)``; a session is the log of
    one writer, small enough for a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = replay(pdf.sort_values(order)[line].tolist())
        t, m = got if got else (None, "")
        u, a, p = m.count("U"), m.count("A"), m.count("P")
        return pd.DataFrame([{"session": str(pdf[session].iloc[0]), "text": t, "human_chars": u, "ai_chars": a, "prompt_chars": p, "ai_fraction": a / (a + u) if a + u else None}])

    return events.groupBy(session).applyInPandas(one, "session string, text string, human_chars int, ai_chars int, prompt_chars int, ai_fraction double")


def contributions(sessions: DataFrame, official: str = "written_by_human", least: int = 200) -> DataFrame:
    """``sessions`` (human_chars, ai_chars) with at least ``least`` authored characters, with the shares of
    both hands and the ``official`` human share out of 100 as a share."""
    n = F.col("human_chars") + F.col("ai_chars")
    return sessions.where(n >= least).withColumns({"ai_share": F.round(F.col("ai_chars") / n, 6), "human_share": F.col("human_chars") / n, "official_share": F.try_to_number(F.col(official).cast("string"), F.lit("999.99")).cast("double") / 100 if dict(sessions.dtypes)[official] == "string" else F.col(official) / 100.0})


def replay_agreement(shares: DataFrame) -> DataFrame:
    """``(n, pearson, mae)`` of the replayed human shares against the official ones that are given; without
    variance, or with two rows or fewer, the correlation is 0."""
    d = shares.where(F.col("official_share").isNotNull() & ~F.isnan("official_share"))
    return d.agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.coalesce(F.corr("human_share", "official_share"), F.lit(0.0))).otherwise(0.0).alias("pearson"), F.coalesce(F.avg(F.abs(F.col("human_share") - F.col("official_share"))), F.lit(0.0)).alias("mae"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
