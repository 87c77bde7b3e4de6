"""Evaluation cohorts: columnar files of texts with label, family, domain and group, filtered and sampled by
whole groups, and pools of several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import length_bucket, word_tokens
from textloom.operators.splits import cap_rows, exclude_groups, group_partitions, leakage_audit

COLUMNS = ("text", "label", "family", "domain", "group")


def as_cohort(df: DataFrame, most: int | None = None, seed: int = 13, kind: str = "text") -> DataFrame:
    """``df`` with the columns of a cohort, ``kind`` and length ``bucket``; where it has more rows than ``most``,
    a sample of whole groups. The filters of ``df`` reach its scan."""
    d = df.withColumns({c: F.col(c).cast("string") for c in ("family", "domain", "group")})
    return cap_rows(d, "group", most, seed).withColumns({"kind": F.lit(kind), "bucket": length_bucket(F.size(word_tokens(F.coalesce("text", F.lit("")))))})


def attack_cell(df: DataFrame, attack: str = "none", most: int | None = None, seed: int = 13) -> DataFrame:
    """Human rows, and machine rows under one ``attack``."""
    return as_cohort(df.where((F.col("family") == "human") | (F.col("attack") == attack)), most, seed)


def attacks(df: DataFrame) -> DataFrame:
    """``(attack)``: the attacks that rows have, in order."""
    return df.select("attack").where("attack is not null and attack not in ('', 'none')").distinct().orderBy("attack")


def versions(df: DataFrame, most: int | None = None, seed: int = 13) -> DataFrame:
    """A cohort whose families are versions of models; ``family_group`` stays."""
    return as_cohort(df, most, seed)


SESSION_SPLITS = ("train", "development", "calibration", "test")


def sessions(df: DataFrame, split: str = "test", most: int | None = None, seed: int = 13) -> DataFrame:
    """One author-disjoint split of writing sessions: all are mixed work, so the label is 1, and what
    counts is the share of the machine's characters."""
    if split not in SESSION_SPLITS:
        raise ValueError(f"no split {split!r}")
    d = df.where(F.col("split") == split).withColumns({"label": F.lit(1), "family": F.lit("mixed"), "domain": F.coalesce("prompt_code", F.lit("unknown"))})
    return as_cohort(d, most, seed)


def domains_and_modes(df: DataFrame, split: str, domains: tuple[str, ...] | None = None, modes: tuple[str, ...] | None = None, most: int | None = None, seed: int = 13) -> DataFrame:
    """Rows of an official split, of some domains and prompt modes if these are named."""
    d = df.where(F.col("official_split") == split)
    d = d.where(F.col("domain").isin(*domains)) if domains is not None else d
    d = d.where(F.col("prompt_mode").isin(*modes)) if modes is not None else d
    return as_cohort(d, most, seed)


def stories(splits: dict[str, DataFrame], families: dict[str, str] | None = None, groups: DataFrame | None = None, most: int | None = None, seed: int = 13) -> DataFrame:
    """Union of splits with ``official_split``, families renamed by a map, and the group from ``groups``
    (doc_id, cluster) where that is given: a story and its rewrites."""
    out = None
    for name, df in splits.items():
        d = df.withColumn("official_split", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    if families:
        table = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
        out = out.withColumn("family", F.coalesce(F.try_element_at(table, F.col("family")), F.col("family")))
    if groups is not None:
        out = out.drop("group").join(groups.select("doc_id", F.concat(F.lit("story-"), F.col("cluster").cast("string")).alias("group")), "doc_id", "left")
    if "domain" not in out.columns:
        out = out.withColumn("domain", F.lit("news"))
    return as_cohort(out, most, seed)


def official_leakage(cohort: DataFrame) -> DataFrame:
    """By official split but train: rows, and those whose group is in train, too."""
    return leakage_audit(cohort, F.col("group"), "official_split")


def concat_partitions(*parts: DataFrame) -> DataFrame:
    """Rows of partitions that belong to one pool: groups stay as they are."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pooled_partitions(official: dict[str, dict[str, DataFrame]], resplit: dict[str, DataFrame], train: int, calibration: int, test: int | None = None, seed: int = 13) -> DataFrame:
    """Pool with ``dataset`` and ``partition``, group-disjoint within each cohort.

    ``official`` cohorts come with their train, valid and test splits; calibration leaves out groups of
    train, and test those of both. ``resplit`` cohorts are cut anew by groups at the shares of the wanted
    rows. Each partition is held to the wanted number of rows by whole groups; groups are prefixed by
    the cohort's name, so that they stay apart.
    """
    test = calibration if test is None else test
    out = None

    def add(name, part, d):
        nonlocal out
        d = d.withColumns({"group": F.concat(F.lit(f"{name}:"), F.col("group")), "dataset": F.lit(name), "partition": F.lit(part)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)

    for name, splits in official.items():
        tr = cap_rows(splits["train"], "group", train, seed)
        cal = cap_rows(exclude_groups(cap_rows(splits["valid"], "group", calibration * 2, seed), "group", tr), "group", calibration, seed)
        te = cap_rows(exclude_groups(cap_rows(splits["test"], "group", test * 2, seed), "group", tr, cal), "group", test, seed)
        for part, d in (("train", tr), ("calibration", cal), ("test", te)):
            add(name, part, d)
    for name, df in resplit.items():
        pool = cap_rows(df, "group", train + calibration + test, seed)
        cut = group_partitions(pool, "group", {"train": train, "calibration": calibration, "test": test}, seed)
        d = pool.join(cut.withColumnRenamed("partition", "_part"), "group")
        for part in ("train", "calibration", "test"):
            add(name, part, d.where(F.col("_part") == part).drop("_part"))
    return out


def summarize(records: DataFrame, features: DataFrame | None = None, id_: str = "record_id", status: str = "watermark_status") -> DataFrame:
    """Per family and kind: records, runs, rows of each length bucket, the strongest watermark status and, if
    ``features`` has a row per record, mean, least and largest value of each feature."""
    from textloom.operators.corpus import contamination

    d = records.withColumn("_b", length_bucket(F.size(word_tokens(F.coalesce("text", F.lit(""))))))
    counts = [F.sum((F.col("_b") == b).cast("int")).alias(f"n_{n}") for b, n in (("lt50", "lt50"), ("50-149", "50_149"), ("150-499", "150_499"), ("500plus", "500plus"))]
    g = d.groupBy("family", "kind").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"), *counts)
    g = g.join(contamination(records, ["family", "kind"], status).drop("n"), ["family", "kind"])
    if features is None:
        return g
    names = [c for c, t in features.dtypes if t == "double"]
    f = records.select(id_, "family", "kind").join(features.select(id_, *names), id_).groupBy("family", "kind").agg(*(fn(c).alias(f"{c}_{n}") for c in names for n, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    return g.join(f, ["family", "kind"])
