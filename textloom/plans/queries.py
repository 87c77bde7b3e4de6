"""Queries over the project's tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import calibration, corpus, detectors, evidence, features, hypotheses, ledger, metrics, models, splits, statistics, transport, watermarks, windows
from textloom.plans.sql import SQL
from textloom.session import cut_lineage

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", *(columns or ("text",)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that two engines' sums agree."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def key(c) -> F.Column:
    k = F.lower(T.strip(c))
    return F.when(k != "", k)


#: Features that the models of these queries use.
X5 = ("long_words", "unique_ratio", "sentence_len_mean", "punctuation", "log_words")


def scored(spark, d) -> DataFrame:
    """Documents with a probability made of label and a hash of the id: y, p, and slices."""
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 6), 16, 10).cast("bigint") % 1000
    t = table(spark, d, "documents")
    return t.select("doc_id", F.col("label").alias("y"), F.round((h + 400 * F.col("label")) / 1400.0, 3).alias("p"), "kind", "family", "author", "source", F.coalesce("lang", F.lit("none")).alias("lang"))


@query
def kgw_detect(spark, d):
    return rounded(watermarks.kgw_counts(docs(spark, d)).drop("text"))


@query
def kgw_power(spark, d):
    """With p value and power, which need the normal distribution."""
    return rounded(watermarks.kgw_detect(docs(spark, d)).select("doc_id", "z", "p_value", "power"))


@query
def kgw_segments(spark, d):
    return rounded(watermarks.kgw_segments(docs(spark, d)))


@query
def kgw_screen(spark, d):
    """Share of rejections by label and kind, over tested documents."""
    return rounded(watermarks.screen(docs(spark, d, "text", "label", "kind"), ["label", "kind"]))


@query
def kgw_flags(spark, d):
    """The 50 documents with the highest z."""
    return rounded(watermarks.flagged(docs(spark, d)))


@query
def zero_width_roundtrip(spark, d):
    t = docs(spark, d).withColumn("text", watermarks.embed_zero_width(F.coalesce("text", F.lit(""))))
    return rounded(watermarks.zero_width(t).drop("text"))


@query
def zero_width_stripped(spark, d):
    t = docs(spark, d).withColumn("text", watermarks.strip_invisible(watermarks.embed_zero_width(F.coalesce("text", F.lit("")))))
    return watermarks.zero_width(t).groupBy("present").agg(F.count("*").alias("n"), F.sum("n_marks").alias("marks"))


@query
def attack_texts(spark, d):
    t = docs(spark, d)
    return t.select("doc_id", *(F.sha2(F.encode(watermarks.attack(F.coalesce("text", F.lit("")), a, F.col("doc_id")), "utf-8"), 256).alias(a) for a in ("drop_tokens", "lowercase", "strip_punctuation", "truncate")))


@query
def watermark_retention(spark, d):
    return rounded(watermarks.retention(docs(spark, d)))


@query
def bigram_counts(spark, d):
    return watermarks.bigram_student(docs(spark, d))[0].where("n >= 5")


@query
def bigram_nll(spark, d):
    t = docs(spark, d, "text", "label")
    return rounded(watermarks.knowledge_nll(t.where("label = 1"), t.where("label = 0")))


@query
def token_counts(spark, d):
    t = docs(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    n = F.size(T.word_tokens("text"))
    return t.select("doc_id", n.alias("n_words"), F.size(T.tokens("text")).alias("n_tokens"), T.length_bucket(n).alias("bucket"), T.content_hash("text").alias("content_hash"))


@query
def content_types(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", T.content_type(t).alias("content_type"), T.language(t).alias("language"))


@query
def segment_windows(spark, d):
    k = docs(spark, d).select("doc_id", F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("n"))
    s = k.select("doc_id", "n", F.posexplode(T.window_starts(F.col("n"), 160, 32)).alias("segment_no", "token_start"))
    return s.select("doc_id", "segment_no", "token_start", F.least(F.col("token_start") + 160, F.col("n")).alias("token_end"))


@query
def equal_thirds(spark, d):
    w = docs(spark, d).select("doc_id", windows.equal_parts(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != "")).alias("w"))
    return w.select("doc_id", *(F.size(F.get("w", i)).cast("bigint").alias(f"third_{i}") for i in range(3)))


@query
def plain_findings(spark, d):
    """How many documents' analyses say what, and with which limits."""
    a = detectors.analyze(docs(spark, d))
    q = ledger.watermark_tests(docs(spark, d), WATERMARK_KEYS).groupBy("doc_id").agg(F.min("q_value").alias("q"))
    x = a.join(q, "doc_id", "left")
    said = ledger.plain_language(F.col("state"), F.col("ai_generated") + F.col("ai_refined_or_mixed"), F.col("q"), F.lit("not_present"))
    limits = ledger.limitations(F.col("state"), F.col("content_type"), F.col("language"), F.col("n_tokens"), F.lit(False))
    return x.select(said.alias("finding"), F.size(limits).alias("limits")).groupBy("finding", "limits").agg(F.count("*").alias("n"))


@query
def run_manifests(spark, d):
    """A manifest per run as JSON, by its hash."""
    r = table(spark, d, "corpus_records").where("text is not null").dropDuplicates(["record_id"])
    return corpus.manifests(r, key("run_id"), F.col("record_id").cast("string")).select("run", F.get_json_object("manifest", "$.merkle_root").alias("merkle_root"), F.get_json_object("manifest", "$.n_outputs").cast("int").alias("n_outputs"))


@query
def resolved_watermarks(spark, d):
    """Watermark status of each provider's runs: as declared, or by provider and date."""
    since = {"mirelle": ("2026-03-01", "scheme-x"), "quince": ("2026-05-01", "scheme-y")}
    r = table(spark, d, "runs").select("provider", corpus.resolve_watermark(F.col("provider"), F.date_format("created_utc", "yyyy-MM-dd"), F.col("watermark_status"), since).alias("w"))
    return r.groupBy("provider", "w.status", "w.scheme").agg(F.count("*").alias("n"))


@query
def corpus_summary(spark, d):
    from textloom.sources.cohorts import summarize

    r = table(spark, d, "corpus_records").dropDuplicates(["record_id"])
    f = features.extract(r.select("record_id", "text", "kind")).drop("text", "kind")
    return rounded(summarize(r, f), 5)


@query
def joint_split_groups(spark, d):
    """Groups of near-duplicate records over all splits together that more than one split has."""
    r = table(spark, d, "corpus_records").where("split is not null and text is not null").dropDuplicates(["record_id"]).withColumnRenamed("record_id", "doc_id")
    g = splits.joint_groups({k: r.where(F.lower(F.trim("split")) == k) for k in ("train", "development", "calibration", "test")})
    return g.groupBy("group").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


@query
def segment_spans(spark, d):
    """Segments of prose with the offsets of their characters."""
    t = table(spark, d, "documents").where("coalesce(kind, 'text') <> 'code'")
    return windows.segments(t, kind=F.lit("prose")).drop("segment", "kind")


@query
def code_segments(spark, d):
    t = table(spark, d, "documents").where("kind = 'code'")
    return windows.segments(t, kind=F.lit("code")).withColumn("sha256", T.content_hash("segment")).drop("segment")


@query
def model_windows(spark, d):
    """Windows of 128 tokens that share 32, up to 32 of them, as a model takes them."""
    return windows.document_windows(docs(spark, d), budget=130, overlap=32)


@query
def segment_scores(spark, d):
    return rounded(ledger.score_segments(table(spark, d, "documents").select("doc_id", "text", "kind"), kind=F.when(F.col("kind") == "code", "code").otherwise("prose")).drop("human"))


@query
def segment_sources(spark, d):
    return rounded(ledger.source_by_segment(table(spark, d, "documents").select("doc_id", "text", "kind"), kind=F.when(F.col("kind") == "code", "code").otherwise("prose")))


@query
def segment_watermarks(spark, d):
    return rounded(ledger.watermark_by_segment(docs(spark, d)), 4)


@query
def contribution_waterfall(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "kind")
    return rounded(ledger.contribution_waterfall(ledger.score_segments(t, kind=F.when(F.col("kind") == "code", "code").otherwise("prose"))))


@query
def fixture_scores(spark, d):
    return rounded(ledger.fixture_score(docs(spark, d)).drop("text"))


WATERMARK_KEYS = {"scheme-a": watermarks.KEY, "scheme-b": "another-key", "scheme-c": "third-key"}


@query
def watermark_q_values(spark, d):
    return rounded(ledger.watermark_tests(docs(spark, d), WATERMARK_KEYS).select("doc_id", "scheme", "status", "z", "p_value", "q_value"), 5)


@query
def evidence_ledger(spark, d):
    """All entries of the documents' three channels."""
    t = docs(spark, d)
    provenance = t.select("doc_id", F.when(F.col("text").isNull(), "not_applicable").otherwise("not_present").alias("status"), F.lit(None).cast("string").alias("issuer"))
    return ledger.ledger(ledger.statistical_entries(detectors.analyze(t)), ledger.watermark_entries(ledger.watermark_tests(t, WATERMARK_KEYS)), ledger.provenance_entries(provenance))


@query
def evidence_summaries(spark, d):
    return ledger.summaries(evidence_ledger(spark, d)).groupBy("statistical", "watermark", "provenance").agg(F.count("*").alias("n"))


@query
def stylometry(spark, d):
    return rounded(features.extract(docs(spark, d, "text", "kind")).drop("text", "kind"))


@query
def stylometry_by_family(spark, d):
    f = features.extract(table(spark, d, "documents").select("text", "kind", "family"))
    return rounded(f.groupBy("family", "kind").agg(F.count("*").alias("n"), *(g(c).alias(f"{c}_{n}") for c in ("token_entropy", "unique_ratio", "sentence_len_mean") for n, g in (("mean", F.avg), ("min", F.min), ("max", F.max)))), 5)


@query
def prose_scores(spark, d):
    return rounded(detectors.prose_score(docs(spark, d)).drop("text"))


@query
def code_scores(spark, d):
    return rounded(detectors.code_score(table(spark, d, "documents").where("kind = 'code'").select("doc_id", "text")).drop("text"))


@query
def source_families(spark, d):
    return rounded(detectors.source_families(docs(spark, d, "text", "kind")).drop("text", "kind"))


@query
def analyze_documents(spark, d):
    return rounded(detectors.analyze(docs(spark, d)).drop("text"))


@query
def corpus_hygiene(spark, d):
    """Rows dropped and kept by the rules of each source."""
    t = docs(spark, d)
    parts = [corpus.hygiene_counts(corpus.hygiene(t, "doc_id", k)).withColumn("rules", F.lit(k)) for k in corpus.ERROR_MARKERS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query
def text_groups(spark, d):
    t = docs(spark, d)
    kept = corpus.hygiene(t, "doc_id", "m4gt").where("reason = 'keep'")
    return t.join(kept, "doc_id", "left_semi").select("doc_id", corpus.text_group(F.col("text")).alias("group"))


@query
def source_names(spark, d):
    """Domain, family, mode and paraphrase of source names made of the documents' columns."""
    n = F.element_at(F.array(F.concat_ws("_", "source", F.lit("machine"), "kind", "family"), F.concat("source", F.lit("_human")), F.concat("source", F.lit("_human_para")), F.concat_ws("_", "source", "family"), F.concat_ws("_", "source", "family", F.lit("para")), F.col("source")), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", n.alias("src")).select("doc_id", corpus.parse_source(F.col("src")).alias("p")).select("doc_id", "p.*")


@query
def version_pairs(spark, d):
    """Human and machine texts of a prompt, paired at the same place and exploded."""
    r = table(spark, d, "corpus_records").where("text is not null and label in (0, 1)").dropDuplicates(["record_id"]).select(key("prompt_id").alias("domain"), F.coalesce("cohort_id", F.lit("none")).alias("version"), "label", "text", "record_id").where("domain is not null")
    ordered = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("record_id", "text")))), lambda x: x["text"])
    g = r.groupBy("domain", "version").agg(ordered(0).alias("original"), ordered(1).alias("sampled"))
    return corpus.explode_pairs(g).select("domain", "version", "pair_no", "label", "family", "group", T.content_hash("text").alias("sha256"))


@query
def exact_copies(spark, d):
    return splits.exact_copies(docs(spark, d))


@query
def dataset_fingerprint(spark, d):
    return corpus.dataset_hash(table(spark, d, "documents"))


@query
def corpus_datasheet(spark, d):
    return corpus.datasheet(table(spark, d, "corpus_records").dropDuplicates(["record_id"]))


@query
def contamination_status(spark, d):
    return corpus.contamination(table(spark, d, "corpus_records").dropDuplicates(["record_id"]), ["family", "kind"])


@query
def run_merkle_roots(spark, d):
    r = table(spark, d, "corpus_records").where("text is not null").dropDuplicates(["record_id"])
    return corpus.run_roots(r, key("run_id"))


@query
def run_registry(spark, d):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return corpus.first_submissions(table(spark, d, "runs"), key("run_id")).select("run", "submissions", "model_slug", "provider", at("created_utc"), at("submitted_utc"))


@query
def catalog_problems(spark, d):
    return corpus.catalog_check(table(spark, d, "corpus_records"), table(spark, d, "runs"), key)


@query
def stale_hashes(spark, d):
    """Records whose stored hash is absent or not that of their text."""
    r = table(spark, d, "corpus_records").where("text is not null").dropDuplicates(["record_id"])
    ok = F.coalesce(F.lower(F.trim("sha256")) == T.content_hash("text"), F.lit(False))
    return r.where(~ok).select("record_id", F.col("sha256").isNull().alias("absent"))


@query
def output_counts(spark, d):
    """Runs whose registered number of outputs is not that of their records."""
    n = table(spark, d, "corpus_records").select("record_id", key("run_id").alias("run")).where("run is not null").distinct().groupBy("run").agg(F.count("*").alias("found"))
    r = table(spark, d, "runs").select(key("run_id").alias("run"), "n_outputs").where("run is not null").groupBy("run").agg(F.max("n_outputs").alias("registered"))
    return r.join(n, "run").where("registered <> found")


@query
def near_duplicates(spark, d):
    return splits.near_duplicate_clusters(docs(spark, d)).groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")


@query
def near_duplicates_measured(spark, d):
    """Clusters over links of runs of five words with a measured similarity of at least 0.8."""
    return splits.near_duplicate_clusters(docs(spark, d), words=5, similarity=0.8).groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")


@query
def cluster_sizes(spark, d):
    return rounded(splits.cluster_stats(splits.near_duplicate_clusters(docs(spark, d))))


@query
def minhash_signatures(spark, d):
    return splits.minhash(docs(spark, d))


@query
def author_copies_jaccard(spark, d):
    """Exact similarity of each document and the one before it in the same source."""
    from pyspark.sql import Window as W

    t = table(spark, d, "documents").select("doc_id", "text", "source")
    pairs = t.select("source", "doc_id").withColumn("a", F.lag("doc_id").over(W.partitionBy("source").orderBy("doc_id"))).where("a is not null").select("a", F.col("doc_id").alias("b"))
    return rounded(splits.jaccard(pairs, t))


@query
def group_subsample(spark, d):
    return splits.group_subsample(table(spark, d, "documents").select("doc_id", "author"), "author", 300)


@query
def group_partitions(spark, d):
    return splits.group_partitions(table(spark, d, "documents"), "author", {"train": 0.6, "calibration": 0.2, "test": 0.2})


# The writers' splits and their seed.
WRITER_SHARES = {"train": 4000, "development": 1500, "calibration": 1500, "test": 3000}


@query
def writer_splits(spark, d):
    s = splits.hash_split(F.col("author"), "20260819:", WRITER_SHARES)
    return table(spark, d, "documents").select("author", s.alias("partition")).where("author is not null").distinct()


@query
def split_leaks(spark, d):
    """Runs whose records stand in more than one split."""
    r = table(spark, d, "corpus_records").select(key("run_id").alias("run"), F.lower(F.trim("split")).alias("partition")).where("run is not null and partition is not null")
    return splits.leaks(r, "run")


@query
def leakage_by_prompt(spark, d):
    r = table(spark, d, "corpus_records").select("record_id", "split", "prompt_id").distinct()
    return splits.leakage_audit(r, key("prompt_id"))


@query
def balanced_folds(spark, d):
    return splits.grouped_folds(table(spark, d, "documents"), "author")


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "corpus_records").select("record_id", "prompt_id", "kind", "label").distinct()


@query
def author_majorities(spark, d):
    return splits.majority_labels(table(spark, d, "documents"), "author")


@query
def author_holdout(spark, d):
    return splits.holdout(table(spark, d, "documents"), "author")


@query
def nested_author_folds(spark, d):
    return splits.nested_folds(table(spark, d, "documents"), "author")


@query
def protocol_partitions(spark, d):
    """Authors are enough for one holdout, families only for nested folds."""
    t = table(spark, d, "documents")
    return splits.protocol_splits(t, "author").withColumn("unit", F.lit("author")).union(splits.protocol_splits(t, "family").withColumn("unit", F.lit("family")))


@query
def stratified_authors(spark, d):
    return splits.stratified_subsample(table(spark, d, "documents").select("doc_id", "author", "source", "label"), "author", ["source", "label"], 400)


@query
def story_groups(spark, d):
    """Texts and their rewrites: TF-IDF cosine of at least 0.45, carried on."""
    return splits.story_groups(docs(spark, d)).groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")


@query
def prompt_pairs(spark, d):
    """Pairs in which every row of a prompt and kind with both labels stands."""
    return evidence.prompt_pairs(labelled(spark, d), key("prompt_id"))


@query
def prompt_pair_groups(spark, d):
    """How many pairs the rows of each prompt and kind form: its human rows with its other rows."""
    return evidence.pair_groups(labelled(spark, d), key("prompt_id"))


@query
def metrics_by_kind(spark, d):
    return rounded(metrics.binary_metrics(scored(spark, d), ["kind"]))


@query
def metrics_overall(spark, d):
    return rounded(metrics.binary_metrics(scored(spark, d), []))


@query
def reliability_bins(spark, d):
    return rounded(metrics.reliability(scored(spark, d), []))


@query
def adaptive_calibration(spark, d):
    return rounded(metrics.adaptive_error(scored(spark, d)))


@query
def worst_language(spark, d):
    return rounded(metrics.worst_groups(scored(spark, d), "lang"))


@query
def fairness_slices(spark, d):
    return rounded(metrics.slices(scored(spark, d), ["kind", "family", "lang"]))


@query
def coverage_curve(spark, d):
    return rounded(metrics.coverage_curve(scored(spark, d)))


@query
def conformal_sets(spark, d):
    return rounded(metrics.conformal(scored(spark, d)))


@query
def selective_risk(spark, d):
    return rounded(metrics.selective_risk(scored(spark, d)))


@query
def prevalence_metrics(spark, d):
    return rounded(metrics.prevalence_metrics(scored(spark, d)))


@query
def bootstrap_by_author(spark, d):
    return rounded(metrics.group_bootstrap(scored(spark, d), "author"))


@query
def bootstrap_intervals(spark, d):
    return rounded(metrics.group_bootstrap_ci(scored(spark, d), "author"))


@query
def paired_scores(spark, d):
    """Difference of two scores on the same resampled authors."""
    return rounded(metrics.paired_bootstrap(two_scores(spark, d), "author", "p", "q"))


@query
def sliced_conformal(spark, d):
    return rounded(metrics.sliced_conformal(scored(spark, d), ["kind", "family", "lang"]))


def partitioned(spark, d) -> DataFrame:
    """The scored documents in four partitions by a hash of their id."""
    s = splits.hash_split(F.col("doc_id").cast("string"), "partition:", WRITER_SHARES)
    return scored(spark, d).withColumn("partition", s)


def parts(spark, d) -> tuple[DataFrame, DataFrame]:
    t = partitioned(spark, d)
    return t.where("partition = 'calibration'"), t.where("partition = 'test'")


@query
def conformal_fit(spark, d):
    c = parts(spark, d)[0]
    return rounded(calibration.fit_conformal(c).withColumn("method", F.lit("mondrian")).union(calibration.fit_conformal(c, mondrian=False).withColumn("method", F.lit("pooled"))))


@query
def conformal_applied(spark, d):
    c, t = parts(spark, d)
    return rounded(calibration.apply_conformal(t, calibration.fit_conformal(c)))


@query
def fpr_thresholds(spark, d):
    c, t = parts(spark, d)
    return rounded(calibration.tpr_at_thresholds(t, calibration.fit_fpr_thresholds(c)))


@query
def selective_thresholds(spark, d):
    c, t = parts(spark, d)
    return rounded(calibration.apply_selective_thresholds(t, calibration.fit_selective_thresholds(c)))


@query
def operating_points(spark, d):
    return rounded(calibration.operating_report(*parts(spark, d)))


@query
def calibration_slope(spark, d):
    r = calibration.slope_intercept(scored(spark, d))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in r.items()], "term string, value double")


@query
def calibration_bundle(spark, d):
    """The test documents' scores under a bundle fitted on the calibration documents."""
    c, t = parts(spark, d)
    name = {"detector_id": "demo", "model_revision": "1", "task": "document", "cohort": "documents"}
    b = calibration.fit_bundle(c, **name)
    return rounded(t.select("doc_id", b.calibrate(F.col("p"), **name).alias("calibrated")), 4)


@query
def selected_detector(spark, d):
    return rounded(calibration.fit_select_calibrate_test({"a": "p", "b": "q"}, two_scores(spark, d).withColumn("partition", splits.hash_split(F.col("doc_id").cast("string"), "partition:", WRITER_SHARES))), 4)


@query
def cohort_cells(spark, d):
    """Metrics of each crossing of language and family with both classes."""
    t = scored(spark, d).withColumn("cohort", transport.cohort_key("domain_generator", "lang", "kind"))
    return rounded(transport.cell_metrics(t, "cohort"))


@query
def calibration_transfers(spark, d):
    """Isotonic maps of one language's documents applied to all languages'."""
    return rounded(transport.calibration_transfer(*parts(spark, d), "lang"), 4)


@query
def transfer_summary(spark, d):
    return rounded(transport.transfer_summary(transport.calibration_transfer(*parts(spark, d), "lang")), 4)


@query
def balanced_view(spark, d):
    return rounded(transport.source_balanced(scored(spark, d), "author"), 4)


def fit_logistic(names=X5, y="y"):
    """What fits a logistic model on training rows and returns what scores others."""

    def fit(train):
        model = evidence.train_logistic(train, list(names), y)
        from pyspark.ml.functions import vector_to_array

        return lambda rows: model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("probability", "predicted", "_raw", "_x", "_z")

    return fit


def featured(spark, d) -> DataFrame:
    t = features.extract(table(spark, d, "documents").where("author is not null").select("doc_id", "text", "kind", "label", "author", "source", "family", "lang")).drop("text")
    return cut_lineage(t.withColumnsRenamed({"label": "y", "author": "group", "source": "domain"}))


@query
def held_out_sources(spark, d):
    """Each source held out of training and calibration: its metrics and those of the others' test rows."""
    return transport.cohort_transport(featured(spark, d), "domain", fit_logistic())


@query
def seen_sources(spark, d):
    return transport.pooled_generalization(featured(spark, d), "domain", fit_logistic())


@query
def source_transport(spark, d):
    return transport.transport_matrix(featured(spark, d), "kind", fit_logistic())


@query
def cross_validated(spark, d):
    return models.cross_validate(featured(spark, d), "group", fit_logistic())


@query
def protocol_metrics(spark, d):
    return models.evaluate_protocol(featured(spark, d), "group", fit_logistic())[0]


@query
def protocol_operating_points(spark, d):
    return models.evaluate_protocol(featured(spark, d), "group", fit_logistic())[1]


@query
def auroc_interval(spark, d):
    return rounded(models.auroc_interval(scored(spark, d)))


@query
def family_attribution(spark, d):
    """Families told from features, out of fold: precision, recall and F1."""
    return models.f1_report(models.attribution_cv(featured(spark, d).where("family is not null"), "group", list(X5)))


@query
def source_origin(spark, d):
    return models.origin_probe(featured(spark, d), "group", list(X5), "domain")


@query
def unseen_families(spark, d):
    """How far each held-out family is from the others, against how far these are from themselves."""
    return rounded(models.leave_one_family_out(featured(spark, d), list(X5)), 4)


@query
def part_dependence(spark, d):
    """Evidence of a text's thirds summed, shrunk, and that of the whole text."""
    t = table(spark, d, "documents").where("kind = 'text'").select("doc_id", "text")
    s = hypotheses.part_scores(t, 3, 36).withColumnRenamed("part_no", "segment_no")
    whole = detectors.prose_score(t.join(s.select("doc_id").distinct(), "doc_id", "left_semi")).withColumnRenamed("raw_score", "p")
    return rounded(models.dependence_summary(models.compare_dependence(s, whole)))


@query
def hypothesis_battery(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "kind", "label", "family")
    f = cut_lineage(features.extract(t))
    rows = [(r["id"], r["test"], None if r["statistic"] is None else round(float(r["statistic"]), 5), round(float(r["p_value"]), 5), round(float(r["q_value"]), 5), r["decision"]) for r in hypotheses.run_battery(f, permutations=19)]
    return spark.createDataFrame(rows, "id string, test string, statistic double, p_value double, q_value double, decision string")


@query
def score_comparison(spark, d):
    r = hypotheses.comparison_battery(two_scores(spark, d), "y", "p", "q")
    return spark.createDataFrame([(k, round(float(v), 5)) for k, v in r.items()], "term string, value double")


@query
def robustness(spark, d):
    """The prose score's metrics under edits of the texts."""
    score = lambda t: detectors.prose_score(t).withColumn("p", F.col("raw_score"))
    return rounded(watermarks.robustness_curve(table(spark, d, "documents"), score))


@query
def watermark_degradation(spark, d):
    return rounded(watermarks.degradation(docs(spark, d)))


@query
def green_bias(spark, d):
    return rounded(watermarks.green_bias(watermarks.bigram_student(docs(spark, d))[0]))


@query
def scrubbed_texts(spark, d):
    t = F.translate(F.coalesce("text", F.lit("")), "aeopcxyhkmtb", "".join(list(watermarks.HOMOGLYPHS)[:12]))
    return docs(spark, d).select("doc_id", T.content_hash(watermarks.unicode_scrub(watermarks.embed_zero_width(t))).alias("sha256"))


@query
def synonym_texts(spark, d):
    return docs(spark, d).select("doc_id", T.content_hash(watermarks.synonyms(F.coalesce("text", F.lit("")), 0.3, F.col("doc_id"))).alias("sha256"))


@query
def welch_test_prices(spark, d):
    r = statistics.welch_test(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return spark.createDataFrame([(k, round(float(v), 5)) for k, v in r.items()], "term string, value double")


@query
def pseudo_r2(spark, d):
    return rounded(statistics.pseudo_r2(scored(spark, d), "y", "p"))


@query
def calibration_power(spark, d):
    return rounded(statistics.calibration_power(scored(spark, d)))


@query
def event_order_test(spark, d):
    """Durbin-Watson over each user's events and orders of them."""
    return rounded(statistics.durbin_watson_permutation(table(spark, d, "events"), "value", "user_id", ["ts", "event_id"], 49))


@query
def transport_cells(spark, d):
    return rounded(evidence.transport_cells(scored(spark, d), "lang"))


@query
def prior_grid(spark, d):
    return rounded(evidence.prior_sensitivity(scored(spark, d), "p"))


@query
def segment_dependence(spark, d):
    """Evidence of the watermark test's segments, taken as if independent and shrunk."""
    s = watermarks.kgw_segments(docs(spark, d)).where("z is not null").withColumn("p", F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("green") / F.col("n_tokens"))))
    return rounded(evidence.accumulate(s, "p"))


@query
def overlap_corrected_odds(spark, d):
    s = watermarks.kgw_segments(docs(spark, d)).where("n_tokens >= 20").withColumn("p", F.col("green") / F.col("n_tokens"))
    return rounded(evidence.overlap_corrected(s.withColumn("s", F.col("segment_no") * 128).withColumn("e", F.col("segment_no") * 128 + F.col("n_tokens")), "p", "s", "e"))


def pair_words(spark, d) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "corpus_records").where("text is not null and kind = 'text'").select("record_id", "prompt_id", "kind", "label", "text").dropDuplicates(["record_id"])
    return evidence.prompt_pairs(r, key("prompt_id")), r.select("record_id", T.word_tokens("text").alias("w"))


@query
def mixture_curves(spark, d):
    """Scores of prompt pairs' texts mixed at seven rates in three ways."""
    p, w = pair_words(spark, d)
    out = None
    for flow in evidence.WORKFLOWS:
        c = evidence.mixture_curve(p, w, lambda m: detectors.prose_score(m).withColumn("score", F.col("raw_score")), flow).withColumn("workflow", F.lit(flow))
        out = c if out is None else out.union(c)
    return rounded(out)


@query
def mixture_tracking(spark, d):
    p, w = pair_words(spark, d)
    return rounded(evidence.tracking(evidence.mixture_curve(p, w, lambda m: detectors.prose_score(m).withColumn("score", F.col("raw_score")))), 4)


@query
def family_geometry(spark, d):
    return rounded(evidence.nearest_family(table(spark, d, "embeddings"), "embedding", "label"), 4)


@query
def group_weighting(spark, d):
    return rounded(evidence.group_weights(table(spark, d, "documents").where("author is not null").select("doc_id", "author"), "author"))


@query
def welch_prices(spark, d):
    return rounded(statistics.welch(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", ["l_linestatus"]))


@query
def mann_whitney_quantity(spark, d):
    return rounded(statistics.mann_whitney(table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "R"))


@query
def fdr_by_brand(spark, d):
    """Two-sided z of each brand's share of returned items against all, and its place in the family."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    g = li.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("k"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    x = g.crossJoin(F.broadcast(t)).withColumn("p0", F.col("tk") / F.col("tn"))
    z = (F.col("k") / F.col("n") - F.col("p0")) / F.sqrt(F.col("p0") * (1 - F.col("p0")) / F.col("n"))
    # A bound of the tail that both engines have: exp(-z^2 / 2).
    return rounded(statistics.benjamini_hochberg(x.select("p_brand", z.alias("z"), F.exp(-z * z / 2).alias("bound")), "bound"))


@query
def mcnemar_counts(spark, d):
    s = scored(spark, d)
    return rounded(statistics.mcnemar(s, (F.col("p") >= 0.5).cast("int") == F.col("y"), (F.col("p") >= 0.6).cast("int") == F.col("y")))


@query
def durbin_watson_prices(spark, d):
    return rounded(statistics.durbin_watson(table(spark, d, "lineitem"), "l_extendedprice", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]))


@query
def jarque_bera_prices(spark, d):
    return rounded(statistics.jarque_bera(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 3)


@query
def feature_correlations(spark, d):
    x = list(X5)
    c = statistics.correlations(cut_lineage(features.extract(docs(spark, d, "text", "kind")).select(*x)), x)
    return spark.createDataFrame([(a, b, round(float(c[i, j]), 5)) for i, a in enumerate(x) for j, b in enumerate(x) if i < j], "a string, b string, r double")


@query
def regression_tests(spark, d):
    """Whether diversity tells more than length, whether powers of the fit do, and the spread of the residuals."""
    f = cut_lineage(features.extract(table(spark, d, "documents").select("text", "kind", "label")).select("label", *X5))
    x = ["log_words", "unique_ratio"]
    rows = [("likelihood_ratio", statistics.likelihood_ratio_test(f, x, ["log_words"], "label")), ("link", statistics.link_test(f, x, "label")), ("reset", statistics.link_test(f, x, "label", 3)), ("breusch_pagan", statistics.breusch_pagan(f, x, "label"))]
    return spark.createDataFrame([(n, round(float(r.get("statistic", r.get("lm"))), 4), int(r["df"]), round(float(r["p_value"]), 4)) for n, r in rows], "test string, statistic double, df int, p_value double")


@query
def influential_documents(spark, d):
    """The ten documents that move the logistic fit most."""
    f = cut_lineage(features.extract(table(spark, d, "documents").select("doc_id", "text", "kind", "label")).select("doc_id", "label", *X5))
    return rounded(statistics.cooks_distance(f, ["log_words", "unique_ratio"], "label").select("doc_id", "leverage", "cooks_d").orderBy(F.desc("cooks_d"), "doc_id").limit(10), 5)


@query
def family_separation(spark, d):
    f = cut_lineage(features.extract(table(spark, d, "documents").where("kind = 'text' and family is not null").select("text", "kind", "family")).select("family", *X5))
    return spark.createDataFrame([(round(statistics.wilks_lambda(f, ["unique_ratio", "long_words", "punctuation"], "family"), 5),)], "wilks_lambda double")


@query
def hosmer_lemeshow(spark, d):
    return rounded(statistics.hosmer_lemeshow(scored(spark, d), "y", "p"), 4)


@query
def hourly_events(spark, d):
    """Sliding windows over the event stream's rows: the batch form of the streaming operator."""
    from textloom.streaming.events import windowed_counts

    w = windowed_counts(table(spark, d, "events"), None)
    return rounded(w.select(F.col("window.start").cast("string").alias("window_start"), "event_type", "n", "value"), 4)


@query
def first_events(spark, d):
    from textloom.streaming.events import first_of_key

    return first_of_key(table(spark, d, "events"), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("users"))


@query
def logistic_coefficients(spark, d):
    """Logistic regression of the label on five features, by Newton steps."""
    x = ["long_words", "unique_ratio", "sentence_len_mean", "punctuation", "log_words"]
    f = cut_lineage(features.extract(table(spark, d, "documents").select("text", "kind", "label")).select("label", *x))
    b = statistics.irls(f, x, "label")["beta"]
    return spark.createDataFrame([(n, round(float(v), 4)) for n, v in zip(["intercept", *x], b)], "term string, beta double")


@query
def feature_inflation(spark, d):
    x = ["long_words", "unique_ratio", "sentence_len_mean", "mean_word_length", "word_length_var", "token_entropy", "log_words"]
    v = statistics.vif(cut_lineage(features.extract(docs(spark, d, "text", "kind")).select(*x)), x)
    return spark.createDataFrame([(k, round(a, 3)) for k, a in v.items()], "feature string, inflation double")


def two_scores(spark, d) -> DataFrame:
    return scored(spark, d).withColumn("q", F.round((F.col("p") + (F.col("doc_id") % 7) / 10.0) / 1.6, 6))


@query
def delong_scores(spark, d):
    r = statistics.delong(two_scores(spark, d), "y", "p", "q")
    return spark.createDataFrame([tuple(round(v, 6) for v in r.values())], ", ".join(f"{k} double" for k in r))


@query
def isotonic_calibration(spark, d):
    s = scored(spark, d)
    return rounded(s.select("doc_id", calibration.interpolate(F.col("p"), calibration.isotonic_knots(s)).alias("calibrated")), 4)
