
import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, ledger, transport, watermarks, windows
from textloom.sources import cohorts, io

CODE = "import os\n\ndef f(x):\n    return x + 1\n\nclass A:\n    pass\n\nconst y = 2;\n"


def test_code_segments_by_hand():
    """Blocks of six tokens: two fill a window of 12; the third, which would overfill it, lends it its end, and
    its tokens are the next window's."""
    t = "\ndef a(): pass" * 3
    spans = [m.span() for m in windows.TOKEN.finditer(t)]
    cuts = windows.code_boundaries(t)
    assert cuts == [0, 15, 29, 42]
    assert windows.code_windows(spans, cuts, 12) == [(0, 42, 12), (42, 42, 6)]
    assert windows.code_windows(spans, cuts, 18) == [(0, 42, 18)] and windows.code_windows([], [0, 0]) == [(0, 0, 0)]


def test_segments_and_windows(spark):
    texts = ["word " * 400, "", None, "one", CODE * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = windows.segments(df).collect()
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["segment"]
    assert {r["doc_id"] for r in rows} == {0, 3, 4} and [r["n_tokens"] for r in sorted(rows, key=lambda r: r["segment_no"]) if r["doc_id"] == 0] == [160, 160, 144]
    assert {r["kind"] for r in rows if r["doc_id"] == 4} == {"code"}
    w = windows.document_windows(df, budget=66, overlap=16, most=3).collect()
    assert [(x["token_start"], x["token_end"]) for x in w if x["doc_id"] == 0] == [(0, 64), (48, 112), (96, 160)] and not any(x["covered"] for x in w if x["doc_id"] == 0)
    assert [(x["token_start"], x["token_end"], x["char_end"]) for x in w if x["doc_id"] in (1, 2)] == [(0, 0, 0)] * 2
    assert max(x["token_end"] for x in windows.document_windows(df, budget=66, overlap=16, most=None).collect() if x["doc_id"] == 0) == 400
    p = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>").select(windows.pad(F.col("ids"), 5, 9).alias("p")).collect()
    assert p[0]["p"]["input_ids"] == [1, 2, 3, 9, 9] and p[0]["p"]["attention_mask"] == [1, 1, 1, 0, 0] and p[1]["p"]["attention_mask"] == [0] * 5
    b = windows.contiguous_batches([5, 100, 7, 30, 31], 64)
    assert sorted(i for x in b for i in x) == list(range(5)) and all(max([5, 100, 7, 30, 31][i] for i in x) * len(x) <= 64 or len(x) == 1 for x in b)


def test_negative_test_is_no_human_evidence(spark):
    tests = spark.createDataFrame([(1, "s", "tested", 0.001), (2, "s", "tested", 0.8), (3, "s", "insufficient_data", None), (4, "s", "error", None)], "doc_id int, scheme string, status string, q_value double")
    e = {r["doc_id"]: r for r in ledger.watermark_entries(tests).collect()}
    assert e[1]["validity"] == "valid" and e[1]["strength"] == 0.999 and e[2]["claim"] == "watermark_present" and e[3]["validity"] == "not_applicable" and e[3]["strength"] is None and e[4]["validity"] == "unknown"
    a = spark.createDataFrame([(1, "supported", None), (2, "insufficient_data", None), (3, "out_of_distribution", None), (4, "supported", "language")], "doc_id int, state string, why string")
    assert [r["validity"] for r in ledger.statistical_entries(a, abstain="why").orderBy("doc_id").collect()] == ["unknown", "not_applicable", "weakened", "weakened"]
    p = spark.createDataFrame([(1, "verified", "x"), (2, "tampered", None), (3, "not_present", None)], "doc_id int, status string, issuer string")
    got = ledger.provenance_entries(p)
    assert [r["validity"] for r in got.orderBy("doc_id").collect()] == ["valid", "invalid", "not_applicable"] and got.where("strength is not null").count() == 0
    s = {r["doc_id"]: r for r in ledger.summaries(ledger.ledger(ledger.statistical_entries(a), ledger.watermark_entries(tests), got)).collect()}
    assert (s[1]["watermark"], s[1]["provenance"], s[2]["watermark"], s[2]["statistical"], s[3]["watermark"]) == ("significant", "verified", "not significant", "limited", "not tested")


def test_q_values_within_a_document(spark):
    d = spark.createDataFrame([(1, "word other thing " * 60), (2, "short")], "doc_id int, text string")
    keys = {"a": "k1", "b": "k2", "c": "k3"}
    rows = {r["scheme"]: r for r in ledger.watermark_tests(d, keys).where("doc_id = 1").collect()}
    ps = sorted((r["p_value"], k) for k, r in rows.items())
    for rank, (p, k) in enumerate(ps, 1):
        assert abs(rows[k]["q_value"] - min(min(3 * q / j for j, (q, _) in enumerate(ps, 1) if j >= rank), 1.0)) < 1e-9
    assert {r["status"] for r in ledger.watermark_tests(d, keys).where("doc_id = 2").collect()} == {"insufficient_data"}


def test_flags(spark):
    df = spark.createDataFrame([([0.1, 0.9], [0.5], 0.95), ([0.5], [0.0, 1.0], 0.5)], "s array<double>, w array<double>, r double")
    got = [r[0] for r in df.select(ledger.applicability(F.col("s"), F.col("w"), F.col("r"), 0.1, 0.9)).collect()]
    assert got[0]["flags"] == ["out_of_calibration_range", "ensemble_disagreement"] and got[0]["seed_std"] == 0.4 and got[1]["flags"] == ["segment_disagreement"]


def test_transport(spark):
    rows = [(f"g{i % 50}", ["a", "b", "c"][i % 3], int((i * 7) % 10 < 4 + (i % 3)), (i * 7 % 10) / 10) for i in range(600)]
    df = spark.createDataFrame([(g, c, y, p, 1 - p) for g, c, y, p in rows], "group string, domain string, y int, p double, x double")
    assert [r[0] for r in df.select(transport.cohort_key("domain_generator", "domain", "group")).limit(1).collect()] == ["a|g0"]
    with pytest.raises(ValueError):
        transport.cohort_key("nowhere")
    cells = {r["domain"]: r for r in transport.cell_metrics(df, "domain").collect()}
    assert set(cells) == {"a", "b", "c"} and all(c["n"] == 200 for c in cells.values())
    assert transport.evaluable(df.where("y = 1"), "domain", 5).count() == 0
    t = transport.calibration_transfer(df.where("group < 'g3'"), df.where("group >= 'g3'"), "domain", 10)
    m = {(r["source"], r["target"]): r for r in t.collect()}
    assert len(m) == 9 and all(r["on_diagonal"] == (a == b) for (a, b), r in m.items())
    assert transport.transfer_summary(t).first()["n_source_cohorts"] == 3
    fit = lambda train: lambda rows: rows.withColumn("p", F.col("p"))
    out = {(r["domain"], r["part"]): r for r in transport.cohort_transport(df, "domain", fit).collect()}
    assert set(out) == {(c, k) for c in "abc" for k in ("target", "diagonal")} and out["a", "target"]["n"] == 200
    grid = {(r["train"], r["test"]): r["n_train"] for r in transport.transport_matrix(df, "domain", fit).collect()}
    assert set(grid) <= {(a, b) for a in "abc" for b in "abc"} and all(a == b for a, b in grid)  # other cells share all groups


def test_cohorts(spark):
    rows = [(f"text {i}", int(i % 2), "human" if i % 2 == 0 else "m", "d", f"g{i // 4}", ["none", "typo"][i // 2 % 2], ["train", "valid", "test"][i % 3], "cont") for i in range(48)]
    df = spark.createDataFrame(rows, "text string, label int, family string, domain string, group string, attack string, official_split string, prompt_mode string")
    assert cohorts.attack_cell(df, "typo").where("label = 1 and attack <> 'typo'").count() == 0 and [r[0] for r in cohorts.attacks(df).collect()] == ["typo"]
    assert cohorts.domains_and_modes(df, "train", ("d",), ("cont",)).count() == 16 and cohorts.domains_and_modes(df, "train", ("x",)).count() == 0
    assert cohorts.as_cohort(df, 8).count() == 8 and {"kind", "bucket"} <= set(cohorts.as_cohort(df).columns)
    s = cohorts.stories({"train": df.limit(4), "test": df.limit(2)}, {"m": "model"})
    assert s.count() == 6 and "model" in {r["family"] for r in s.collect()} and cohorts.official_leakage(s).first()["leaked"] == 2
    with pytest.raises(ValueError):
        cohorts.sessions(df, "nowhere")
    parts = {k: df.where(F.col("official_split") == k) for k in ("train", "valid", "test")}
    pool = cohorts.pooled_partitions({"one": parts}, {"two": df}, 12, 8)
    assert pool.groupBy("group").agg(F.countDistinct("partition").alias("n")).where("n > 1").count() == 0
    assert {r["dataset"] for r in pool.select("dataset").distinct().collect()} <= {"one", "two"}
    assert cohorts.concat_partitions(df.limit(3), df.limit(2)).count() == 5


def test_source_names_and_pairs(spark):
    want = {"xsum_machine_continuation_gpt_j": ("xsum", "gpt_j", "continuation", False), "cmv_human": ("cmv", "human", "human", False), "cmv_human_para": ("cmv", "paraphrased_human", "paraphrase", True), "dialogsum_gpt4": ("dialogsum", "gpt4", "ood", False), "imdb_gpt4_para": ("imdb", "gpt4", "paraphrase", True), "alone": ("alone", "unknown", "ood", False), "a_machine_": ("a", "unknown", "unknown", False)}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert {r["s"]: tuple(r["p"]) for r in df.select("s", corpus.parse_source(F.col("s")).alias("p")).collect()} == want
    x = spark.createDataFrame([("d", "v1", ["h1", "h2", "h3"], ["a1", None]), ("d", "v2", None, ["a"]), ("e", "v1", [], [])], "domain string, version string, original array<string>, sampled array<string>")
    rows = corpus.explode_pairs(x).collect()
    assert [(r["pair_no"], r["text"], r["label"], r["family"]) for r in rows] == [(0, "h1", 0, "human"), (0, "a1", 1, "v1"), (1, "h2", 0, "human"), (1, "", 1, "v1")] and len({r["group"] for r in rows}) == 2


def test_contributions(spark):
    df = spark.createDataFrame([("a", 150, 50, 75.0), ("b", 100, 300, 25.0), ("c", 10, 10, 50.0), ("d", 300, 100, None)], "session string, human_chars int, ai_chars int, written_by_human double")
    c = corpus.contributions(df)
    assert {r["session"]: r["ai_share"] for r in c.collect()} == {"a": 0.25, "b": 0.75, "d": 0.25}
    a = corpus.replay_agreement(c).first()
    assert a["n"] == 2 and a["pearson"] == 0.0 and a["mae"] == 0.0


def test_attacks_keep_what_they_say(spark):
    t = "The bіg old harbour said nothing, but they have new boats."
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "doc_id int, text string")
    got = {(r["doc_id"], r["attack"]): r["text"] for r in watermarks.attacked(df, watermarks.ATTACKS).collect()}
    assert got[1, "none"] == t and got[1, "unicode_scrub"] == t and len(got) == 3 * len(watermarks.ATTACKS) and got[3, "synonym_60"] == ""
    full = df.select(watermarks.synonyms(F.col("text"), 1.1, F.col("doc_id"))).first()[0]
    assert full == "The bіg ancient harbour stated nothing, however these possess recent boats."
    assert df.select(watermarks.unicode_scrub(F.lit("саn‌ it"))).first()[0] == "can it"


def test_synthetic_watermarks(spark):
    words = [f"w{i}" for i in range(40)]
    g = {r["bias"]: r for r in watermarks.synthetic_sweep(spark, (0.0, 3.0), 12, 80, words).collect()}
    assert g[3.0]["mean_z"] > 5 > 2 > abs(g[0.0]["mean_z"]) and g[3.0]["detect_rate"] == 1.0
    b = watermarks.synthesize(spark, 12, 80, words, 3.0)
    assert watermarks.green_bias(watermarks.bigram_student(b)[0]).first()["strength"] > 0.5
    k = watermarks.kgw_counts(b)
    a = watermarks.attenuation(k, watermarks.kgw_counts(b.withColumn("text", F.upper("text")))).first()
    assert a["pairs"] == 12 and 0.5 < a["attenuation"] < 1.5


def test_manifests(spark, tmp_path):
    import hashlib
    import json

    for run in ("one", "two"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "o.md").write_text(f"output of {run}")
        h = hashlib.sha256(f"output of {run}".encode()).hexdigest()
        io.write_signed({"run_id": run, "merkle_root": h, "outputs": [{"file": "o.md", "sha256": h, "bytes": len(f"output of {run}")}]}, str(tmp_path / run / "manifest.json"))
    assert io.read_corpus(spark, str(tmp_path)).count() == 2
    m = json.loads((tmp_path / "two" / "manifest.json").read_text())
    (tmp_path / "two" / "manifest.json").write_text(json.dumps({**m, "note": "changed"}))
    assert [r["run_id"] for r in io.read_corpus(spark, str(tmp_path)).collect()] == ["one"]
    b = spark.createDataFrame([(b"xx c2pa yy", "a.JPG"), (b"none", "a.png"), (b"c2pa", "a.txt"), (None, "a.png")], "c binary, f string")
    assert [r[0] for r in b.select(io.provenance_status(F.col("c"), F.col("f"))).collect()] == ["unverified", "not_present", "unsupported_file", "not_applicable"]
    assert spark.createDataFrame([("aGk=",), ("!",)], "t string").select(io.decode_upload(F.col("t"))).collect()[0][0] == b"hi"


def test_catalog_and_manifests(spark, tmp_path):
    import json

    key = lambda c: F.lower(F.trim(c))
    records = spark.createDataFrame([("r1",), ("R1 ",), ("gone",), (None,)], "run_id string")
    runs = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("idle", "z"), (None, "q")], "run_id string, merkle_root string")
    assert sorted(map(tuple, corpus.catalog_check(records, runs, key).collect())) == [("gone", "dangling"), ("idle", "unreferenced"), ("r1", "duplicate"), ("r1", "root mismatch")]
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "é"), (None, 3, "x")], "run_id string, record_id int, text string")
    m = json.loads(corpus.manifests(r, F.col("run_id"), F.col("record_id").cast("string")).first()["manifest"])
    assert m["n_outputs"] == 2 and [o["bytes"] for o in m["outputs"]] == [1, 2] and len(m["merkle_root"]) == 64
    w = spark.createDataFrame([("P ", "2026-02-01", None), ("p", "2025-01-01", None), ("q", "2026-02-01", None), ("p", "2026-02-01", "declared-none")], "provider string, at string, status string")
    got = [tuple(x[0]) for x in w.select(corpus.resolve_watermark(F.col("provider"), F.col("at"), F.col("status"), {"p": ("2026-01-01", "s")})).collect()]
    assert got == [("suspected", "s"), ("unknown", None), ("unknown", None), ("declared-none", None)]
    path = str(tmp_path / "registry.jsonl")
    io.append_registry({"run_id": "a"}, path)
    with pytest.raises(ValueError):
        io.append_registry({"run_id": "a"}, path)
    assert io.validate_document(io.sign({"a": 1}), {"a": str, "b": int}) == ["b is missing", "a is no str"] and io.validate_document({"a": "x"}, {"a": str}) == ["the hash is not that of the content"]
    io.write_signed({"bundle_id": "one", "metrics": {}}, str(tmp_path / "b" / "one.json"))
    (tmp_path / "b" / "two.json").write_text(json.dumps({"bundle_id": "two", "metrics": {}, "artifact_sha256": "0"}))
    assert list(io.read_bundles(str(tmp_path / "b"))) == ["one"] and io.read_bundles(str(tmp_path / "none")) == {}
    assert io.reproduced({"a": 1.0, "b": 2.0, "c": 3.0}, {"a": 1.0, "b": 2.1}) == {"b": (2.0, 2.1), "c": (3.0, None)}


def test_hash_of_rows_in_order(spark):
    import hashlib

    df = spark.createDataFrame([(2, "b", 1), (1, "a", 0), (3, None, None)], "doc_id int, text string, label int")
    assert corpus.ordered_hash(df, "doc_id") == hashlib.sha256(b"a\x000\nb\x001\n\x00None\n").hexdigest()
    assert corpus.dataset_hash(df).first() == corpus.dataset_hash(df.orderBy("text")).first()
    with pytest.raises(ValueError):
        corpus.ordered_hash(df, "doc_id", most=2)


def test_tar_members(spark, tmp_path):
    import io as bytes_io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, body in (("x/one.json", b"{}"), ("x/two.txt", b"no"), ("three.json", b"[1]")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, bytes_io.BytesIO(body))
    assert sorted((r["member"], r["content"]) for r in io.read_tar(spark, str(tmp_path / "a.tar.gz")).collect()) == [("three.json", "[1]"), ("x/one.json", "{}")]


def test_findings_and_limits(spark):
    df = spark.createDataFrame([("supported", 0.9, 0.001, "verified"), ("supported", 0.65, 0.5, None), ("supported", 0.1, None, None), ("supported", 0.5, None, None), ("insufficient_data", 0.9, 0.001, None)], "s string, p double, q double, v string")
    got = [r[0] for r in df.select(ledger.plain_language(F.col("s"), F.col("p"), F.col("q"), F.col("v"))).collect()]
    assert got[0].startswith("Strong") and "watermark" in got[0] and "provenance" in got[0] and got[1] == "Moderate calibrated evidence suggests AI participation." and "leans human" in got[2] and "mixed" in got[3] and "not enough" in got[4]
    n = [len(r[0]) for r in df.select(ledger.limitations(F.col("s"), F.lit("prose"), F.lit("de"), F.lit(20), F.lit(True))).collect()]
    assert n == [6, 6, 6, 6, 7]


def test_joint_groups_and_windowed_corpus(spark):
    from textloom.operators import splits

    t = " ".join(f"w{i}" for i in range(60))
    g = splits.joint_groups({"train": spark.createDataFrame([(1, t), (2, "other words entirely here")], "doc_id int, text string"), "test": spark.createDataFrame([(1, t + " end")], "doc_id int, text string")}).collect()
    by = {(r["split"], r["doc_id"]): r["group"] for r in g}
    assert by["train", "1"] == by["test", "1"] != by["train", "2"]
    w = windows.windowed_corpus(spark.createDataFrame([(1, "a b c " * 50, 1, "g")], "doc_id int, text string, label int, group string"), budget=66, overlap=16)
    assert w.count() == 3 and {(r["label"], r["group"]) for r in w.collect()} == {(1, "g")}


def test_cross_cohort_and_radioactivity(spark):
    rows = [(f"g{i % 40}", i % 2, (i * 7 % 10) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "group string, y int, p double")
    got = {(r["part"], r["scores"]): r for r in transport.cross_cohort(df, df, lambda train: lambda d: d).collect()}
    assert len(got) == 4 and got["diagonal", "raw"]["delta_auroc"] == 0.0
    words = [f"w{i}" for i in range(30)]
    r = {x["stage"]: x["mean_z"] for x in watermarks.radioactivity(spark, 3.0, 20, 90, words).collect()}
    assert r["teacher"] > r["student"] > 2 > abs(r["control"]) and r["neutralised"] < r["student"]


def test_plugins_abstain(spark):
    from textloom.functions import registry

    registry.register("picky", lambda t: 1 / 0 if t == "bad" else 0.25)
    got = spark.createDataFrame([("ok",), ("bad",), (None,)], "t string").select(registry.attempt("picky", F.col("t")).alias("r")).collect()
    assert tuple(got[0]["r"]) == (0.25, None) and got[1]["r"]["raw_score"] == 0.5 and "picky" in got[1]["r"]["abstain_reason"] and got[2]["r"]["abstain_reason"] == "no text"
    assert registry.discover("no.such.group") == []


def test_command_line(capsys):
    from textloom.__main__ import main

    assert main(["queries"]) == 0 and "kgw_detect" in capsys.readouterr().out and main(["run", "nothing", "x", "y"]) == 2
