"""Every operator on tables without rows, and with one of its tables empty."""

import pytest

from textloom.llm import canonical, cross_split, encoding, language, mixing, oversized, packing, related_splits, residue

RECORDS = "record_id bigint, cohort_id string, batch_id bigint, run_id string, prompt_id string, text string, label int, family string, kind string, split string, sha256 string"
DOCS = "doc_id bigint, text string, source string, lang string"


@pytest.fixture(scope="module")
def tables(spark):
    t = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    words = "one two three four five six seven eight nine ten " * 4
    return {
        "records": t([(1, "c", 1, "r", "p", words, 0, "human", "text", "train", None), (2, "c", 1, "r", "p", words, 1, "m", "text", "test", None), (3, None, None, None, None, None, None, None, None, None, None)], RECORDS),
        "runs": t([("r", "who")], "run_id string, contributor string"),
        "manifest": t([("c", "run_id", 0.5, 0.2, 0.2, 0.1)], "cohort_id string, group_unit string, train_share double, development_share double, calibration_share double, test_share double"),
        "windows": t([(1, 0, 0, None), (9, 0, 0, 5)], "record_id bigint, window_no int, token_start int, token_end int"),
        "documents": t([(1, "some words", "s", "en"), (2, None, None, None)], DOCS),
        "targets": t([("s", 0.5, 2)], "source string, target_share double, max_repeats int"),
        "packs": t([("a", 8)], "pack_name string, capacity_tokens int"),
        "diagnostics": t([(1, "en")], "record_id bigint, language string"),
        "hygiene": t([(1, 5, 1)], "batch_id bigint, rows_raw bigint, dropped_error_artifacts bigint"),
    }


USES = {
    "p1": (("records", "runs", "manifest"), related_splits.related_pairs),
    "p1 splits": (("records", "runs", "manifest"), related_splits.assign_splits),
    "p3": (("records", "windows"), oversized.split_windows),
    "p4": (("records",), residue.find_residue),
    "p4 batches": (("records", "hygiene"), residue.batch_report),
    "p5": (("records",), canonical.formatting_pairs),
    "p6": (("records",), cross_split.cross_split_pairs),
    "p6 report": (("records",), cross_split.overlap_report),
    "p7": (("records", "diagnostics"), lambda r, d: language.relabelled(r, d, language.fit_profiles(r, d))),
    "p8": (("documents", "packs"), packing.pack_documents),
    "p9": (("documents", "targets"), mixing.mix),
    "p9 report": (("documents", "targets"), mixing.mix_report),
    "p10": (("documents",), encoding.restore),
}


@pytest.mark.parametrize("name", USES)
def test_no_rows(tables, name):
    needs, operator = USES[name]
    full = operator(*(tables[n] for n in needs))
    assert full.count() >= 0
    for gone in [*({n} for n in needs), set(needs)]:
        got = operator(*(tables[n].limit(0) if n in gone else tables[n] for n in needs))
        assert got.schema == full.schema and got.count() >= 0, gone
        if gone == set(needs):
            assert got.count() == 0
