from textloom.llm import residue

NOTICE = "Please enable JavaScript to view this page."
PROSE = "The harbour was quiet before noon. Nobody had opened the ledger since the last ferry left. "


def test_residue_that_many_records_have(spark):
    """A notice on a third of the rows, whose terms are all frequent, is found like a rare one."""
    texts = [NOTICE if i % 3 == 0 else "What the\n\n# On page 277 the\n\n" + PROSE for i in range(60)]
    df = spark.createDataFrame([(i, t, "text") for i, t in enumerate(texts)], "record_id bigint, text string, kind string")
    assert {r["record_id"]: r["residue"] for r in residue.find_residue(df).collect()} == {i: "script" for i in range(0, 60, 3)}


def test_residue_that_all_records_have(spark):
    for text, kind in [(NOTICE, "script"), ("404 Not Found", "error")]:
        df = spark.createDataFrame([(i, text, "text") for i in range(5)], "record_id bigint, text string, kind string")
        assert {r["residue"] for r in residue.find_residue(df).collect()} == {kind}


def test_found_whatever_the_frequencies():
    for df in ({}, {"the": 900, "page": 400, "num": 700}, dict.fromkeys(residue.VOCABULARY, 300), dict.fromkeys(residue.VOCABULARY, 1000)):
        d = residue.Detector(*residue.weights(df, 1000))
        for text, kind in [(NOTICE, "script"), ("Error 503: upstream failure", "error"), ("Lorem ipsum dolor sit amet.", "filler"), ("asdf qwer zxcv jkl", "filler"), ("Dear {{ name }},", "placeholder")]:
            assert d.kind(text) == kind and d.kind(PROSE + text) == kind, (text, len(df))


def test_exemplars_ask_for_different_words():
    assert all(len(e.groups) in (1, 2) and all(e.groups) and e.words.issuperset(e.groups[0]) for e, _ in residue.EXEMPLARS)
    assert {e.label for e, _ in residue.EXEMPLARS} == {"placeholder", "filler", "error", "script"}
