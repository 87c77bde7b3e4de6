from textloom.llm import encoding

DE = "Für die Größe der Straße prüft die Gärtnerin das Frühstück und hält die Tür offen. "
PT = "A decisão não está no coração do português que lê a lição amanhã. "


def restored(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    return {r["doc_id"]: r["restored"] for r in encoding.restore(df).collect()}


def test_a_third_of_the_documents_garbled(spark):
    """A source that was misread between single-byte sets is as frequent as half the clean texts."""
    clean = {i: (DE if i % 2 else PT) + f"No {i}." for i in range(30)}
    texts = {i: encoding.misread(t, "cp1252", "mac_roman") if i % 3 == 0 else t for i, t in clean.items()}
    assert restored(spark, texts) == {i: t for i, t in clean.items() if i % 3 == 0}


def test_copies_of_a_garbled_document(spark):
    """Copies don't make a garbled word known, be they more than the clean documents."""
    clean = {i: PT + f"No {i}." for i in range(3)} | {10: PT + "A lição.", 11: PT + "A lição.", 12: PT + "A lição.", 13: PT + "A lição."} | {20 + i: DE for i in range(8)} | {30: DE + "Acht."}
    texts = {i: encoding.misread(t, "cp1252", "mac_roman") if i in (10, 11, 12, 13, 30) else t for i, t in clean.items()}
    assert restored(spark, texts) == {i: clean[i] for i in (10, 11, 12, 13, 30)}


def test_twin_records_teach_a_transformation(spark):
    """A record and its garbled near-twin teach what made one of the other; without any, nothing is learned."""
    texts = [DE + "A lone line."] + [encoding.misread(DE + "A lone line.", "utf-8", "cp1250"), PT, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {encoding.CHAINS[r["chain"]]: r["n"] for r in encoding.twin_votes(df).groupBy("chain").agg({"evidence": "count"}).withColumnRenamed("count(evidence)", "n").collect()}
    assert max(got, key=got.get) == ("utf-8", "cp1250") and encoding.twin_votes(df.where("doc_id > 1")).count() == 0
    assert encoding.Restorer({}).order == [] and restored(spark, {1: encoding.misread(DE, "utf-8", "cp1252"), 2: "plain"}) == {}


def test_alignment():
    assert encoding.aligned("GrÃ¶ÃŸe Ã¼", "Größe ü") == [("Ã¶ÃŸ", "öß"), ("Ã¼", "ü")] and encoding.aligned("abc é", "abd ë") == []
