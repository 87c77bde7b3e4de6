from hashlib import sha256

import pytest

from textloom.llm import encoding, language, pairs, residue

PROSE = "The harbour was quiet before noon. Nobody had opened the ledger since the last ferry left. "


@pytest.fixture(scope="module")
def detector():
    return residue.Detector(*residue.weights({"the": 900, "a": 900, "is": 800, "not": 500, "found": 400, "to": 900, "for": 800, "in": 900, "page": 200, "num": 700, "missing": 100}, 1000))


@pytest.mark.parametrize("text,kind", [
    ("Dear {{ name }},\n\n" + PROSE, "placeholder"), (PROSE + "\n\nSent by [INSERT NAME HERE]", "placeholder"), (PROSE + "Title: __ENGINE__", "placeholder"), (PROSE + "${museum}", "placeholder"), ("Dear {% block title %},\n\n" + PROSE, "placeholder"), (PROSE + "Hello #{user.name}, welcome.", "placeholder"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), (PROSE + "\n\nTempor labore enim magna aliqua ut dolore.", "filler"), ("asdf qwer zxcv asdf", "filler"),
    ("404 Not Found", "error"), ("Rate limit exceeded. Please try again later.", "error"), (PROSE + "Nobody had\n\n[stream aborted: upstream connect error, code 503, id 7c9a37c9]", "error"),
    ("Please enable JavaScript to view this page.", "script"), ("Bitte aktivieren Sie JavaScript, um den Inhalt zu sehen.", "script"),
    (PROSE, None), (PROSE + "In a template the author writes {{ column }} and the engine fills it in later.", None), (PROSE + "Printers have used the words lorem ipsum for a valley since long ago.", None),
    (PROSE + "Our server answers 404 whenever the lecture is missing, which the manual explains in detail.", None), (PROSE + "Citations such as [1] and [headline 1988] stay as they are.", None), (None, None), ("", None), ("N/A", None),
])
def test_residue(detector, text, kind):
    assert detector.kind(text) == kind


def test_code_uses_placeholders_properly(detector):
    assert detector.kind("function f(x) {\n  return `${x} rows`;\n}\n", True) is None
    assert detector.kind('def f(x):\n    # TODO: later\n    return f"{x} rows"\n', True) is None


def test_residue_rows(spark):
    rows = [(1, "404 Not Found", "text"), (1, "404 Not Found", "text"), (2, PROSE * 2000, "text"), (3, None, "text"), (4, "", None), (None, "404 Not Found", "text")]
    df = spark.createDataFrame([(*x, "r") for x in rows], "record_id bigint, text string, kind string, residue string")
    assert [tuple(r) for r in residue.find_residue(df).collect()] == [(1, "error")]
    assert residue.find_residue(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def profiles():
    c = language.seed_counts()
    return language.Profiles({k: language.profile(v) for k, v in c.items()})


EN, DE, FR = "We have not seen who was in the house before they left it. ", "Wir haben nicht gesehen, wer in dem Haus war, bevor sie es verließ. ", "Nous ne savons pas qui était dans la maison avant que les autres y soient. "


def test_segments(profiles):
    texts = [EN * 2, EN + DE + DE + EN, "", EN + "She wrote “auf Wiedersehen” under it. " + EN, FR + "\n" + DE]
    at, scores = language.evidence(profiles, texts)
    got = [[s[2] for s in language.segments(profiles, scores[a:b])] for a, b in zip(at, at[1:])]
    assert got == [["en"], ["en", "de", "en"], [], ["en"], ["fr", "de"]]
    for t, a, b in zip(texts, at, at[1:]):
        spans = language.sentence_spans(profiles, t)
        assert len(spans) == b - a and "".join(t[x:y] for x, y in spans) == t


def test_stretches_take_the_nearest_profile(profiles):
    text = EN * 3 + DE * 3
    at, scores = language.evidence(profiles, [text])
    got = language.stretches(profiles, text, language.segments(profiles, scores))
    assert [(text[a:b].strip() == (EN * 3 if k == "en" else DE * 3).strip(), k) for a, b, k, _ in got] == [(True, "en"), (True, "de")]
    # A course that is wrong about a language is put right, and what then is one language is one stretch.
    assert [x[2] for x in language.stretches(profiles, EN * 4, [(0, 2, "nl"), (2, 4, "fr")])] == ["en"]
    assert language.stretches(profiles, "12 34", [(0, 1, "es")])[0][2] == "es"


def test_relabelled(spark, profiles):
    rows = [(1, EN * 3), (2, EN * 3), (3, EN * 3), (4, EN * 2 + DE * 2), (5, "Too short."), (6, None), (7, DE * 3), (7, DE * 3), (8, FR * 3)]
    labels = [(1, "en-GB"), (2, "de"), (3, None), (4, "EN"), (7, " German "), (5, None)]
    r = spark.createDataFrame([(*x, "text", "q") for x in rows], "record_id bigint, text string, kind string, language string")
    got = language.relabelled(r, spark.createDataFrame(labels, "record_id bigint, language string"), profiles)
    assert sorted((x["record_id"], x["segment_no"], x["language"]) for x in got.collect()) == [(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (4, 2, "de"), (8, 1, "fr")]
    assert all(0 < x["confidence"] <= 1 for x in got.collect())


def test_fitted_profiles(spark):
    r = spark.createDataFrame([(i, [EN, DE, FR][i % 3] * 3, "text") for i in range(60)], "record_id bigint, text string, kind string")
    p = language.fit_profiles(r, spark.createDataFrame([(i, ["en", "de", "fr"][i % 3] if i % 10 else "nl") for i in range(60)], "record_id bigint, language string"))
    assert [p.language(t)[0] for t in (EN, DE, FR)] == ["en", "de", "fr"]


@pytest.mark.parametrize("text,is_refusal", [
    ("I'm sorry, but I can't help with that.", True), ("I cannot assist with this request. I hope you find another source.", True), ("Dazu möchte ich mich nicht äußern. Kann ich sonst etwas tun?", True),
    ("Lo siento, pero no puedo ayudar con eso.", True), ("Il m'est impossible de répondre à cette demande.", True), ("I cannot help smiling at this task. " + PROSE, False), ("I can't promise this is complete, but here it is. " + PROSE, False), (PROSE, False),
])
def test_refusals(text, is_refusal):
    assert pairs.refuses(text) == is_refusal


def test_copies():
    c, prompt = pairs.CopyCheck(), "Describe a broad verdict behind the station for a visitor in 400 words."
    assert c(prompt, prompt) and c(prompt, "You asked: " + prompt.lower()) and c(prompt, f'"{prompt}"') and c(prompt, prompt[:-1] + "?\n")
    assert not c(prompt, prompt + "\n\n" + PROSE) and not c(prompt, "Describe a verdict.") and not c("", "x")


def test_copies_by_the_compressor_alone():
    """Padding, marks and case don't hide a copy; a changed word, a part or an answer isn't one."""
    c, prompt = pairs.CopyCheck(), "Explain in 120 words why the orchard matters to the river, and who keeps it."
    assert c(prompt, "   " * 900 + prompt.upper() + "\n" * 50 + "*" * 3000) and c(prompt, "The question was: " + prompt.replace(" ", "  —  "))
    assert not c(prompt, prompt.replace("orchard", "lighthouse")) and not c(prompt, prompt[:40]) and not c(prompt, prompt + " It matters since nobody else would ever water the trees in summer.")
    assert c("Why?", "Why?") and not c("Why?", "Who?")


def test_a_long_refusal():
    assert pairs.refuses("I'm sorry, but I cannot help with that request. " * 60) and not pairs.refuses("I cannot help with that. " + PROSE * 40)


def test_ends_are_judged_by_all_records(spark):
    """A line that several records end with is no cut, also if each has it without a mark; a pair that
    goes on in the other records is one."""
    rows = [(i, PROSE + f"Number {i} is done.\n\nWarm greetings\nthe harbour office") for i in range(6)] + [(10, PROSE + "Nobody had opened")] + [(20 + i, PROSE * 2) for i in range(4)]
    r = spark.createDataFrame([(i, "p", t, "text") for i, t in rows], "record_id bigint, prompt_id string, text string, kind string")
    open_ = spark.createDataFrame([(i, *pairs.terminal_contexts(t)) for i, t in rows[:7]], ", ".join(["record_id bigint", *(f"{k} string" for k in pairs.ROLES)]))
    assert [x["record_id"] for x in pairs.cut_off(open_, r).collect()] == [10]
    assert pairs.cut_off(open_.limit(0), r).count() == 0


def test_contexts_against_brute_force(spark):
    texts = [PROSE, "One two.\nOne two three", "one two", "A b c.", "", None, "One two"]
    r = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, text string")
    wanted = spark.createDataFrame([("two",), ("one two",), ("$ one two",), ("$ two",), ("$$ one two",), ("$$ one two three",), ("missing",)], "context string")
    got = {x["context"]: (x["ends"], x["goes_on"]) for x in pairs.context_counts(r, wanted).collect()}
    assert got == {"two": (1, 1), "one two": (1, 1), "$ one two": (2, 0), "$ two": (2, 0), "$$ one two": (0, 1), "$$ one two three": (1, 0)}


def test_defects(spark, profiles):
    prompts = [("text-1", "Describe the harbour in 100 words."), ("Text-2", "Describe the harbour. Answer in German."), ("text-3", None)]
    good = PROSE * 3
    rows = [(1, " TEXT-1 ", good), (2, "text-1", None), (3, "text-1", "(no answer)"), (4, "text-1", "Describe the harbour in 100 words."), (5, "text-1", "I must decline."), (6, "text-1", DE * 3), (7, "text-2", DE * 3), (8, "text-2", good),
            (9, "text-1", good + "The ferry captain left the,"), (10, "text-1", good + "\n\nBest wishes,\nyour neighbour"), (11, "elsewhere", None), (12, None, None), (13, "text-3", good), (2, "text-1", None), (14, "text-1", "404 Not Found"), (15, "text-1", "x" * 300_000 + ".")]
    r = spark.createDataFrame([(i, p, t, "text", "d") for i, p, t in rows], "record_id bigint, prompt_id string, text string, kind string, defect string")
    p = spark.createDataFrame(prompts, "prompt_id string, prompt string")
    got = {x["record_id"]: x["defect"] for x in pairs.find_defects(r, p, profiles).collect()}
    assert {k: v for k, v in got.items() if k != 14} == {2: "empty", 3: "empty", 4: "copy", 5: "refusal", 6: "other_language", 8: "other_language", 9: "truncated"}


def test_code_that_breaks_off():
    assert pairs.code_breaks_off("def f(a):\n    return [x for x in a") and pairs.code_breaks_off("def f(") and pairs.code_breaks_off("total = 1\nreturn tot")
    assert not pairs.code_breaks_off("def f(a):\n    return a[:3]") and not pairs.code_breaks_off("const f = (x) => {\n  return `${x}`;\n};")


def test_encodings(spark):
    de, en, pt = "Für die Größe der Straße prüft die Gärtnerin das Frühstück. ", "It’s a naïve letter, a café reply at best — nobody’s façade. ", "A decisão não está no coração do português. "
    texts = {}
    for i in range(6):
        texts[i], texts[10 + i], texts[20 + i] = de + f"Zeile {i}.", en + f"Line {i}.", pt + f"Linha {i}."
    clean = {30: de + "Acht.", 31: en + "Nine.", 32: pt + "Dez.", 33: en + "Ten.", 34: de + "Elf.", 35: pt + "Doze."}
    bad = {30: encoding.misread(clean[30], "utf-8", "cp1252"), 31: encoding.misread(encoding.misread(clean[31], "utf-8", "cp1252"), "utf-8", "cp1252"), 32: encoding.misread(clean[32], "utf-8", "mac_roman"), 33: encoding.misread(clean[33], "cp1252", "cp437"), 34: encoding.misread(clean[34], "utf-8", "latin-1"), 35: encoding.misread(clean[35], "utf-8", "cp850")}
    part = en + encoding.misread(en, "utf-8", "cp1250") + en
    rows = [*texts.items(), *bad.items(), (40, part), (41, en.replace("’", "�").replace("é", "�")), (42, "The log showed “Ã©” in row 3 where “é” had been meant. " + en), (43, None), (44, ""), (45, de.replace("ö", "?").replace("ü", "?")), (46, "What? Why? http://a.b/c?d=e "), (47, "plain"), (None, bad[30])]
    df = spark.createDataFrame([(*x, "w") for x in rows], "doc_id bigint, text string, word string")
    got = {r["doc_id"]: r["restored_sha256"] for r in encoding.restored_hashes(df).collect()}
    want = {k: sha256(v.encode()).hexdigest() for k, v in clean.items()} | {40: sha256((en * 3).encode()).hexdigest(), 41: "lost", 45: "lost"}
    assert got == want
    assert encoding.restore(df.limit(0)).count() == 0


def test_no_rows_no_results(spark, profiles):
    r = spark.createDataFrame([], "record_id bigint, prompt_id string, text string, kind string, language string")
    p = spark.createDataFrame([], "prompt_id string, prompt string")
    assert pairs.find_defects(r, p, profiles).count() == 0 and language.relabelled(r, r, profiles).count() == 0
    one = spark.createDataFrame([(1, "p", PROSE + "Nobody had opened the", "text", None)], r.schema)
    assert pairs.find_defects(one, p, profiles).count() == 0
    # Without other texts the end of the only one is cut off: nothing shows that texts end so.
    got = pairs.find_defects(one, spark.createDataFrame([("P", "Describe the harbour in 100 words.")], "prompt_id string, prompt string"), profiles).collect()
    assert [tuple(x) for x in got] == [(1, "truncated")]
