"""Problem 10: garbled text from wrong character encoding."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_rows, only_ids
from textloom.session import cut_lineage

# Character sets that text is written in, and in which it may be wrongly read.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "iso8859-15", "iso8859-2", "koi8-r", "cp1253", "cp1257", "mac_latin2")
#: How often a text may have been misread in a row.
DEPTH = 3
#: A transformation is learned from so many different pairs of something garbled and clean.
LEAST_PAIRS = 2

_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
#: A word is a piece of text between ASCII blanks; other blanks may be halves of a garbled character.
_PIECE = re.compile(r"[^ \t\n\r\f\v]*[^\x00-\x7f \t\n\r\f\v][^ \t\n\r\f\v]*")
_EDGES = "“”‘’\"'«»„()[]{}<>.,;:!?…—–-*_#`¿¡"


@lru_cache(maxsize=None)
def charset(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """A single-byte set as both maps; bytes it leaves undefined are read as control characters."""
    to = {}
    for b in range(256):
        try:
            to[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            to[b] = chr(b)
    back: dict[str, int] = {}
    for b, c in to.items():
        back.setdefault(c, b)
    return to, back


def to_bytes(text: str, name: str) -> bytes | None:
    back = charset(name)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def misread(text: str, written: str, read: str) -> str | None:
    """``text`` written in one character set and read in another."""
    try:
        b = text.encode(written)
    except UnicodeEncodeError:
        return None
    to = charset(read)[0]
    return "".join([to[x] for x in b])


def reread(text: str, written: str, read: str) -> str | None:
    """What was misread so, or None if that can't be."""
    b = to_bytes(text, read)
    if b is None:
        return None
    if written != "utf-8":
        to = charset(written)[0]
        return "".join([to[x] for x in b])
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return None


CHAINS: tuple[tuple[str, str], ...] = tuple((w, r) for w in WRITTEN for r in READ if w != r)
SINGLE_BYTE = tuple(c for c in CHAINS if c[0] != "utf-8")


def runs(word: str) -> list[str]:
    return _NON_ASCII.findall(word)


@lru_cache(maxsize=100_000)
def undo_run(run: str, read: str) -> str:
    """A run of non-ASCII characters with the UTF-8 sequences in it read aright; the rest stays."""
    whole = reread(run, "utf-8", read)
    if whole is not None:
        return whole
    back = charset(read)[1]
    out, i = [], 0
    while i < len(run):
        b = back.get(run[i])
        n = 2 if b is not None and 0xC2 <= b <= 0xDF else 3 if b is not None and 0xE0 <= b <= 0xEF else 4 if b is not None and 0xF0 <= b <= 0xF4 else 0
        got = reread(run[i : i + n], "utf-8", read) if n and i + n <= len(run) else None
        if got is not None and len(got) == 1:
            out.append(got)
            i += n
        else:
            out.append(run[i])
            i += 1
    return "".join(out)


def undo_word(word: str, chain: tuple[str, str]) -> str:
    """A word as it was before the chain; itself if the chain can't have made it."""
    written, read = chain
    if written == "utf-8":
        return _NON_ASCII.sub(lambda m: undo_run(m[0], read), word)
    got = [reread(r, written, read) for r in runs(word)]
    if any(g is None or not plausible(g) for g in got):
        return word
    it = iter(got)
    return _NON_ASCII.sub(lambda _: next(it), word)


@lru_cache(maxsize=100_000)
def plausible(run: str) -> bool:
    """Whether characters are such as texts have: letters of Latin script, usual marks and blanks."""
    return all(c.isalpha() and ord(c) < 0x250 and c not in "ƒªº" or c in "“”‘’«»„‚—–…€£§°¿¡· †‡•©®™½¼¾²³ºª´×÷" for c in run)


_NATURAL = re.compile(r"[À-ÖØ-öø-ÿŒœ]+|’")
_INNER_CAPITAL = re.compile(r"[a-zß-öø-ÿœ][À-ÖØ-ÞŒ]")


@lru_cache(maxsize=100_000)
def natural(word: str) -> bool:
    """Whether a word without the marks around it is written as words of the Western languages are:
    their letters, no capital after a small letter, no other mark inside."""
    return all(_NATURAL.fullmatch(r) for r in runs(word)) and not _INNER_CAPITAL.search(word)


def quoted(word: str) -> bool:
    """Whether the word only shows a sequence: nothing but non-ASCII characters between quotation
    marks or brackets."""
    m = re.fullmatch(r"[(\[]?([“\"'‘«„`])(.+?)([”\"'’»“`])[)\]]?[.,;:!?]*", word)
    return bool(m) and not any(c.isascii() and c.isalnum() for c in m[2])


def bare(word: str) -> str:
    """A word without the marks around it, if letters remain."""
    return word.strip(_EDGES)


#: A letter where none belongs: before a capital, after a mark, or alone; what is left of quotation
#: marks and dashes that were misread.
MISPLACED = r"^[à-ÿœ][A-Z]|[,.;:!?][À-ÿœ]+$|^[ùöôûîõïøåæ]$"
_MISPLACED = re.compile(MISPLACED)


def doc_words(text: str) -> list[str]:
    """The different words with non-ASCII characters, quoted sequences left out."""
    return [w for w in dict.fromkeys(_PIECE.findall(text)) if not quoted(w)]


def lost(text: str) -> bool:
    """Whether characters were replaced for good: a replacement character that isn't just shown."""
    return any("�" in w and not quoted(w) for w in _PIECE.findall(text))


_ASKED = re.compile(r"[^\s?]*[^\W\d_]\?[^\W\d_][^\s]*|(?<![^\s])\?[a-zß-ÿ][^\s]*")


def replaced_words(text: str) -> list[str]:
    """Words with a question mark inside or before a letter, as a replaced character leaves them."""
    pieces = " ".join([w for w in text.split() if "?" in w])
    return [w for w in dict.fromkeys(_ASKED.findall(pieces)) if "://" not in w and "=" not in w and "/" not in w] if pieces else []


@lru_cache(maxsize=100_000)
def suspicious(word: str) -> bool:
    """Whether some transformation can have made the word's non-ASCII characters."""
    rs = runs(word)
    if any(not plausible(r) for r in rs):
        return True
    return any(undo_run(r, read) != r for r in rs for read in READ)


@lru_cache(maxsize=100_000)
def promising(word: str, depth: int = DEPTH - 1) -> bool:
    """Whether the word's non-ASCII characters are such as texts have, at once or after undoing
    further misreadings of UTF-8."""
    rs = runs(word)
    if all(map(plausible, rs)):
        return True
    return depth > 0 and any(u != word and promising(u, depth - 1) for u in (undo_word(word, ("utf-8", r)) for r in READ))


class Restorer:
    """Restores texts by the transformations learned and the words that clean texts have."""

    def __init__(self, support: dict[tuple[str, str], int]):
        self.order = sorted((c for c in CHAINS if support.get(c, 0) >= LEAST_PAIRS), key=lambda c: (-support.get(c, 0), CHAINS.index(c)))

    def step(self, words: list[str], known: set[str]) -> tuple[str, str] | None:
        """The transformation to undo next: the one that mends most of the words, less those that
        it would spoil; None if none mends any."""
        best, most = None, 0.0
        for c in self.order:
            good = 0.0
            for w in words:
                u = undo_word(w, c)
                if u == w:
                    continue
                if c[0] == "utf-8":
                    good += (1.0 if promising(u) else -2.0) + (0.5 if bare(u) in known else 0.0)
                elif bare(w) not in known and bare(u) in known:
                    good += 1.0
                elif _MISPLACED.search(bare(w)) and bare(u).isascii():
                    good += 0.5  # only quotation marks or dashes were garbled
            if c[0] != "utf-8" and good < (2 if any(bare(w) in known for w in words) else 1):
                continue  # beside clean words, one word could be chance
            if good > most + 1e-9:
                best, most = c, good
        return best

    def text(self, text: str, known: set[str]) -> str:
        """The text with its garbled words restored; ``known`` has words of clean texts."""
        for _ in range(DEPTH):
            words = doc_words(text)
            c = self.step(words, known)
            if c is None:
                break
            if c[0] == "utf-8":
                keep = lambda w: quoted(w) or not promising(undo_word(w, c))  # noqa: E731, B023
            elif any(bare(w) in known and len(bare(w)) > 2 for w in words):
                keep = lambda w: quoted(w) or bare(w) in known  # noqa: E731  # garbled in part
            else:
                keep = quoted
            text = _PIECE.sub(lambda m: m[0] if keep(m[0]) else undo_word(m[0], c), text)  # noqa: B023
        return text


def words_of(documents: DataFrame) -> DataFrame:
    """``(word, n)``: the words with non-ASCII characters in all documents, without the marks around
    them, and in how many documents they are; counted in each task before the shuffle."""

    def make():
        def work(texts):
            n: dict[str, int] = {}
            for t in texts:
                if not t.isascii():
                    for w in {bare(w) for w in _PIECE.findall(t)}:
                        if w and not w.isascii():
                            n[w] = n.get(w, 0) + 1
            return list(n), list(n.values())

        return work

    return map_rows(documents.where("text is not null"), ["text"], make, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def aligned(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Runs of non-ASCII characters that stand at the same place of two texts and differ; none if the
    texts' ASCII characters aren't the same."""
    if _NON_ASCII.split(garbled) != _NON_ASCII.split(clean):
        return []
    return [(a, b) for a, b in zip(_NON_ASCII.findall(garbled), _NON_ASCII.findall(clean)) if a != b]


@lru_cache(maxsize=50_000)
def run_chains(garbled: str, clean: str) -> tuple[int, ...]:
    """Numbers of the transformations that make the one run of the other."""
    return tuple(k for k, c in enumerate(CHAINS) if misread(clean, *c) == garbled)


def twin_votes(docs: DataFrame) -> DataFrame:
    """``(chain, evidence)`` from records that are the same but for non-ASCII characters.

    Records meet on the hash of their text without these; of such a group the text with the fewest
    words that some transformation can have made stands for it, and each other text is aligned with
    that one, so no group's pairs are formed. Evidence is a pair of aligned runs.
    """
    plain = F.regexp_replace("text", r"[^\x00-\x7F]+", "")
    marked = docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", F.xxhash64(plain, F.length(plain)).alias("twin"), F.xxhash64("text").alias("own"))
    each = cut_lineage(marked.groupBy("twin", "own").agg(F.min("doc_id").alias("doc_id")))
    groups = each.groupBy("twin").agg(F.count("*").alias("n")).where("n > 1").select("twin")
    mine = cut_lineage(each.join(groups, "twin", "left_semi").select("doc_id", "twin"))
    t = only_ids(docs, mine, "doc_id", "left_semi").join(mine, "doc_id")

    def count():
        return lambda ids, texts, twins: (ids, texts, twins, [sum(map(suspicious, doc_words(x))) for x in texts])

    t = map_rows(t, ["doc_id", "text", "twin"], count, "doc_id bigint, text string, twin bigint, odd int")
    best = t.groupBy("twin").agg(F.min_by(F.struct("doc_id", "text"), F.struct("odd", "doc_id")).alias("best"))
    x = t.join(best, "twin").where(F.col("doc_id") != F.col("best.doc_id")).select("text", F.col("best.text").alias("clean"))

    def vote():
        def work(texts, cleans):
            found = {(k, f"{a} {b}") for t, c in zip(texts, cleans) for a, b in aligned(t, c) for k in run_chains(a, b)}
            return [k for k, _ in found], [e for _, e in found]

        return work

    return map_rows(x, ["text", "clean"], vote, "chain int, evidence string")


def word_votes(words: DataFrame) -> DataFrame:
    """``(chain, evidence)`` from words: each with every word that a transformation can have made it of, if
    that one looks clean, is attested by more documents, or is written as languages write while this one
    isn't. Both have the same ASCII characters, since transformations leave these."""

    def make():
        def work(ws, ns):
            out: list[list] = [[], [], [], [], []]
            for w, n in zip(ws, ns):
                if not _NON_ASCII.sub("", w):
                    continue
                for k, c in enumerate(CHAINS):
                    u = bare(undo_word(w, c))
                    if u and u != w and all(map(plausible, runs(u))) and not suspicious(u):
                        for column, v in zip(out, (w, n, k, u, not natural(w) and natural(u))):
                            column.append(v)
            return out

        return work

    made = map_rows(words, ["word", "n"], make, "word string, n bigint, chain int, was string, plain boolean")
    clean = words.select(F.col("word").alias("was"), F.col("n").alias("was_n"))
    return made.join(clean, "was").where("was_n > n or plain").select("chain", F.col("word").alias("evidence"))


def learned(words: DataFrame, docs: DataFrame) -> dict[tuple[str, str], int]:
    """By transformation, from how many different pieces of evidence it is learned: aligned runs of
    near-twin records, and words that occur garbled and clean. The driver gets a row per
    transformation that this module knows."""
    votes = twin_votes(docs).union(word_votes(words)).distinct().groupBy("chain").agg(F.count("*").alias("n")).collect()
    return {CHAINS[r["chain"]]: r["n"] for r in votes}


def candidates(words: DataFrame, support: dict[tuple[str, str], int]) -> DataFrame:
    """``(word, n, was, odd, was_odd)``: what each word may have been before one or two of the
    transformations, and which of both no language writes so."""
    order = Restorer(support).order

    def make():
        def work(ws, ns):
            out: list[list] = [[], [], [], [], []]
            for w, n in zip(ws, ns):
                once = {u for c in order if (u := undo_word(w, c)) != w}
                twice = {u for x in once if suspicious(x) for c in order if c[0] == "utf-8" and (u := undo_word(x, c)) != x}
                for u in {bare(u) for u in once | twice} - {w, ""}:
                    for column, v in zip(out, (w, n, u, not natural(w), not natural(u))):
                        column.append(v)
            return out

        return work

    return map_rows(words, ["word", "n"], make, "word string, n bigint, was string, odd boolean, was_odd boolean")


def restore(documents: DataFrame) -> DataFrame:
    """``(doc_id, restored, lost)`` of each document with text garbled by a wrong encoding, in whole
    or in part; ``restored`` is the whole text, or null where characters were ``lost`` for good
    (replaced by U+FFFD or by question marks inside known words).

    Transformations are learned from near-twin records and from words that occur garbled and clean in
    the documents; those learned are applied to all words that they mend: misread UTF-8 is told by
    its sequences, other misreadings need words that clean documents have. Sequences that stand alone between quotation marks are shown on
    purpose and stay. Null, empty and clean texts have no rows, null ids neither; each row of
    ``documents`` is a document of its own. Tables of words are joined, never gathered.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    words = cut_lineage(words_of(docs))
    support = learned(words, docs)
    made = cut_lineage(candidates(words, support))
    was = made.join(words.select(F.col("word").alias("was"), F.col("n").alias("was_n")), "was")
    was = cut_lineage(was.where("was_n >= 2").select("word", "n", "was", "was_n", "odd", "was_odd"))
    # A word that no language writes so is garbled if what it was is attested, however many documents
    # have it; between words of the same look, and only there, the frequencies decide.
    plain = was.where("odd and not was_odd").select("word").distinct()
    garbled = cut_lineage(was.where("was_n >= 3 * n").join(plain.select(F.col("word").alias("was")), "was", "left_anti").select("word").union(plain).distinct())
    unknown = garbled.union(made.where("odd and not was_odd").select("word")).distinct()
    clean = words.where((F.col("n") >= 2) & ~F.col("word").rlike(MISPLACED)).join(unknown, "word", "left_anti").select(F.col("word").alias("known"))
    helps = was.select("word", F.col("was").alias("known")).union(clean.select(F.col("known").alias("word"), "known")).join(clean, "known", "left_semi")

    def spread():
        def work(ids, texts):
            out: list[list] = [[], [], []]
            for i, t in zip(ids, texts):
                if t.isascii():
                    rows = []
                else:
                    ws = doc_words(t)
                    rows = [(b, suspicious(w) or "�" in w) for w in ws if not (b := bare(w)).isascii() or suspicious(w)]
                rows += [(b, None) for w in replaced_words(t) if (b := bare(w))]
                for w, odd in dict(rows).items():
                    out[0].append(i)
                    out[1].append(w)
                    out[2].append(odd)
            return out

        return work

    each = cut_lineage(map_rows(docs, ["doc_id", "text"], spread, "doc_id bigint, word string, odd boolean"))
    masks = words.where("n >= 2").select(F.regexp_replace("word", r"[^\x00-\x7f]", "?").alias("word")).where(F.length(F.regexp_replace("word", "[^a-zA-Z]", "")) >= 2).distinct()
    asked = each.where("odd is null").join(masks, "word", "left_semi").select("doc_id", F.lit(True).alias("asked"))
    odd = each.where("odd").select("doc_id", F.lit(False).alias("asked")).union(each.where("odd is not null").join(garbled, "word", "left_semi").select("doc_id", F.lit(False)))
    chosen = cut_lineage(odd.union(asked).groupBy("doc_id").agg(F.max("asked").alias("asked")))
    mine = only_ids(each.where("odd is not null").select("doc_id", "word"), chosen, "doc_id", "left_semi")
    known = mine.join(helps, "word").groupBy("doc_id").agg(F.collect_set("known").alias("known"))
    texts = only_ids(docs, chosen, "doc_id", "left_semi").join(chosen, "doc_id").join(known, "doc_id", "left")

    def mend():
        r = Restorer(support)

        def work(ids, texts, askeds, knowns):
            out: list[list] = [[], [], []]
            for i, t, a, k in zip(ids, texts, askeds, knowns):
                gone = a or lost(t)
                new = None if gone else r.text(t, set(k or ()))
                if gone or new != t:
                    for column, v in zip(out, (i, new, bool(gone))):
                        column.append(v)
            return out

        return work

    return map_rows(texts.select("doc_id", "text", "asked", "known"), ["doc_id", "text", "asked", "known"], mend, "doc_id bigint, restored string, lost boolean")


def restored_hashes(documents: DataFrame) -> DataFrame:
    """``(doc_id, restored_sha256)``: the hash of the restored text in UTF-8, or ``lost``."""
    return restore(documents).select("doc_id", F.when(F.col("lost"), F.lit("lost")).otherwise(F.sha2(F.encode("restored", "utf-8"), 256)).alias("restored_sha256"))
