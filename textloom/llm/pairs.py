"""Problem 2: broken prompt and response pairs."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.canonical import folded_words
from textloom.llm.common import Bounded, key, map_rows
from textloom.llm.language import FUNCTION_WORDS, Profiles, enough_words, evidence, segments
from textloom.llm.residue import Detector, is_stand_in, term_weights
from textloom.session import cut_lineage

#: Words an answer may have before or after the prompt and still be only the prompt.
INTRODUCTION = 6
#: Bytes of a compressed answer for each introducing word, and what a copy may need beyond a text
#: compressed with itself as dictionary.
WORD_BYTES, SLACK_BYTES = 8, 4
#: A shorter prompt takes as little room as a copy of it does, so its words are compared, too.
SHORT_BYTES = 40
#: Bits of the filter that lets terminal contexts through before the exact join: at most this many.
MOST_BITS = 1 << 25
#: Texts whose words are counted together.
CHUNK_TEXTS = 500

# How a refusal is put, by language. A sentence that matches one of these declines.
_REFUSALS = [
    r"\b(?:can(?:no|')t|can not|could not|couldn't|am unable|'m unable|unable to|not able to|not in a position to|do(?:n't| not) have the ability|not possible for me|impossible for me)\b(?! (?:help (?:but|\w+ing)|promise|wait|complain|stop|say enough|recall|remember|tell (?:you )?how|thank|stress|overstate|imagine)\b)",
    r"\b(?:i|we)(?: am|'m| was| were| have been|'ve been| are|'re)? (?:not (?:permitted|allowed|authori[sz]ed|comfortable|willing|prepared|going to|free|meant|supposed|at liberty|ready|inclined|disposed)|(?:told|asked|instructed) (?:not to|to (?:stay away|avoid|refuse|decline|keep away|steer clear)))",
    r"\b(?:i|we)(?: am|'m| are|'re| feel| remain)? (?:unwilling|reluctant|hesitant|disinclined|forbidden|prohibited|barred)\b",
    r"\bnot (?:something )?(?:i'm|i am|i was|we are)? ?(?:permitted|allowed|authori[sz]ed) to\b|\bisn't something (?:i|we)\b|\bis not something (?:i|we)\b",
    r"\b(?:i|we) (?:won't|will not|shall not|would not|wouldn't|do not|don't|must not|may not|should not)(?: be)? (?:\w+ )?(?:provid|writ|produc|creat|generat|assist|help|answer|continu|fulfil|compl|do |discuss|draft|compos|supply|offer|engage|respond|touch|feel comfortable)",
    r"\b(?:i|we)(?:'d| would| had|'ll| will)? ?(?:rather not|better not|prefer not|have to (?:pass|decline|refuse)|must (?:decline|refuse|pass)|decline|refuse|need to (?:decline|refuse|pass)|am declining|'m declining)\b",
    r"\b(?:policies|policy|guidelines|instructions|rules|usage terms|terms(?: of use)?|safety)\b.{0,40}\b(?:do(?:es)? not allow|don't allow|doesn't allow|prohibit\w*|forbid\w*|prevent\w*|not permit)",
    r"\b(?:against|outside|beyond|breaks?|violat\w+|contrary to|conflicts? with|not within|breach\w*|contravenes?|(?:blocked|forbidden|prohibited|ruled out|restricted|not covered|not permitted|not allowed) by|off limits)\b.{0,30}\b(?:policies|policy|guidelines|instructions|rules|terms|settings|principles|directives|restrictions|filters?|safety|what i (?:can|may|am|offer)|my (?:limits|scope|remit|role))",
    r"\b(?:wouldn't|would not|isn't|is not|not) be? ?appropriate for me\b|\bno text will follow\b|\bas an? (?:ai|language model|assistant)\b.{0,60}\b(?:not|n't|unable)\b",
    r"\b(?:kann|darf|möchte|werde|will|könnte)\b.{0,60}\b(?:nicht|kein\w*)\b.{0,50}\b(?:helfen|beantworten|verfassen|schreiben|äußern|unterstützen|erfüllen|liefern|erstellen|bearbeiten|dienen|weiterhelfen|behandeln)|\b(?:muss|möchte|lieber)\b.{0,40}\b(?:ablehnen|verzichten|passen)\b|\brichtlinien\b|\bals sprachmodell\b|\bnicht (?:erlaubt|gestattet|möglich|in der lage)\b|\b(?:leider|dabei|dazu|hierbei)\b.{0,30}\bnicht\b.{0,30}\b(?:helfen|möglich|beantworten|dienen|schreiben)\b|\b(?:lehne|weigere)\b.{0,40}\bab\b|\baußerhalb (?:dessen|meiner)\b",
    r"\bje (?:ne |n')(?:peux|suis|pourrai|souhaite|veux|vais|dois)\b.{0,20}\bpas\b|\bil m'est impossible\b|\bje (?:préfère|dois|me vois obligé de|suis contraint de) (?:décliner|refuser|ne pas|m'abstenir)|\bmes (?:règles|consignes|directives|instructions|principes)\b|\ben tant que modèle\b|\bn'est pas (?:possible|autorisé|permis)\b|\bje refuse\b|\bdépasse (?:ce que|le cadre)",
    r"\bno (?:puedo|podré|me es posible|tengo permitido|estoy autorizad\w|quiero|debo|voy a|me siento cómod\w)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|negarme|abstenerme|no )|\bmis (?:normas|reglas|políticas|directrices|instrucciones|pautas)\b|\bcomo modelo de lenguaje\b|\bfuera de lo que (?:puedo|debo)\b|\bme niego\b|\bno es posible (?:para mí|responder|atender)",
    r"\bnon (?:posso|mi è possibile|sono (?:in grado|autorizzat\w)|voglio|devo|intendo|mi è permesso)\b|\b(?:devo|preferisco) (?:rifiutare|declinare|astenermi|non )|\ble mie (?:regole|linee guida|istruzioni|norme)\b|\bcome modello linguistico\b|\bmi rifiuto\b",
    r"\bnão (?:posso|me é possível|consigo|estou autorizad\w|quero|devo|vou|tenho permissão)\b|\b(?:devo|tenho de|tenho que|prefiro) (?:recusar|declinar|abster|não )|\bminhas (?:regras|diretrizes|instruções|políticas)\b|\bcomo modelo de linguagem\b|\brecuso-me\b",
    r"\b(?:kan|mag|wil|zal)\b.{0,40}\bniet\b.{0,40}\b(?:helpen|beantwoorden|schrijven|leveren|voldoen|bespreken)|\b(?:moet|wil)\b.{0,30}\b(?:weigeren|afwijzen|bedanken)\b|\bmijn (?:richtlijnen|regels|instructies)\b|\bals taalmodel\b|\bniet (?:toegestaan|mogelijk|in staat)\b",
]
# Sentences that may go with a refusal.
_CLOSINGS = [
    r"^(?:i'm|i am|we are|we're)? ?(?:very |so |truly )?(?:sorry|apolog\w+|unfortunately|regrettably|no|sorry no)\b.{0,40}$",
    r"\bthank(?:s| you)\b|\blet me know\b|\binstead\b|\banything else\b|\bsomething else\b|\bhelp (?:you )?with\b|\bi hope\b|\bplease (?:try|ask|choose|contact|consult|rephrase)\b|\bfeel free\b|\bhappy to\b|\bglad to\b|\banother (?:source|request|topic|question|\w+)\b|\bharmful\b|\bunderstand\w*\b|\bgood luck\b",
    r"\bes tut mir leid\b|\bleider\b|\bdanke\b|\bvielen dank\b|\bverständnis\b|\bkann ich sonst\b|\betwas anderes\b|\bgern(?:e)?\b|\bstattdessen\b",
    r"\bdésolée?\b|\bmerci\b|\bautre chose\b|\bpuis-je\b|\bvolontiers\b|\bmalheureusement\b|\bplutôt\b",
    r"\blo siento\b|\bgracias\b|\blamentablemente\b|\balgo más\b|\botra cosa\b|\bdisculp\w+\b|\bayudar\w* en\b",
    r"\bmi dispiace\b|\bgrazie\b|\bpurtroppo\b|\bqualcos'altro\b|\baltro\b|\blamento\b|\bobrigad[oa]\b|\binfelizmente\b|\boutra coisa\b|\bhet spijt me\b|\bbedankt\b|\bhelaas\b|\biets anders\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in _REFUSALS), re.IGNORECASE)
_CLOSING = re.compile("|".join(f"(?:{p})" for p in _CLOSINGS), re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?…\n]+(?:[.!?…]+|\n|$)")

# How a prompt names a language for the answer.
_NAMED = {
    "en": r"in english|auf englisch|en anglais|en inglés|in inglese|em inglês|in het engels",
    "de": r"in german|auf deutsch|en allemand|en alemán|in tedesco|em alemão|in het duits",
    "fr": r"in french|auf französisch|en français|en francés|in francese|em francês|in het frans",
    "es": r"in spanish|auf spanisch|en espagnol|en español|in spagnolo|em espanhol|in het spaans",
    "it": r"in italian|auf italienisch|en italien|en italiano|in italiano|em italiano|in het italiaans",
    "pt": r"in portuguese|auf portugiesisch|en portugais|en portugués|in portoghese|em português|in het portugees",
    "nl": r"in dutch|auf niederländisch|en néerlandais|en neerlandés|en holandés|in olandese|em holandês|in het nederlands",
}
_ASKED = re.compile("|".join(rf"(?P<{k}>\b(?:{v})\b)" for k, v in _NAMED.items()), re.IGNORECASE)


def refuses(text: str) -> bool:
    """Whether the whole answer declines: its sentences decline or go with that, and one declines."""
    most = 8 if len(text.split()) > 8 else 3
    found, rest = False, 0
    for m in _SENTENCE.finditer(text.replace("’", "'")):
        s = m[0].strip()
        n = len(s.split())
        if not any(c.isalnum() for c in s):
            continue
        if _REFUSAL.search(s):
            found = True
        elif n > 25 or not _CLOSING.search(s):
            rest += n
            if rest > most:
                return False
    return found


_DICTIONARIES = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}


class CopyCheck:
    """Finds answers that are only the prompt, by zstandard with a raw dictionary, on the folded words:
    with the prompt as dictionary, the answer takes no more room than the matches and a few
    introducing words; with the answer as dictionary, the prompt takes no more than the matches."""

    def __init__(self, limit: int = 5_000):
        self.ready: Bounded = Bounded(limit)

    @staticmethod
    def compressor(dictionary: str):
        import zstandard as z

        d = z.ZstdCompressionDict(dictionary.encode() or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
        return z.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, prompt: str, answer: str) -> bool:
        got = self.ready.get(prompt)
        if got is None:
            words = folded_words(prompt)
            bare = " ".join(words)
            c = self.compressor(bare)
            got = self.ready.put(prompt, (words, bare, c, len(c.compress(bare.encode()))))
        words, bare, compressor, least = got
        # An answer with more words than the prompt and an introduction says something of its own.
        if not words or enough_words(answer, 2 * (len(words) + INTRODUCTION) + 1):
            return False
        own = folded_words(answer)
        if not own or len(own) > len(words) + INTRODUCTION:
            return False
        text = " ".join(own)
        if len(compressor.compress(text.encode())) > least + WORD_BYTES * INTRODUCTION:
            return False
        if len(self.compressor(text).compress(bare.encode())) > least + SLACK_BYTES:
            return False
        return len(bare) >= SHORT_BYTES or any(own[k : k + len(words)] == words for k in range(len(own) - len(words) + 1))


_LAST_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDS = ".!?…。"
_CLOSERS = "\"'”’»)]}*_`~ \t\r\n ​‌‍﻿"


#: A last line of at most so many pieces is looked up as a whole.
LINE_PIECES = 6


#: What an unmarked end is judged by.
ROLES = ("one", "last", "pair", "close", "line")


def terminal_contexts(text: str) -> tuple[str | None, ...]:
    """Of the text's end, in the order of ``ROLES``: the last word, that as the end of a text, the last pair
    of words, that as the end of a text, and the last line if it is short."""
    s = text.casefold().rstrip(_CLOSERS)
    words = _LAST_WORDS.findall(s)
    w = words[-1]
    pair = f"{words[-2]} {w}" if len(words) > 1 else None
    pieces = s.rsplit("\n", 1)[-1].split()
    line = f"$$ {' '.join(pieces)}" if "\n" in s and len(pieces) <= LINE_PIECES else None
    return w, f"$ {w}", pair, pair and f"$ {pair}", line


_SPLIT = re.compile(rf"({_LAST_WORDS.pattern})")


class Contexts:
    """Counts the contexts of texts that a bitmap over the hashes of the wanted ones lets through; it may
    let others through, and never keeps one out."""

    def __init__(self, bits: np.ndarray, n: int, limit: int = 400_000):
        self.bits, self.mask, self.limit = bits.tobytes(), n - 1, limit
        self.seen: set[str] = set()
        self.yes: set[str] = set()
        self.separators = Separators()

    def wanted(self, contexts: list[str]) -> set[str]:
        """The set of all wanted contexts met so far; of these, it has all that are wanted."""
        if len(self.seen) > self.limit:
            self.seen, self.yes = set(), set()
        new = set(contexts) - self.seen
        self.seen |= new
        for c in new:
            h = crc32(c.encode()) & self.mask
            if self.bits[h >> 3] >> (h & 7) & 1:
                self.yes.add(c)
        return self.yes

    def add(self, texts: list[str], ends: Counter, on: Counter) -> list[tuple[int, str]]:
        """Adds the texts' contexts to those after which something ends or goes on: each word and pair, and each line's
        first pieces. Returns those at the very end of a text, with its number, if no mark follows: it may be a cut."""
        words: list[str] = []
        after: list[str] = []
        starts, opens, final = [], [], []
        for number, text in enumerate(texts):
            folded = text.casefold()
            parts = _SPLIT.split(folded)
            if len(parts) > 1:
                starts.append(len(words))
                words += parts[1::2]
                after += parts[2::2]
                if not parts[-1].strip(_CLOSERS):
                    opens.append(len(words) - 1)
                    final.append((number, f"$ {parts[-2]}"))
                    if len(parts) > 3:
                        final.append((number, f"$ {parts[-4]} {parts[-2]}"))
            lines = folded.rstrip(_CLOSERS).split("\n")
            for k, line in enumerate(lines[1:], 1):
                pieces = line.split()
                start = "$$"
                for n, piece in enumerate(pieces[:LINE_PIECES], 1):
                    start += " " + piece
                    if start not in self.yes and (start in self.seen or start not in self.wanted((start,))):
                        break  # the filter has each beginning of a wanted line
                    if n < len(pieces):
                        on[start] += 1
                    elif k < len(lines) - 1:
                        ends[start] += 1
                    else:
                        final.append((number, start))
        if words:
            codes, known = pd.factorize(np.array(words, dtype=object))
            stop = np.fromiter(map(self.separators.__getitem__, after), dtype=bool, count=len(after))
            told = np.ones(len(words), dtype=bool)
            told[opens] = False  # the fate of a last word is known only where a mark follows it
            self.count(known.tolist(), codes[told], stop[told], ends, on)
            follows = told.copy()
            follows[starts] = False
            at = np.flatnonzero(follows)
            keys, place = np.unique(codes[at - 1].astype(np.int64) * len(known) + codes[at], return_inverse=True)
            a, b = np.divmod(keys, len(known))
            self.count([f"{x} {y}" for x, y in zip(known[a].tolist(), known[b].tolist())], place, stop[at], ends, on)
        yes = self.wanted([c for _, c in final])
        return [(number, c) for number, c in final if c in yes]

    def count(self, contexts: list[str], codes: np.ndarray, stop: np.ndarray, ends: Counter, on: Counter) -> None:
        """Adds how often each of the contexts, by their places in ``codes``, ends something and goes on."""
        yes = self.wanted(contexts)
        stopped = np.bincount(codes[stop], minlength=len(contexts)).tolist()
        went = np.bincount(codes[~stop], minlength=len(contexts)).tolist()
        for c, x, y in zip(contexts, stopped, went):
            if c in yes:
                if x:
                    ends[c] += x
                if y:
                    on[c] += y


class Separators(dict):
    """Whether a sentence or line ends with what stands between two words."""

    def __missing__(self, separator: str) -> bool:
        if len(self) > 10_000:
            self.clear()
        got = self[separator] = separator[:1] in (".", "!", "?", "…") or "\n" in separator[:2] or "\r" in separator[:2]
        return got


def context_filter(wanted: DataFrame) -> tuple[np.ndarray, int]:
    """The bitmap of the contexts in ``wanted`` and its number of bits, at most ``MOST_BITS``; the
    driver gets a row per 32 bits of it."""
    n = 1 << 10
    size = wanted.count()
    while n < min(16 * size, MOST_BITS):
        n *= 2
    h = F.crc32(F.encode("context", "utf-8")).bitwiseAND(F.lit(n - 1))
    rows = wanted.select(h.alias("h")).groupBy(F.shiftright("h", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("b")).toPandas()
    words = np.zeros(n // 32, dtype="<u4")
    words[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).astype("<u4")
    return words, n


def beginnings(wanted: DataFrame) -> DataFrame:
    """The contexts, and each beginning of those that are lines."""
    pieces = F.split("context", " ")
    parts = F.when(F.col("context").startswith("$$ "), F.transform(F.sequence(F.lit(2), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), " "))).otherwise(F.array("context"))
    return wanted.select(F.explode(parts).alias("context")).distinct()


def context_counts(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(context, ends, goes_on)`` of the wanted contexts over all records, counted in each task before
    the shuffle. Texts that end so without a mark count once however many copies they have."""
    shared = records.sparkSession.sparkContext.broadcast(context_filter(cut_lineage(beginnings(wanted))))  # bounded by MOST_BITS

    def make():
        from xxhash import xxh64_intdigest

        contexts = Contexts(*shared.value)

        def work(texts):
            ends, on, final = Counter(), Counter(), set()
            for k in range(0, len(texts), CHUNK_TEXTS):
                part = texts[k : k + CHUNK_TEXTS]
                final.update((c, xxh64_intdigest(part[number]) - (1 << 63)) for number, c in contexts.add(part, ends, on))
            both = list(ends | on)
            n = len(final)
            return both + [c for c, _ in final], [None] * len(both) + [h for _, h in final], [ends[c] for c in both] + [1] * n, [on[c] for c in both] + [0] * n

        return work

    rows = map_rows(records.where("text is not null"), ["text"], make, "context string, h bigint, ends bigint, goes_on bigint")
    rows = rows.groupBy("context", "h").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    rows = rows.groupBy("context").agg(F.sum(F.when(F.col("h").isNull(), F.col("ends")).otherwise(F.lit(1))).alias("ends"), F.sum("goes_on").alias("goes_on"))
    return rows.join(wanted, "context", "left_semi")


#: An end is a cut where sentences, lines or texts end so in less than this share of cases.
LEAST_SHARE = 0.3
#: After a word that ends a sentence or text in fewer cases than this, no text is finished, however
#: many others end with the same pair.
WORD_SHARE = 0.02


def cut_off(open_: DataFrame, records: DataFrame) -> DataFrame:
    """``(record_id)`` of the rows ``(record_id, *ROLES)`` of ``open_`` whose end is a cut, by how the same
    contexts go on in all records."""
    long = open_.select("record_id", F.explode(F.array(*(F.struct(F.lit(k).alias("role"), F.col(k).alias("context")) for k in ROLES))).alias("x")).select("record_id", "x.*").where("context is not null")
    counts = context_counts(records, cut_lineage(long.select("context").distinct()))
    got = long.join(counts, "context", "left")
    pick = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    g = got.groupBy("record_id").agg(*(pick(k, c).alias(f"{k}_{c}") for k in ROLES for c in ("ends", "goes_on")))
    word = (F.col("one_ends") + 0.5) / (F.col("one_ends") + F.col("one_goes_on") + 2)  # a word that never ends a sentence, or no known word
    others = F.greatest(F.col("last_ends") - 1, F.lit(0))
    may_end = (F.col("one_ends") + others + 0.5) / (F.col("one_ends") + others + F.col("one_goes_on") + 2) >= WORD_SHARE
    # Texts that end with the pair, but the one in question, if they are several.
    closes = F.when(may_end & (F.col("close_ends") > 2), F.col("close_ends") - 1).otherwise(0)
    ends, on = F.col("pair_ends") + closes, F.col("pair_goes_on")
    share = F.when(ends + on > 0, (ends + 2 * word) / (ends + on + 2)).otherwise(word)
    # Several texts or paragraphs have this line, and it seldom goes on.
    common = may_end & (F.col("line_ends") > 2) & (F.col("line_ends") - 1 > F.col("line_goes_on"))
    return g.where(~common & (share < LEAST_SHARE)).select("record_id")


def _unbalanced(text: str) -> bool:
    depth = Counter()
    for c in text:
        if c in "([{":
            depth[c] += 1
        elif c in ")]}":
            depth[{")": "(", "]": "[", "}": "{"}[c]] -= 1
    return any(v > 0 for v in depth.values())


def code_breaks_off(text: str) -> bool:
    """Whether code ends inside a bracket or literal, after an operator or head, or within a name."""
    bare = re.sub(r"\"\"\".*?\"\"\"|'''.*?'''|/\*.*?\*/", "x", text, flags=re.DOTALL)
    bare = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", "x", bare)
    bare = re.sub(r"(?m)(?<!:)(?://|#).*$", "", bare).rstrip()
    if not bare:
        return False
    if _unbalanced(bare) or "\"\"\"" in bare or bare[-1] in ",([{=+-*/%&|.:<\\\"'`" and not bare.endswith(("++", "--", "*/")):
        return True
    last = re.search(r"[A-Za-z_]\w*$", bare)
    if last:
        names = Counter(re.findall(r"[A-Za-z_]\w*", text))
        w = last[0]
        return names[w] == 1 and len(w) > 1 and any(n != w and n.startswith(w) for n in names)
    return False


def looks_like_code(text: str) -> bool:
    return bool(re.search(r"(?m)^\s*(?:def |class |function |const |let |import |return\b|for \()|[{};]\s*$|=>", text))


def breaks_off(text: str, code: bool) -> bool | None:
    """Whether the text stops unfinished; None if only its terminal contexts can tell."""
    if code and looks_like_code(text):
        return code_breaks_off(text)
    s = text.rstrip(_CLOSERS)
    if not s:
        return False
    line = s.rsplit("\n", 1)[-1].strip(" \t->*•#")
    if re.fullmatch(r"\(?(?:\d{1,3}|[a-zA-Z])[.)]?", line) and "\n" in s:
        return True  # the number of a list's next item, without the item
    if s[-1] in _ENDS:
        return False
    full = text.rstrip()
    if full[-1] in ")]}" and not _unbalanced(full):
        return False
    if full[-1] in "\"'”»*_`" and s[-1].isalnum() and not _unbalanced(full):
        return False
    if not s[-1].isalnum():
        return s[-1] in ",;:([{-–—&/+=<\\“„«" and s[-2:] != "--"
    if re.match(r"[^:\n]{1,40}:\s*\S", line) and "\n" in s and re.match(r"[^:\n]{1,40}:", s.rsplit("\n", 2)[-2].strip()):
        return False  # the last of a list of fields
    if re.search(r"\n[ \t>]*\r?\n[^\n]{2,40}\r?\n[^\n]{2,40}$", s) and len(line.split()) <= 5:
        above = s.rsplit("\n", 2)[-2].strip()
        if len(above.split()) <= 4 and (above[-1:] == "," or above[-1:].isalpha()):
            return False  # a letter's close and signature
    return None if _LAST_WORDS.search(s) else False


def asked_language(prompt: str, profiles: Profiles) -> str | None:
    """The language that the prompt names, else its own."""
    m = None
    for m in _ASKED.finditer(prompt):
        pass
    return m.lastgroup if m else profiles.language(prompt)[0]


class Judge:
    """Names the defect of an answer."""

    def __init__(self, profiles: Profiles):
        self.profiles, self.copied, self.asked = profiles, CopyCheck(), Bounded(5_000)

    def foreign(self, prompt: str, text: str) -> bool:
        wanted = self.asked.get(prompt)
        if wanted is None:
            wanted = self.asked.put(prompt, asked_language(prompt, self.profiles) or "")
        if not wanted:
            return False
        # Where the dictionary of function words is plain, the profiles aren't needed.
        words = set(text.lower().split())
        hits = {k: len(words & v) for k, v in _DICTIONARIES.items()}
        own = hits.pop(wanted, 0)
        if own >= 4 and own > 1.5 * max(hits.values()):
            return False
        _, scores = evidence(self.profiles, [text])
        return scores[:, -1].sum() >= 4 and all(k != wanted for _, _, k in segments(self.profiles, scores))

    def defect(self, prompt: str, text: str | None, code: bool) -> str | None:
        """The defect, ``open`` where the terminal contexts must tell whether the text is cut off, or None."""
        if is_stand_in(text):
            return "empty"
        if prompt and self.copied(prompt, text):
            return "copy"
        if refuses(text):
            return "refusal"
        if not code and prompt and self.foreign(prompt, text):
            return "other_language"
        return {True: "truncated", False: None, None: "open"}[breaks_off(text, code)]


def find_defects(records: DataFrame, prompts: DataFrame, profiles: Profiles, keep_residue: bool = False) -> DataFrame:
    """``(record_id, defect)`` of each answer to a prompt of ``prompts`` that is ``empty``, a ``copy`` of
    the prompt, a ``refusal``, in an ``other_language`` or ``truncated``: the first of these that holds.

    Records with residue (problem 4) are left out unless ``keep_residue``. Prompt ids are compared
    without outer blanks and case; null ids and ids that ``prompts`` lacks have no rows; of an id
    that is there twice, the smaller prompt text counts. A null prompt text can't be copied and
    asks for no language. Texts go through whole; a record delivered twice counts once. The table
    of prompts is joined as Spark sees fit: it goes to all tasks only below the session's threshold.
    What an unmarked end means is told by how all records go on after the same words, see ``cut_off``.
    """
    idf, unknown = ({}, 1.0) if keep_residue else term_weights(records)
    p = prompts.select(key("prompt_id").alias("pk"), F.coalesce("prompt", F.lit("")).alias("prompt")).where("pk is not null").groupBy("pk").agg(F.min("prompt").alias("prompt"))
    r = records.where("record_id is not null").select("record_id", "text", "kind", key("prompt_id").alias("pk")).join(p, "pk").select("record_id", "text", "kind", "prompt")
    shared = records.sparkSession.sparkContext.broadcast(profiles)  # a few hundred n-grams per language

    def make():
        judge, residue = Judge(shared.value), None if keep_residue else Detector(idf, unknown)

        def work(ids, texts, kinds, asked):
            out: list[list] = [[] for _ in range(2 + len(ROLES))]
            for i, t, k, q in zip(ids, texts, kinds, asked):
                d = judge.defect(q, t, k == "code")
                if d and not (residue and residue.kind(t, k == "code")):
                    contexts = terminal_contexts(t) if d == "open" else (None,) * len(ROLES)
                    for column, v in zip(out, (i, d, *contexts)):
                        column.append(v)
            return out

        return work

    judged = map_rows(r, r.columns, make, ", ".join(["record_id bigint", "defect string", *(f"{k} string" for k in ROLES)]))
    judged = cut_lineage(judged.dropDuplicates(["record_id"]))
    cut = cut_off(judged.where("defect = 'open'").drop("defect"), records)
    return judged.where("defect <> 'open'").select("record_id", "defect").union(cut.select("record_id", F.lit("truncated")))
