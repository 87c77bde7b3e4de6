"""Problem 7: missing or wrong document language labels."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import WORD, key, map_rows, only_ids
from textloom.session import cut_lineage

#: Profiles are fitted on about this many labelled texts, picked by a hash of their id.
SAMPLE_ROWS = 20_000
#: N-grams in a language's profile, and of a text that are ranked against it.
PROFILE, RANKED = 500, 400
#: Words whose evidence a task keeps.
MOST_WORDS = 300_000
MIN_WORDS = 12

# Frequent function words of each language, the first text of its profile.
FUNCTION_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they be at one have this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now people my made over did down only way find use may after off such every because whether yet still nobody somebody neither nor",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei wenn ihre wir ich doch weil kein keine unter wer danach niemand seit gegen trotzdem warum",
    "fr": "le la les de des du et un une en est que qui dans pour pas sur au aux par plus ne se ce il elle nous vous ils sont avec été mais ou où comme son sa ses leur leurs tout tous même cette ces fait être avoir on je tu était avait deux aussi bien peut sans entre quand très ce dont après chez personne lequel pourquoi",
    "es": "el la los las de del y que en un una por con no se es para al lo como más su sus le les o pero sí si ya está están fue ha han hay porque cuando muy sin sobre también me hasta desde todo nos durante todos uno ni contra ese eso ante ellos esto mí antes algunos qué unos yo otro nadie quién aunque tras después hemos",
    "pt": "o a os as de do da dos das e que em um uma por com não se é para ao no na nos nas como mais seu sua seus ou mas foi ser são está tem há porque quando muito sem sobre também me até desde isso este esta nós eu ele ela eles lhe já só depois mesmo pelo pela pelos quem nem entre era tudo embora ninguém ainda",
    "it": "il lo la i gli le di del della dei e che in un una per con non si è da al alla nel nella come più suo sua sono o ma anche ha questo questa ci mi ti se era stato essere tutto molto dopo senza sopra sotto fra tra quando perché dove chi cui loro noi voi io lui lei ancora già nessuno fosse sia degli delle sul sulla dal dalla",
    "nl": "de het een van en in is dat op te zijn met voor niet aan er om ook als bij of maar uit nog naar dan wordt door over ze hij zij wij ik je die dit deze was werd heeft hebben had geen meer kan zou tot wel onder want omdat toen waar wie wat hoe al zich haar hun ons tegen na zonder iets niets niemand hoewel toch",
}
LANGUAGES = tuple(FUNCTION_WORDS)

# Words of a label for no known language.
_UNKNOWN = "und unknown n/a na none null mis mul zxx xx ? ?? - unk undefined undetermined undetected other auto"
# Other ways to name the languages in a label.
_NAMES = {
    "en": "eng english englisch anglais inglés inglese inglês engels",
    "de": "deu ger german deutsch allemand alemán tedesco alemão duits",
    "fr": "fra fre french französisch français francés francese francês frans",
    "es": "spa spanish spanisch espagnol español castellano spagnolo espanhol spaans",
    "it": "ita italian italienisch italien italiano italiaans",
    "pt": "por portuguese portugiesisch portugais portugués português portoghese portugees",
    "nl": "nld dut dutch niederländisch néerlandais neerlandés nederlands olandese holandês holandés",
}

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A sentence ends at a line break, or with a piece of text between blanks that ends like this.
_ENDS_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*$")
_PIECE = re.compile(r"\S+")


def label_language(column: str | Column) -> Column:
    """The language a label names: its part before region and script; null for no label or a word
    for unknown."""
    k = F.element_at(F.split(key(column), r"[-_\s(;,]"), 1)
    names = F.create_map(*(F.lit(x) for code, words in _NAMES.items() for w in words.split() for x in (w, code)))
    unknown = F.create_map(*(x for w in _UNKNOWN.split() for x in (F.lit(w), F.lit(None).cast("string"))))
    return F.when(~F.map_contains_key(unknown, F.coalesce(k, F.lit("null"))), F.coalesce(F.try_element_at(names, k), k))


def grams(word: str) -> list[str]:
    """N-grams of one to five characters of a padded word, lower case."""
    w = f"_{word}_"
    return [w[i : i + n] for n in range(1, 6) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


def profile(counts: Counter) -> list[str]:
    """The most frequent n-grams, by rank; ties in the order of the n-grams."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]]


def seed_counts() -> dict[str, Counter]:
    return {k: Counter(g for w in v.split() for g in grams(w)) for k, v in FUNCTION_WORDS.items()}


class Profiles:
    """Rank-order profiles of the languages; distances of texts to them."""

    def __init__(self, ranked: dict[str, list[str]]):
        self.languages = sorted(ranked)
        self.ids: dict[str, int] = {}
        for grams_ in ranked.values():
            for g in grams_:
                self.ids.setdefault(g, len(self.ids))
        self.rank = np.full((len(self.ids), len(self.languages)), PROFILE, dtype=np.float64)
        for j, k in enumerate(self.languages):
            for r, g in enumerate(ranked[k]):
                self.rank[self.ids[g], j] = r
        # What a single occurrence says for each language: the closer to the top of its profile,
        # the more; n-grams as frequent in all languages say nothing.
        w = np.log((PROFILE + 10) / (self.rank + 10))
        self.weight = w - w.mean(axis=1, keepdims=True)
        self.restart()

    def restart(self) -> None:
        self.words: dict[str, int] = {}
        self.ids_of: list[np.ndarray] = []
        self.table = np.zeros((1024, len(self.languages) + 1))
        self.ends = np.zeros(1024, dtype=bool)
        self.places = np.arange(RANKED)[:, None]

    def __getstate__(self):
        return self.languages, self.ids, self.rank, self.weight

    def __setstate__(self, state):
        self.languages, self.ids, self.rank, self.weight = state
        self.restart()

    def piece(self, w: str) -> int:
        """The row, for a piece of text between blanks, of ``table``, which holds what its words say
        for each language and their number, and of ``ends``: whether it ends a sentence."""
        k = self.words.get(w)
        if k is None:
            k = self.words[w] = len(self.ids_of)
            words = _WORD.findall(w)
            i = np.array([self.ids[g] for x in words for g in grams(x.lower()) if g in self.ids], dtype=np.int32)
            self.ids_of.append(i)
            if k >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.table[k, :-1] = self.weight[i].sum(axis=0)
            self.table[k, -1] = len(words)
            self.ends[k] = _ENDS_SENTENCE.search(w) is not None
        return k

    def out_of_place(self, text: str) -> np.ndarray:
        """Per language, the mean distance between the rank of each of the text's most frequent
        n-grams and its rank in the profile, as a share of the largest possible."""
        known, ids_of, piece = self.words.get, self.ids_of, self.piece
        got = [ids_of[k if (k := known(w)) is not None else piece(w)] for w in text.split()]
        ids = np.concatenate(got) if got else ()
        if not len(ids):
            return np.ones(len(self.languages))
        # Counts and, among equal ones, smaller ids first, as one key.
        n = len(self.ids)
        order = np.bincount(ids, minlength=n) * n - np.arange(n)
        top = np.flatnonzero(order > 0) if n <= RANKED else np.argpartition(-order, RANKED - 1)[:RANKED]
        top = top[np.argsort(-order[top])]
        top = top[order[top] > 0]
        return np.minimum(np.abs(self.rank[top] - self.places[: len(top)]), PROFILE).mean(axis=0) / PROFILE

    def language(self, text: str) -> tuple[str | None, float]:
        """Nearest language and a confidence from the distances of the others; None for no words."""
        d = self.out_of_place(text)
        if d.min() >= 1:
            return None, 0.0
        e = np.exp(-40 * (d - d.min()))
        return self.languages[int(d.argmin())], float(1 / e.sum())


def evidence(p: Profiles, texts: list[str]) -> tuple[list[int], np.ndarray]:
    """Where each text's sentences begin in the result, and for all sentences of the batch, in
    order, what their words say for each language and, last, their number of words."""
    if len(p.words) > MOST_WORDS:
        p.restart()
    rows: list[int] = []
    stops: list[int] = []  # a line ends after so many pieces
    texts_at = []
    known, piece = p.words.get, p.piece
    for t in texts:
        texts_at.append(len(rows))
        for line in t.splitlines():
            rows += [k if (k := known(w)) is not None else piece(w) for w in line.split()]
            stops.append(len(rows))
    texts_at.append(len(rows))
    if not rows:
        return [0] * (len(texts) + 1), np.zeros((0, len(p.languages) + 1))
    r = np.array(rows, dtype=np.int64)
    end = p.ends[r]
    s = np.array(stops, dtype=np.int64)
    end[s[s > 0] - 1] = True
    bounds = np.concatenate([[0], np.flatnonzero(end) + 1])
    total = np.vstack([np.zeros(p.table.shape[1]), np.cumsum(p.table[r], axis=0)])
    return np.searchsorted(bounds, texts_at).tolist(), np.diff(total[bounds], axis=0)


def sentence_spans(p: Profiles, text: str) -> list[tuple[int, int]]:
    """Character spans of the sentences that ``evidence`` counts, each with the blanks after it."""
    starts, after = [], True
    last = 0
    for m in _PIECE.finditer(text):
        if after or len(text[last : m.start()].splitlines()) > 1 or text[last : m.start()].endswith(("\n", "\r")):
            starts.append(m.start())
        after, last = bool(p.ends[p.piece(m[0])]), m.end()
    starts[:1] = [0] if starts else []
    return list(zip(starts, [*starts[1:], len(text)]))


def segments(p: Profiles, scores: np.ndarray, least_words: int = 4, switch: float = 6.0, odds: float = 0.35) -> list[tuple[int, int, str]]:
    """Stretches ``(first sentence, end, language)`` of sentences that seem to be in one language.

    The best course of languages through the sentences (Viterbi): a sentence counts for a language
    by its words, a change costs ``switch``, and a sentence of fewer than ``least_words`` words,
    such as a greeting or a name, never changes the language.
    """
    if not len(scores):
        return []
    words, scores = scores[:, -1], scores[:, :-1]
    # Long sentences that all say the same need no search.
    full = words >= least_words
    told = set(scores[full].argmax(axis=1).tolist()) or {int(scores.sum(axis=0).argmax())}
    if len(told) == 1:
        return [(0, len(scores), p.languages[told.pop()])]
    n = scores.shape[1]
    cost, back = np.zeros(n), []
    for long, s in zip(full, scores):
        change = cost.max() - (switch if long else 1e9)
        stay = cost >= change
        back.append(np.where(stay, np.arange(n), int(cost.argmax())))
        cost = np.where(stay, cost, change) + s * (1.0 if long else odds)
    j, path = int(cost.argmax()), []
    for b in reversed(back):
        path.append(j)
        j = int(b[j])
    path.reverse()
    cuts = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)]
    return [(a, b, p.languages[path[a]]) for a, b in zip(cuts, cuts[1:])]


def stretches(p: Profiles, text: str, course: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """``(char start, end, language, confidence)`` of the text's stretches: each part of the ``course`` is
    in the language whose profile is nearest by out-of-place distance; neighbours in one language
    are one stretch. A part without n-grams of any profile keeps what the course says."""
    if len(course) == 1:
        cuts = [(0, len(text), course[0][2])]
    else:
        spans = sentence_spans(p, text)
        cuts = [(spans[a][0], spans[b - 1][1], k) for a, b, k in course]
    out: list[tuple[int, int, str, float]] = []
    for a, b, k in cuts:
        got, sure = p.language(text[a:b])
        while out and out[-1][2] == (got or k):
            a = out.pop()[0]
            got, sure = p.language(text[a:b])
        out.append((a, b, got or k, sure))
    return out


def fit_profiles(records: DataFrame, diagnostics: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 2) -> Profiles:
    """Profiles of the languages from the function words and about ``sample_rows`` records of kind
    text, picked by a hash of their id: first by their labels, then by the language that the first
    profiles give them, which takes wrong labels out. The driver gets the profiles only."""
    n = records.count()
    picked = F.pmod(F.xxhash64(F.lit(7), "record_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample_rows / max(n, 1))))
    labels = diagnostics.where(picked).select("record_id", label_language("language").alias("label")).where(F.col("label").isin(*LANGUAGES)).groupBy("record_id").agg(F.min("label").alias("label"))
    texts = cut_lineage(records.where(picked & (F.coalesce("kind", F.lit("text")) == "text") & F.col("text").isNotNull()).select("record_id", "text").dropDuplicates(["record_id"]).join(labels, "record_id").select("text", "label"))  # bounded, and read once per round
    seeds = seed_counts()
    found = None
    for _ in range(rounds):
        before = found

        def make(before=before):
            def work(ts, ls):
                words: dict[str, Counter] = {}
                for t, label in zip(ts, ls):
                    k = before.language(t)[0] if before else label
                    if k:
                        words.setdefault(k, Counter()).update(_WORD.findall(t.lower()))
                out: Counter = Counter()
                for k, ws in words.items():
                    for w, c in ws.items():
                        for g in grams(w):
                            out[k, g] += c
                return [k for k, _ in out], [g for _, g in out], list(out.values())

            return work

        counted = map_rows(texts, ["text", "label"], make, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
        seeded = counted.sparkSession.createDataFrame([(k, g, c) for k, v in seeds.items() for g, c in v.items()], "language string, gram string, n bigint")
        counted = counted.union(seeded).groupBy("language", "gram").agg(F.sum("n").alias("n"))
        top = counted.withColumn("r", F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= PROFILE)
        ranked: dict[str, list] = {}
        for r in top.collect():
            ranked.setdefault(r["language"], []).append((r["r"], r["gram"]))
        found = Profiles({k: [g for _, g in sorted(v)] for k, v in ranked.items()})
    return found


def _texts(records: DataFrame) -> DataFrame:
    return records.where((F.coalesce("kind", F.lit("text")) == "text") & F.col("record_id").isNotNull() & F.col("text").isNotNull()).select("record_id", "text")


def main_languages(records: DataFrame, profiles: Profiles, min_words: int = MIN_WORDS) -> DataFrame:
    """``(record_id, n_segments, language)``, the language null where a text mixes several: a first
    look at each record of kind text with at least ``min_words`` words."""
    shared = records.sparkSession.sparkContext.broadcast(profiles)  # a few hundred n-grams per language

    def make():
        p = shared.value

        def work(ids, texts):
            at, scores = evidence(p, texts)
            out: list[list] = [[], [], []]
            for rid, t, a, b in zip(ids, texts, at, at[1:]):
                if enough_words(t, min_words):
                    found = stretches(p, t, segments(p, scores[a:b]))
                    for column, v in zip(out, (rid, len(found), found[0][2] if len(found) == 1 else None)):
                        column.append(v)
            return out

        return work

    return map_rows(_texts(records), ["record_id", "text"], make, "record_id bigint, n_segments int, language string").dropDuplicates(["record_id"])


def language_segments(records: DataFrame, profiles: Profiles, min_words: int = MIN_WORDS, keep=None) -> DataFrame:
    """``(record_id, segment_no, n_segments, language, confidence, char_start, char_end)``: the maximal
    stretches of consecutive sentences in one language of each record of kind text with at least
    ``min_words`` words. Language and confidence come from the out-of-place distances of the
    stretch's most frequent n-grams to the profiles; where a text may change its language is found
    by the sums of ``segments``. Null, short and code texts have no rows; a record delivered twice
    counts once. ``keep()``, made once per task, may turn texts down."""
    shared = records.sparkSession.sparkContext.broadcast(profiles)  # a few hundred n-grams per language

    def make():
        p, keeps = shared.value, keep() if keep else None

        def work(ids, texts):
            out: list[list] = [[] for _ in range(7)]
            at, scores = evidence(p, texts)
            for rid, t, x, y in zip(ids, texts, at, at[1:]):
                if not enough_words(t, min_words) or keeps and not keeps(t):
                    continue
                found = stretches(p, t, segments(p, scores[x:y]))
                for no, (start, end, language, sure) in enumerate(found, 1):
                    for column, v in zip(out, (rid, no, len(found), language, sure, start, end)):
                        column.append(v)
            return out

        return work

    got = map_rows(_texts(records), ["record_id", "text"], make, "record_id bigint, segment_no int, n_segments int, language string, confidence double, char_start int, char_end int")
    return got.dropDuplicates(["record_id", "segment_no"])


def enough_words(text: str, n: int) -> bool:
    k = 0
    for _ in WORD.finditer(text):
        k += 1
        if k >= n:
            return True
    return False


def relabelled(records: DataFrame, diagnostics: DataFrame, profiles: Profiles, min_words: int = MIN_WORDS, keep=None) -> DataFrame:
    """The segments of the records whose label is missing, names another language than the text's,
    or whose text mixes languages, with the ``label`` as given. A label's case and region are no
    matter; a record without a row in ``diagnostics`` has no label, and of several labels one is
    right if any is. ``keep()`` as in ``language_segments``."""
    labels = diagnostics.select("record_id", F.col("language").alias("label"), label_language("language").alias("named")).where("record_id is not null")
    labels = labels.groupBy("record_id").agg(F.min("label").alias("label"), F.collect_set("named").alias("named"))
    right = F.coalesce(F.array_contains("named", F.col("language")), F.lit(False))
    wrong = cut_lineage(main_languages(records, profiles, min_words).join(labels, "record_id", "left").where((F.col("n_segments") > 1) | ~right).select("record_id", "label"))
    found = language_segments(only_ids(records, wrong, "record_id", "left_semi"), profiles, min_words, keep)
    return found.join(wrong, "record_id")
