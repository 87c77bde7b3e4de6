"""Problem 5: duplicates hidden by formatting differences."""

from __future__ import annotations

import json
import unicodedata
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, join_rows, map_rows, only_ids
from textloom.llm.components import hash_to_min
from textloom.session import cut_lineage

MIN_WORDS = 30


def folded_words(text: str) -> list[str]:
    """Maximal runs of letters or digits, without regard to case and to how letters are composed."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.casefold())


def letters(value) -> str:
    return "".join(folded_words(value if isinstance(value, str) else json.dumps(value)))


def _digest(*parts: bytes) -> bytes:
    h = blake2b(digest_size=20)
    for p in parts:
        h.update(len(p).to_bytes(8, "little"))
        h.update(p)
    return h.digest()


class Pairs(list):
    """The fields of a JSON object, in their order, names possibly repeated."""


def merkle(node, depth: int = 0) -> bytes:
    """Digest of a nested record from its leaves up: leaves normalised, the digests of an object's
    fields sorted (its order means nothing), those of a list kept in order."""
    if isinstance(node, Pairs):
        return _digest(b"object", *sorted(_digest(b"field", letters(k).encode(), merkle(v, depth + 1)) for k, v in node))
    if isinstance(node, list):
        return _digest(b"list", *(merkle(v, depth + 1) for v in node))
    return _digest(b"leaf", letters(node).encode())


def fields_of(text: str) -> Pairs | None:
    """The named fields of a text that consists of nothing else: a JSON object, or one ``name:
    value`` per line; marks around them don't matter. None for any other text."""
    a, b = text.find("{"), text.rfind("}")
    if a >= 0 and b > a and not WORD.search(text[:a]) and not WORD.search(text[b + 1 :]):
        try:
            found = json.loads(text[a : b + 1], object_pairs_hook=Pairs, strict=False)
            return found if isinstance(found, Pairs) and len(found) > 1 else None
        except (ValueError, RecursionError):
            pass
    if ":" not in text:
        return None
    out = Pairs()
    for line in text.splitlines():
        name, colon, value = line.partition(":")
        if not colon:
            if WORD.search(line):
                return None
            continue
        if not 1 <= len(WORD.findall(name)) <= 8:
            return None
        out.append((name, value))
    return out if len(out) > 1 else None


def is_flat(fields: Pairs) -> bool:
    return not any(isinstance(v, list) for _, v in fields)


def digests(text: str, nested: bool = False, words: list[str] | None = None) -> tuple[int, str, str | None]:
    """Number of words, digest of the letters and digits in their order, digest of the named fields; ``words`` are the
    text's folded words, where these are at hand."""
    words = folded_words(text) if words is None else words
    f = fields_of(text)
    by_fields = merkle(f).hex() if f is not None and (nested or is_flat(f)) else None
    return len(words), _digest("".join(words).encode()).hex(), by_fields


def record_digests(records: DataFrame, min_words: int = MIN_WORDS, nested: bool = False) -> DataFrame:
    """``(record_id, n_words, plain, by_fields)`` of each record with enough words, once each."""

    def make():
        def work(ids, texts):
            out: list[list] = [[], [], [], []]
            for rid, text in zip(ids, texts):
                n, p, f = digests(text, nested)
                if n >= min_words:
                    for column, v in zip(out, (rid, n, p, f)):
                        column.append(v)
            return out

        return work

    r = records.select("record_id", "text").where("record_id is not null and text is not null")
    return map_rows(r, ["record_id", "text"], make, "record_id bigint, n_words int, plain string, by_fields string").dropDuplicates(["record_id"])


def classes_of(digested: DataFrame, *carry: str) -> DataFrame:
    """``(record_id, class_id, *carry)`` from the columns plain and by_fields: records with the same
    letters in order, or the same fields in any order, carried on, are one class."""
    ties = digested.where("by_fields is not null").select(F.concat(F.lit("p"), "plain").alias("a"), F.concat(F.lit("f"), "by_fields").alias("b")).distinct()
    comp = hash_to_min(ties)
    tagged = digested.select("record_id", F.concat(F.lit("p"), "plain").alias("node"), *carry)
    return join_rows(tagged, comp, "node", "left").select("record_id", F.coalesce("component", "node").alias("class_id"), *carry)


def sorted_form(node):
    """A nested record in the form that ``merkle`` digests: what is equal in this form is the same
    record, whatever the digests say."""
    if isinstance(node, Pairs):
        return "object", sorted(((letters(k), sorted_form(v)) for k, v in node), key=repr)
    if isinstance(node, list):
        return "list", [sorted_form(v) for v in node]
    return "leaf", letters(node)


def same_record(a: str, b: str, by_fields: bool) -> bool:
    """Full comparison of two texts: their letters and digits in order, or their fields in any order."""
    if not by_fields:
        return "".join(folded_words(a)) == "".join(folded_words(b))
    x, y = fields_of(a), fields_of(b)
    return x is not None and y is not None and sorted_form(x) == sorted_form(y)


def confirmed(digested: DataFrame, texts: DataFrame) -> DataFrame:
    """``digested`` with the digests of those records made their own whose text isn't that of the
    smallest record with the digest, when both are compared in full. Only texts of records that
    share a digest are moved; the other side of the join has one row per digest, so the rows of a
    digest that many records share can be split among tasks."""
    marks = []
    for column in ("plain", "by_fields"):
        g = digested.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("record_id").alias("low"), F.count("*").alias("n")).where("n > 1").select(column, "low")
        marks.append(digested.join(g, column).where("record_id <> low").select("record_id", "low", F.lit(column == "by_fields").alias("fields")))
    pairs = cut_lineage(marks[0].union(marks[1]))
    wanted = pairs.select("record_id").union(pairs.select(F.col("low").alias("record_id")))
    t = cut_lineage(only_ids(texts, wanted, "record_id", "left_semi").dropDuplicates(["record_id"]))
    x = pairs.join(t, "record_id").join(t.select(F.col("record_id").alias("low"), F.col("text").alias("low_text")), "low")

    def make():
        def work(ids, fields, texts_, lows):
            wrong = [(i, f) for i, f, a, b in zip(ids, fields, texts_, lows) if not same_record(a, b, f)]
            return [i for i, _ in wrong], [f for _, f in wrong]

        return work

    wrong = map_rows(x, ["record_id", "fields", "text", "low_text"], make, "record_id bigint, fields boolean")
    wrong = wrong.groupBy("record_id").agg(F.max(F.expr("not fields")).alias("_p"), F.max("fields").alias("_f"))
    d = digested.join(wrong, "record_id", "left")
    own = lambda c: F.concat(F.lit("!"), F.col(c), F.lit("!"), F.col("record_id").cast("string"))
    return d.withColumn("plain", F.when(F.col("_p"), own("plain")).otherwise(F.col("plain"))).withColumn("by_fields", F.when(F.col("_f"), own("by_fields")).otherwise(F.col("by_fields"))).drop("_p", "_f")


def formatting_classes(records: DataFrame, min_words: int = MIN_WORDS, nested: bool = False) -> DataFrame:
    """``(record_id, first_record_id, n_copies)`` of each record with at least ``min_words`` words.

    Two records are copies if their letters and digits, ignoring case and all else, are the same in
    the same order, or if both consist of named fields (lines ``name: value`` or a flat JSON
    object; ``nested=True`` takes nested objects, too) and have the same ones in any order; being a
    copy carries on. Records are grouped by 160-bit digests made from the leaves up; each that
    shares a digest is then compared in full with the smallest record that has it, and one that
    differs stands alone. Null texts, null ids and short texts are in no class; a record delivered
    twice counts once.
    """
    d = cut_lineage(record_digests(records, min_words, nested))
    c = classes_of(confirmed(d, records.select("record_id", "text").where("record_id is not null and text is not null")))
    sizes = c.groupBy("class_id").agg(F.min("record_id").alias("first_record_id"), F.count("*").alias("n_copies"))
    return c.join(sizes, "class_id").select("record_id", "first_record_id", "n_copies")


def formatting_pairs(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each copy but the smallest record of its class, with that one."""
    return formatting_classes(records, min_words).where("record_id <> first_record_id").select("first_record_id", "record_id")


def collapsed(records: DataFrame, min_words: int = MIN_WORDS, nested: bool = False) -> DataFrame:
    """One row per class with its number of copies."""
    return formatting_classes(records, min_words, nested).where("record_id = first_record_id").select("record_id", "n_copies")
