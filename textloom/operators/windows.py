"""Segments and token windows of documents, with offsets of characters."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import content_type

# Tokens; the statements that a block of code starts with; tokens a code segment holds.
TOKEN = re.compile(r"\w+|[^\w\s]")
BLOCK = re.compile(r"\n\s*(def |class |function |const |let |public |private |package |import |from )")
CODE_TOKENS = 260
SIZE, OVERLAP = 160, 32


def code_boundaries(text: str) -> list[int]:
    """Where the blocks of code start, and the end."""
    starts = [0]
    for m in BLOCK.finditer(text):
        if m.start() > starts[-1]:
            starts.append(m.start() + 1)
    return starts if len(text) in starts else [*starts, len(text)]


def code_windows(spans: list[tuple[int, int]], boundaries: list[int], most: int = CODE_TOKENS) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)``: blocks merged while they hold at most ``most`` tokens. A window that a
    block would overfill reaches to that block's end; the block's tokens count for the next window,
    which starts there."""
    out, start, held, k = [], boundaries[0], 0, 0
    for b in boundaries[1:]:
        n = 0
        while k < len(spans) and spans[k][0] < b:
            n += spans[k][0] >= start
            k += 1
        if held and held + n > most:
            out.append((start, b, held))
            start, held = b, 0
        held += n
    if held:
        out.append((start, boundaries[-1], held))
    return out or [(0, boundaries[-1], len(spans))]


def token_windows(spans: list[tuple[int, int]], size: int, overlap: int, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """``(token start, token end, char start, char end)``: windows of ``size`` tokens that share
    ``overlap``, up to the one that reaches the end, or ``most`` of them."""
    out, at, n = [], 0, len(spans)
    while at < n and (most is None or len(out) < most):
        end = min(at + size, n)
        out.append((at, end, spans[at][0], spans[end - 1][1]))
        if end == n:
            break
        at += max(size - overlap, 1)
    return out


def _over_texts(df: DataFrame, id_: str, text: str, more: list[str], rows, schema: str) -> DataFrame:
    """Rows that ``rows(text, *more)`` yields for each text, with the id; over Arrow batches."""
    fields = [p.strip().split() for p in schema.split(",")]
    names = [id_, *(n for n, _ in fields)]
    ddl = f"`{id_}` {dict(df.dtypes)[id_]}, {schema}"

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for rid, t, *rest in zip(*(c.to_pylist() for c in b.columns)):
                for row in rows(t or "", *rest):
                    for column, v in zip(out, (rid, *row)):
                        column.append(v)
            types = [b.column(0).type, *(_ARROW[t] for _, t in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return df.select(id_, F.col(text), *more).mapInArrow(run, ddl)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def segments(df: DataFrame, id_: str = "doc_id", text: str = "text", kind: Column | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(id, segment_no, start, end, n_tokens, kind, segment)`` of each document: windows of tokens, or of
    whole blocks in code. ``kind`` says what a text is, else its lines do; mixed texts count as prose.
    Texts without tokens have no segments."""
    d = df.select(id_, text, F.coalesce(kind if kind is not None else content_type(F.coalesce(F.col(text), F.lit(""))), F.lit("prose")).alias("_kind"))

    def rows(t, k):
        spans = [m.span() for m in TOKEN.finditer(t)]
        if not spans:
            return
        if k == "code":
            cuts = code_windows(spans, code_boundaries(t))
        else:
            cuts = [(a, b, e - s) for s, e, a, b in token_windows(spans, size, overlap)]
        for no, (a, b, n) in enumerate(cuts, 1):
            yield no, a, b, n, "prose" if k == "mixed" else k, t[a:b]

    return _over_texts(d, id_, text, ["_kind"], rows, "segment_no int, start int, end int, n_tokens int, kind string, segment string")


def document_windows(df: DataFrame, id_: str = "doc_id", text: str = "text", budget: int = 512, overlap: int = 64, special: int = 2, most: int | None = 32) -> DataFrame:
    """``(id, window_no, token_start, token_end, char_start, char_end, covered)``: windows for a model that
    takes ``budget`` tokens, ``special`` of which are its own. A text without tokens has one empty window.
    ``most`` windows at most, as such models are run; ``covered`` tells whether they reach the end of the
    text, and ``most=None`` makes them all."""
    size = budget - special
    if budget < 8 or not 0 <= overlap < size:
        raise ValueError("the budget must leave room for tokens and the overlap be smaller")

    def rows(t):
        spans = [m.span() for m in TOKEN.finditer(t)]
        got = token_windows(spans, size, overlap, most) or [(0, 0, 0, len(t))]
        for no, w in enumerate(got):
            yield (no, *w, int(got[-1][1] == len(spans)))

    return _over_texts(df, id_, text, [], rows, "window_no int, token_start int, token_end int, char_start int, char_end int, covered int")


def windowed_corpus(df: DataFrame, keep: tuple[str, ...] = ("label", "group"), id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``document_windows`` with columns of the document that each window inherits."""
    return document_windows(df, id_, text, **options).join(df.select(id_, *keep), id_)


def pad(ids: Column, length: int, filler: int = 0) -> Column:
    """Struct of ``ids`` cut or filled up at the right to ``length``, and the mask of the real ones."""
    n = F.least(F.size(ids), F.lit(length))
    return F.struct(F.concat(F.slice(ids, F.lit(1), F.lit(length)), F.array_repeat(F.lit(filler), F.lit(length) - n)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("attention_mask"))


def group_key(domain: Column, family: Column, label: Column, dataset: Column | None = None) -> Column:
    """The group that losses are balanced by."""
    return F.concat_ws("|", *([dataset] if dataset is not None else []), domain, family, label.cast("int").cast("string"))


def equal_parts(words: Column, parts: int = 3) -> Column:
    """Arrays of a text's words cut into ``parts`` of nearly equal length."""
    cut = lambda i: F.floor(F.size(words) * i / parts).cast("int")
    return F.array(*(F.slice(words, cut(i) + 1, cut(i + 1) - cut(i)) for i in range(parts)))


def contiguous_batches(sizes: list[int], budget: int) -> list[list[int]]:
    """Places of a task's windows, longest first, in batches whose padded tokens stay within ``budget``;
    a window above it is a batch of its own."""
    out: list[list[int]] = []
    longest = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not out or longest * (len(out[-1]) + 1) > budget:
            out.append([])
            longest = sizes[i]
        out[-1].append(i)
    return out
