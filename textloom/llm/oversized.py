"""Problem 3: splitting oversized items at natural boundaries."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import TOKEN, map_rows

LIMIT, OVERLAP = 256, 32


def token_ends(text: str) -> tuple[list[int], list[int]]:
    """Start and end offsets of the tokens of ``text``: by position, as prefix sums would give them."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def boundaries(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """Sorted token positions k such that a natural boundary lies between token k - 1 and token k."""
    out = []
    for k in range(1, len(starts)):
        a, b = ends[k - 1], starts[k]
        if a < b and (text[a - 1] in ".!?" and ends[k - 1] - starts[k - 1] == 1 or any(c in "\r\n" for c in text[a:b])):
            out.append(k)
    return out


def plan_pieces(start: int, end: int, cuts: list[int], limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces ``(from, to, natural)`` of tokens ``start`` to ``end``: each ends at the last boundary
    under the limit, the next steps back by the overlap; without a boundary that gets on, a hard cut."""
    out, at = [], start
    while end - at > limit:
        k = bisect_right(cuts, at + limit) - 1
        natural = k >= 0 and cuts[k] > at + overlap
        to = cuts[k] if natural else at + limit
        out.append((at, to, natural))
        at = to - overlap
    out.append((at, end, True))
    return out


def forced(start: int, end: int, cuts: list[int], limit: int) -> bool:
    """Whether a stretch between neighbouring boundaries or edges of the window exceeds the limit."""
    last = start
    for c in cuts[bisect_right(cuts, start) : bisect_right(cuts, end - 1)]:
        if c - last > limit:
            return True
        last = c
    return end - last > limit


def split_windows(records: DataFrame, windows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` tokens of each distinct window that has more in the actual text:
    ``(record_id, window_no, cut, piece_no, token_start, token_end, char_start, char_end, natural,
    piece)``; ``natural`` tells whether the piece ends at a boundary or at the window's end, ``cut``
    whether the window could be cut so throughout. ``piece`` is the text, or null without ``with_text``.

    A null ``token_end`` or one beyond the text means the end of the text, a null or negative
    ``token_start`` its start. Windows without an existing record, with an empty or null text, or
    of at most ``limit`` tokens have no rows. Repeated windows and records count once. Windows too
    short by their own offsets, and texts with too few characters, are left out before the join;
    texts of any length go through whole. ``limit`` must exceed ``overlap``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    w = windows.select(F.col("record_id"), "window_no", F.greatest(F.coalesce("token_start", F.lit(0)), F.lit(0)).alias("token_start"), "token_end")
    w = w.where(F.col("token_end").isNull() | (F.col("token_end") - F.col("token_start") > limit)).distinct()
    r = records.select("record_id", "text").where(F.length("text") > limit)
    joined = r.join(w, "record_id").select("record_id", "window_no", "token_start", "token_end", "text")

    def make():
        last: list = [None, [], [], []]  # of the text that came last, since windows of a record follow each other

        def work(ids, nos, froms, tos, texts):
            out: list[list] = [[] for _ in range(10)]
            for rid, no, a, b, text in zip(ids, nos, froms, tos, texts):
                if last[0] != text:
                    starts, ends = token_ends(text)
                    last[:] = [text, starts, ends, boundaries(text, starts, ends)]
                _, starts, ends, cuts = last
                b = len(starts) if b is None else min(b, len(starts))
                if b - a <= limit:
                    continue
                cut = "forced" if forced(a, b, cuts, limit) else "boundary"
                for k, (x, y, natural) in enumerate(plan_pieces(a, b, cuts, limit, overlap)):
                    for column, v in zip(out, (rid, no, cut, k, x, y, starts[x], ends[y - 1], natural, text[starts[x] : ends[y - 1]] if with_text else None)):
                        column.append(v)
            return out

        return work

    pieces = map_rows(joined, joined.columns, make, "record_id bigint, window_no int, cut string, piece_no int, token_start int, token_end int, char_start int, char_end int, natural boolean, piece string")
    return pieces.dropDuplicates(["record_id", "window_no", "token_start", "token_end", "piece_no"])
