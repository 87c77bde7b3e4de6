"""Text expressions: tokens, content type, language, windows. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns. A word may have apostrophes inside; a token is a run of word
# characters or one other character that is no blank.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
# What makes a line look like code.
CODE_HINTS = (
    "def ",
    "function ",
    "const ",
    "let ",
    "var ",
    "class ",
    "import ",
    "from ",
    "public static",
    "#include",
    "package ",
    "fn ",
    "=>",
)
# File names that say what a text is.
CODE_EXTENSIONS = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".jsx": "javascript",
    ".java": "java",
    ".go": "go",
    ".cs": "csharp",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".c": "c",
    ".h": "c",
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), 0)


def word_tokens(text: str | Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(TOKEN), F.lit(0))


def content_hash(text: str | Column) -> Column:
    return F.sha2(F.encode(_c(text), "utf-8"), 256)


def length_bucket(n_words: str | Column) -> Column:
    n = _c(n_words)
    return F.when(n < 50, "lt50").when(n < 150, "50-149").when(n < 500, "150-499").otherwise("500plus")


def strip(text: str | Column) -> Column:
    """Without blanks at both ends, of any kind."""
    return F.regexp_replace(_c(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\s\p{Z}]")


def lines(text: str | Column) -> Column:
    """Lines that are not blank."""
    return F.filter(F.split(_c(text), LINE_BREAK, -1), lambda x: ~is_blank(x))


#: A line that looks like code: it holds a hint, or ends with a bracket or semicolon.
CODE_LINE = "|".join(re.escape(h) for h in CODE_HINTS) + r"|[{}();][\s\p{Z}]*$"


def code_line_ratio(text: str | Column) -> Column:
    """Share of the lines that look like code. A hint ends with a blank, so the blank that ends a line
    must not count: lines are stripped once."""
    return let(F.transform(lines(text), strip), lambda ls: F.when(F.size(ls) > 0, F.size(F.filter(ls, lambda x: x.rlike(CODE_LINE))) / F.size(ls)).otherwise(0.0))


def extension(name: Column) -> Column:
    return F.regexp_extract(F.lower(name), r"(\.[a-z]+)$", 1)


def content_type(text: str | Column, filename: Column | None = None, override: Column | None = None) -> Column:
    """``code``, ``mixed`` or ``prose``: as ``override`` says, else ``code`` by the extension of
    ``filename``, else by the share of lines that look like code."""
    out = let(code_line_ratio(text), lambda r: F.when(r >= 0.35, "code").when(r >= 0.12, "mixed").otherwise("prose"))
    if filename is not None:
        out = F.when(F.coalesce(extension(filename), F.lit("")).isin(*CODE_EXTENSIONS), "code").otherwise(out)
    return F.coalesce(override, out) if override is not None else out


def language(text: str | Column, kind: Column | None = None, filename: Column | None = None) -> Column:
    """Of code with a file name the language by its extension; else ``en`` if more than 85 % of the
    letters are ASCII, else ``unknown``."""
    t = _c(text)
    ascii_ = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    all_ = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    out = F.when((all_ > 0) & (ascii_ / all_ > 0.85), "en").otherwise("unknown")
    if kind is None or filename is None:
        return out
    by = F.create_map(*(F.lit(x) for kv in CODE_EXTENSIONS.items() for x in kv))
    return F.when(kind == "code", F.coalesce(F.try_element_at(by, extension(filename)), out)).otherwise(out)


def clamp_probability(x: str | Column) -> Column:
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows of ``size`` tokens: each steps back by the overlap, the last reaches the end."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
