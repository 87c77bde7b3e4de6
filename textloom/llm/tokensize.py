"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark import SparkFiles
from pyspark.sql import DataFrame

from textloom.llm.common import map_rows

#: A rank file of a public byte-level tokenizer for many languages; the caller may name another.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that these rank files' tokenizer splits text by before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a rank file, or of a JSON file of the tokenizers library; once per process."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: t.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, carry: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, *carry)``; null and empty texts have none. ``carry`` names further columns
    with their types."""

    name = os.path.basename(tokenizer)
    sent = os.path.isfile(tokenizer)
    if sent:
        documents.sparkSession.sparkContext.addFile(tokenizer)  # to every executor, once

    def make():
        encode = load(SparkFiles.get(name) if sent else tokenizer)
        return lambda ids, texts, *more: (ids, [len(encode(t)) if t else 0 for t in texts], *more)

    d = documents.select("doc_id", "text", *(c for c, _ in carry))
    return map_rows(d, d.columns, make, "doc_id bigint, n_tokens bigint" + "".join(f", {c} {t}" for c, t in carry))
