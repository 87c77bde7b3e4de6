"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of letters or digits; tokens are runs of word characters or one other
#: non-space character.
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\w+|[^\w\s]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str | Column) -> Column:
    """A key as it is compared: no surrounding white space, no letter case; blank is null."""
    c = F.col(column) if isinstance(column, str) else column
    c = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""))
    return F.when(c != "", c)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable], schema: str | pa.Schema) -> DataFrame:
    """Batches of ``columns`` as Python lists go through the function that ``make()`` returns (it
    is made once per task, so that it can hold caches); it returns lists, one per output column."""
    picked = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            if b.num_rows:
                out = work(*(c.to_pylist() for c in b.columns))
                yield pa.RecordBatch.from_arrays([v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(out, types)], names=names)

    ddl = schema
    types, names = arrow_types(ddl)
    return picked.mapInArrow(run, ddl)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_types(ddl: str) -> tuple[list[pa.DataType], list[str]]:
    """Arrow types and names of a flat DDL string such as ``"a bigint, b array<string>"``."""
    types, names = [], []
    for part in ddl.split(","):
        name, kind = part.strip().split(None, 1)
        kind = kind.strip().lower()
        m = re.fullmatch(r"array<(\w+)>", kind)
        types.append(pa.list_(_ARROW[m[1]]) if m else _ARROW[kind])
        names.append(name)
    return types, names


class Bounded(dict):
    """A cache that starts anew when it holds ``limit`` entries, so that a task's memory has a bound."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def put(self, k, v):
        if len(self) >= self.limit:
            self.clear()
        self[k] = v
        return v


def join_rows(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join whose sides are both moved by key. Sizes that are estimated from files of compressed text know
    neither lengths of arrays nor of digests, so a side of any size could pass for one that fits the driver."""
    return left.join(right.hint("merge"), on, how)


#: Identifiers go to all tasks only up to this many: a relation of long keys takes about 50 bytes for
#: each, so 10 MB; beyond, they are joined.
BROADCAST_IDS = 200_000


def only_ids(big: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join by identifiers: these go to all tasks if a count shows that they are few."""
    ids = ids.select(column).distinct()
    n = ids.count()
    return big.join(F.broadcast(ids), column, how) if n <= BROADCAST_IDS else join_rows(big, ids, column, how)
