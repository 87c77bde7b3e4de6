"""Running sums, ranks and exact quantiles over values, without a window that spans all rows.

Rows are first aggregated to distinct values. These are cut into ranges at approximate quantiles; sums
of the ranges are carried over from one to the next, and only within a range a window runs over values.
The quantiles decide how even the ranges are, not the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the values of all keys together are cut into.
RANGES = 64


def same_keys(keys: list[str], suffix: str = "_k") -> Column:
    """Equality of keys with their renamed copies, in which a null is equal to a null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys), F.lit(True))


def running(g: DataFrame, keys: list[str], value: str, sums: list[str], order: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """``g`` with, for each of ``sums``, its sum ``<name>_below`` over the rows of the same keys that come
    before, and ``all_<name>`` over all of them. Rows come in the order of ``value``, then of the
    columns ``order``; nulls come first. Repeated rows of equal order follow in any order."""
    points = F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1)))
    cuts = g.agg(F.percentile_approx(value, points, F.lit(20 * ranges)).alias("_cuts"))  # one row
    d = g.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter(F.coalesce("_cuts", F.array(F.col(value))), lambda c: c < F.col(value)))).drop("_cuts")
    per = d.groupBy(*keys, "_part").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    # At most ``ranges`` rows for each key.
    w = W.partitionBy(*keys)
    prior = w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*(F.col(k).alias(f"{k}_k") for k in keys), F.col("_part").alias("_part_k"), *(F.coalesce(F.sum(f"_{s}").over(prior), F.lit(0)).alias(f"_{s}") for s in sums), *(F.sum(f"_{s}").over(w).alias(f"all_{s}") for s in sums))
    d = d.join(per, same_keys([*keys, "_part"])).drop(*(f"{k}_k" for k in [*keys, "_part"]))
    inner = W.partitionBy(*keys, "_part").orderBy(F.asc_nulls_first(value), *(order or [])).rowsBetween(W.unboundedPreceding, -1)
    return d.withColumns({f"{s}_below": F.col(f"_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums}).drop("_part", *(f"_{s}" for s in sums))


def ranked(df: DataFrame, keys: list[str], value: str, id_: str, into: str = "rank") -> DataFrame:
    """``df`` with the rank (from 0) of each row among those of its keys, by ``value`` and, where that is
    equal, by the md5 of ``id_``, and the number ``all_rows`` of them. A value that many rows share is cut by
    the digest's first digits, so no task holds all of its rows."""
    digest = F.md5(F.col(id_).cast("string"))
    d = df.withColumn("_h", digest).withColumn("_s", F.substring("_h", 1, 3))
    g = running(d.groupBy(*keys, value, "_s").agg(F.count("*").alias("rows")), keys, value, ["rows"], ["_s"])
    on = [*keys, value, "_s"]
    g = g.select(*(F.col(k).alias(f"{k}_k") for k in on), F.col("rows_below").alias("_below"), "all_rows")
    d = d.join(g, same_keys(on)).drop(*(f"{k}_k" for k in on))
    place = F.row_number().over(W.partitionBy(*on).orderBy("_h", id_))
    return d.withColumn(into, F.col("_below") + place - 1).drop("_h", "_s", "_below")


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, Column], higher: bool = True) -> DataFrame:
    """``(keys, point, quantile)``: exact quantiles of the values that are not null. ``points`` names shares
    between 0 and 1, which may depend on the number of values, ``all_rows``. Between two values the
    ``higher`` counts, or else the quantile is interpolated."""
    g = running(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows")), keys, value, ["rows"])
    g = g.withColumn("_pt", F.explode(F.array(*(F.struct(F.lit(n).alias("point"), c.cast("double").alias("q")) for n, c in points.items()))))
    at, point = F.col("_pt.q") * (F.col("all_rows") - 1), F.col("_pt.point").alias("point")
    low = F.ceil(at - 1e-9) if higher else F.floor(at + 1e-9)
    here = lambda k: (F.col("rows_below") <= k) & (k < F.col("rows_below") + F.col("rows"))
    g = g.withColumns({"_k": low, "_f": F.greatest(F.lit(0.0), at - low), "_next": F.least(low + 1, F.col("all_rows") - 1)})
    if higher:
        return g.where(here(F.col("_k"))).select(*keys, point, F.col(value).alias("quantile"))
    r = g.where(here(F.col("_k")) | here(F.col("_next")))
    # Two rows at most for each key and point.
    r = r.groupBy(*keys, point).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.max("_f").alias("_f"))
    return r.select(*keys, "point", (F.col("_a") + F.when(F.col("_f") > 1e-9, F.col("_f") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias("quantile"))
