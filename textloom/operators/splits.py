"""Near-duplicate clusters and group-preserving splits and samples."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import content_hash, let
from textloom.operators.ranks import ranked
from textloom.session import cut_lineage

#: The hash family works modulo a Mersenne prime on 64-bit hashes.
PRIME = (1 << 61) - 1
NEAR_WORD = "[a-z0-9']+"


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n words; the words themselves of a shorter text."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return let(F.regexp_extract_all(F.lower(text), F.lit(NEAR_WORD), F.lit(0)), lambda w: F.array_distinct(F.when(F.size(w) >= n, runs(w)).otherwise(w)))


def coefficients(n: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of the hash family."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, n, dtype=np.uint64), rng.integers(0, PRIME, n, dtype=np.uint64)


class Signer:
    """Signatures of texts: the minima of ``perms`` hash functions over the hashes of their word runs.
    The product wraps at 64 bits before the modulus; an empty text has the largest values."""

    def __init__(self, perms: int = 128, words: int = 3):
        import re

        from xxhash import xxh64_intdigest

        self.words, self.hash, self.find = words, xxh64_intdigest, re.compile(NEAR_WORD).findall
        self.a, self.b = coefficients(perms)
        self.cache: dict[str, int] = {}

    def runs(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes of the runs, or of the words of a shorter text."""
        if len(self.cache) > 500_000:
            self.cache.clear()
        w = []
        for x in self.find(text.lower()):
            h = self.cache.get(x)
            if h is None:
                h = self.cache[x] = self.hash(x)
            w.append(h)
        a = np.array(w, dtype=np.uint64)
        n = len(a) - self.words + 1
        if n > 0:
            h = np.zeros(n, dtype=np.uint64)
            for k in range(self.words):
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + a[k : k + n]
            a = h ^ (h >> np.uint64(32))
        return np.unique(a)

    def __call__(self, text: str) -> np.ndarray:
        h = self.runs(text)
        if not len(h):
            return np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        # A long text goes through in parts, so that the table of products stays small.
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(h), 4096):
            low = np.minimum(low, ((h[k : k + 4096, None] * self.a + self.b) % np.uint64(PRIME)).min(axis=0))
        return low


def minhash(df: DataFrame, id_: str = "doc_id", text: str = "text", perms: int = 128) -> DataFrame:
    """``(id, n, signature)`` of each document: its number of distinct word runs and their ``perms`` minima,
    over batches of texts, without a shuffle. A null text is an empty one."""
    kind = dict(df.dtypes)[id_]

    def run(batches):
        sign = Signer(perms)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows = [sign(t).view(np.int64).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(sign.runs(t)) for t in texts], pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=[id_, "n", "signature"])

    return df.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, n int, signature array<bigint>")


def band_rows(df: DataFrame, id_: str = "doc_id", text: str = "text", bands: int = 32, rows: int = 4, words: int = 3) -> DataFrame:
    """``(id, key)``: a row per document and band, the key from the band's number and minima."""
    kind = dict(df.dtypes)[id_]

    def run(batches):
        sign = Signer(bands * rows, words)
        number = np.arange(bands, dtype=np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            m = np.stack([sign(t or "") for t in b.column(1).to_pylist()]).reshape(b.num_rows, bands, rows)
            k = np.broadcast_to(number, (b.num_rows, bands)).copy()
            for r in range(rows):
                k = (k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r]
            k ^= k >> np.uint64(32)
            at = np.repeat(np.arange(b.num_rows), bands)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(k.reshape(-1).view(np.int64))], names=[id_, "key"])

    return df.select(id_, text).mapInArrow(run, f"`{id_}` {kind}, key bigint")


def lsh_edges(long: DataFrame, id_: str = "doc_id") -> DataFrame:
    """``(a, b)``: each document of a bucket of ``band_rows`` with the smallest of it, so that a bucket
    of any size gives as many edges as it has documents."""
    low = long.groupBy("key").agg(F.min(id_).alias("a"), F.count("*").alias("n")).where("n > 1")
    return long.join(low, "key").where(F.col(id_) != F.col("a")).select("a", F.col(id_).alias("b")).distinct()


def verified(edges: DataFrame, df: DataFrame, similarity: float, id_: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The edges ``(a, b)`` whose texts' word runs have at least this Jaccard similarity, measured on the
    whole sets of hashes."""

    def sets(batches):
        sign = Signer(1, words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sign.runs(t or "").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=[id_, "runs"])

    kind = dict(df.dtypes)[id_]
    wanted = edges.select(F.col("a").alias(id_)).union(edges.select("b")).distinct()
    s = df.select(id_, text).join(wanted, id_, "left_semi").mapInArrow(sets, f"`{id_}` {kind}, runs binary")
    x = edges.join(s.withColumnsRenamed({id_: "a", "runs": "ra"}), "a").join(s.withColumnsRenamed({id_: "b", "runs": "rb"}), "b").select("a", "b", "ra", "rb")

    def measure(batches):
        for b in batches:
            keep = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return x.mapInArrow(measure, f"a {kind}, b {kind}")


def components(edges: DataFrame, nodes: DataFrame, id_: str = "doc_id", max_rounds: int = 60) -> DataFrame:
    """``(id, cluster)``: the smallest id reachable over the edges. Each round passes labels along the
    edges and then along the labels themselves (pointer jumping), so chains take log(n) rounds."""
    e = cut_lineage(edges.select("a", "b").union(edges.selectExpr("b as a", "a as b")).distinct())
    lab = cut_lineage(e.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v")))
    total = None
    for _ in range(max_rounds):
        near = e.join(lab, e.b == lab.v).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("k"))
        one = lab.join(near, "v", "left").select("v", F.least("l", F.coalesce("k", "l")).alias("l"))
        up = one.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        lab = cut_lineage(one.join(up, "l", "left").select("v", F.least("l", F.coalesce("ll", "l")).alias("l")))
        now = lab.agg(F.sum(F.xxhash64("v", "l").cast("decimal(38,0)")), F.count("*")).first()
        if now == total:
            break
        total = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return nodes.select(id_).join(lab.withColumnRenamed("v", id_), id_, "left").select(id_, F.coalesce("l", F.col(id_)).alias("cluster"))


def near_duplicate_clusters(df: DataFrame, id_: str = "doc_id", text: str = "text", bands: int = 32, rows: int = 4, words: int = 3, similarity: float | None = None) -> DataFrame:
    """``(id, cluster)``: documents that share a band of minima of their runs of ``words`` words, carried on;
    the cluster is its smallest id. Documents without words are one cluster.

    With ``similarity`` a link counts only if it is measured on the whole texts. Each document is compared
    with the smallest of each of its buckets; then, in buckets that still hold several clusters, with the
    documents of the other clusters. So a bucket of near copies forms no pairs beyond its star, and no
    link between clusters is missed.
    """
    long = cut_lineage(band_rows(df, id_, text, bands, rows, words))
    star = cut_lineage(lsh_edges(long, id_))
    if similarity is None:
        return components(star, df, id_)
    first = cut_lineage(verified(star, df, similarity, id_, text, words))
    b = long.join(components(first, df, id_), id_)
    mixed = b.groupBy("key").agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b")).where("_a <> _b").select("key")
    b = cut_lineage(b.join(mixed, "key", "left_semi"))
    other = b.select("key", F.col(id_).alias("b"), F.col("cluster").alias("_c"))
    pairs = b.withColumnRenamed(id_, "a").join(other, "key").where("cluster < _c").select("a", "b").distinct().join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return components(first.union(cut_lineage(verified(cut_lineage(pairs), df, similarity, id_, text, words))), df, id_)


def joint_groups(splits_: dict[str, DataFrame], id_: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(split, id, group)``: near-duplicate clusters over all splits together, so that a text and its copy in another
    split have one group. Ids need to be unique within their split only."""
    out = None
    for name, df in splits_.items():
        d = df.select(F.lit(name).alias("split"), F.col(id_).cast("string").alias("_own"), F.col(text).alias("text"))
        out = d if out is None else out.union(d)
    d = out.withColumn("_id", F.concat_ws(":", "split", "_own"))
    return d.join(near_duplicate_clusters(d, "_id", "text", **options), "_id").select("split", F.col("_own").alias(id_), F.col("cluster").alias("group"))


def cluster_stats(clusters: DataFrame, bands: int = 32, rows: int = 4) -> DataFrame:
    """``(n_documents, n_clusters, singletons, largest, threshold)``: the last is the similarity at which
    half of the pairs share a band."""
    g = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_clusters"), F.sum((F.col("n") == 1).cast("int")).alias("singletons"), F.max("n").alias("largest"), F.lit((1 / bands) ** (1 / rows)).alias("threshold"))


def jaccard(pairs: DataFrame, df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Exact similarity of given pairs ``(a, b)`` over their shingles. A pair is joined with its two texts, which
    take a fraction of the room of their shingles; these are formed where they are compared. The joins move both
    sides by key, since a table of texts is larger than its file."""
    kinds = dict(pairs.dtypes)
    t = df.select(F.col(id_), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    x = pairs.select("a", "b").join(t.withColumnsRenamed({id_: "a", "t": "ta"}).hint("merge"), "a")
    x = x.join(t.withColumnsRenamed({id_: "b", "t": "tb"}).hint("merge"), "b").select("a", "b", "ta", "tb")

    def measure(batches):
        import re

        find = re.compile(NEAR_WORD).findall

        def runs(t):
            w = find(t)
            return set(zip(w, w[1:], w[2:])) if len(w) >= 3 else set(w)

        for b in batches:
            out = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = runs(p), runs(q)
                both, n = len(p & q), len(p) + len(q)
                out.append(both / (n - both) if n else 1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return x.mapInArrow(measure, f"a {kinds['a']}, b {kinds['b']}, similarity double")


def _ordered(groups: DataFrame, prefix: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.col("g")), 256)


def _running(groups: DataFrame, order: str, size: str = "n") -> DataFrame:
    """``groups`` with the size of all groups before each in the order: sums over hash ranges first,
    then within a range, so that no window spans all groups."""
    g = groups.withColumn("_b", F.substring(order, 1, 2))
    before = g.groupBy("_b").agg(F.sum(size).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    w = W.partitionBy("_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return g.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("before", F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0))).drop("_b", "_before")


def group_subsample(df: DataFrame, group: str, most: int, seed: int = 7) -> DataFrame:
    """Rows of whole groups, taken in the order of a hash while the total stays within ``most``; the
    first group always. Null groups are in no sample."""
    g = df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"))
    g = _running(g.withColumn("o", _ordered(g, f"{seed}:")), "o").where((F.col("before") + F.col("n") <= most) | (F.col("before") == 0))
    return df.join(g.select(F.col("g").alias("_g")), F.col(group).cast("string") == F.col("_g"), "left_semi")


def group_partitions(df: DataFrame, group: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """``(group, partition)``: groups in the order of a hash, cut at the rounded shares of their number."""
    g = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g")).distinct().withColumn("one", F.lit(1))
    g = _running(g.withColumn("o", _ordered(g, f"{seed}:partition:")), "o", "one").crossJoin(F.broadcast(g.agg(F.count("*").alias("n"))))
    acc, total, out = 0.0, sum(shares.values()), F.lit(list(shares)[-1])
    cuts = []
    for name, s in list(shares.items())[:-1]:
        acc += s
        cuts.append((name, acc / total))
    for name, cut in reversed(cuts):
        out = F.when(F.col("before") < F.bround(F.col("n") * cut), name).otherwise(out)
    return g.select(F.col("g").alias("group"), out.alias("partition"))


def holdout(df: DataFrame, group: str, shares: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: int = 13, least: int = 3) -> DataFrame:
    """``(group, partition)``: groups, in the order of a hash, to test, calibration and the rest to train: the
    rounded shares of their number, at least one of each share that isn't 0. Raises with fewer than
    ``least`` groups. Null groups are in no partition."""
    g = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g")).distinct().withColumn("one", F.lit(1))
    g = cut_lineage(_running(g.withColumn("o", _ordered(g, f"{seed}:holdout:")), "o", "one"))
    n = g.count()
    if n < least:
        raise ValueError(f"{n} groups can't be split; at least {least} are needed")
    test, cal = (max(1, round(n * s)) if s else 0 for s in (shares[2], shares[1]))
    if test + cal >= n:
        test, cal = 1, min(1, cal)
    part = F.when(F.col("before") < test, "test").when(F.col("before") < test + cal, "calibration").otherwise("train")
    return g.select(F.col("g").alias("group"), part.alias("partition"))


def majority_labels(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """``(group, majority, n)``: 1 where at least half of a group's rows are."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg((F.sum(F.col(label)) * 2 >= F.count("*")).cast("int").alias("majority"), F.count("*").alias("n"))


def nested_folds(df: DataFrame, group: str, label: str = "label", folds: int = 5, seed: int = 13) -> DataFrame:
    """``(fold, group, partition)``: for each outer fold its groups as test and, of the others, a quarter (at
    least one, and two where both labels are there) as calibration: in the order of a hash, but first
    one group of either majority label, so that both classes are there. The rest trains."""
    m = majority_labels(df, group, label).select(group, "majority")
    f = grouped_folds(df, group, folds).select(group, "fold").join(m, group)
    outer = f.select("fold").distinct().withColumnRenamed("fold", "outer")
    x = f.crossJoin(F.broadcast(outer)).withColumn("o", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("outer").cast("string"), F.col(group).cast("string")), 256))
    rest = x.where("fold <> outer")
    # The first group of either label, and where each stands among the others, per outer fold.
    first = rest.groupBy("outer", "majority").agg(F.min("o").alias("o")).withColumn("_first", F.lit(1))
    size = rest.groupBy("outer").agg(F.count("*").alias("n"), F.countDistinct("majority").alias("k"))
    r = rest.join(first, ["outer", "majority", "o"], "left").join(size, "outer")
    many = F.least(F.greatest(F.floor(F.col("n") / 4), F.when((F.col("k") > 1) & (F.col("n") >= 3), 2).otherwise(1)), F.col("n") - 1)
    r = r.withColumn("_many", many).withColumn("_lead", F.when((F.col("_many") >= 2) & (F.col("k") > 1) & F.col("_first").isNotNull(), 0).otherwise(1))
    r = ranked(r.withColumn("_key", F.concat(F.col("_lead").cast("string"), F.col("o"))).withColumn("_v", F.col("_lead")), ["outer"], "_v", "o", "_rank")
    part = F.when(F.col("_rank") < F.col("_many"), "calibration").otherwise("train")
    return r.select(F.col("outer").alias("fold"), group, part.alias("partition")).union(x.where("fold = outer").select("outer", group, F.lit("test")))


#: Below so many groups a single holdout is too small.
NESTED_BELOW = 30


def protocol_splits(df: DataFrame, group: str, label: str = "label", author: str | None = None, seed: int = 13) -> DataFrame:
    """``(fold, group, partition)``: nested folds where there are fewer than ``NESTED_BELOW`` groups, else one
    holdout as fold 0. The unit is ``author`` where that is given and known, else ``group``."""
    d = df.withColumn("_unit", F.coalesce(F.col(author).cast("string"), F.col(group).cast("string")) if author else F.col(group).cast("string"))
    n = d.select("_unit").where("_unit is not null").distinct().limit(NESTED_BELOW).count()
    if n < NESTED_BELOW:
        if n < 3:
            raise ValueError(f"{n} groups can't be split; at least 3 are needed")
        return nested_folds(d, "_unit", label, seed=seed).withColumnRenamed("_unit", "group")
    return holdout(d, "_unit", seed=seed).select(F.lit(0).alias("fold"), "group", "partition")


def stratified_subsample(df: DataFrame, group: str, strata: list[str], most: int, seed: int = 13) -> DataFrame:
    """Rows of whole groups of each stratum up to its share of ``most``: groups in the order of a hash, the first
    always, then each that still fits; one that doesn't is skipped. All rows, if they are no more than
    ``most``. The fold over a stratum's groups is a task; it gets a number per group."""
    n = df.count()
    if n <= most:
        return df
    d = df.where(F.col(group).isNotNull()).withColumn("_s", F.concat_ws("|", *(F.col(c).cast("string") for c in strata))).withColumn("_g", F.col(group).cast("string"))
    g = d.groupBy("_s", "_g").agg(F.count("*").alias("c"))

    def take(pdf):
        # What fits depends on all groups before, so a stratum's counts go through in order.
        pdf = pdf.assign(o=[hashlib.sha256(f"{seed}:{s}:{x}".encode()).hexdigest() for s, x in zip(pdf["_s"], pdf["_g"])]).sort_values("o")
        quota = max(1, round(most * int(pdf["c"].sum()) / n))
        kept, total = [], 0
        for x, c in zip(pdf["_g"], pdf["c"]):
            if kept and total + c > quota:
                continue
            kept.append(x)
            total += c
            if total >= quota:
                break
        return pdf[pdf["_g"].isin(kept)][["_s", "_g"]]

    chosen = g.groupBy("_s").applyInPandas(take, "_s string, _g string")
    return d.join(chosen, ["_s", "_g"], "left_semi").drop("_s", "_g")


def cap_rows(df: DataFrame, group: str, most: int | None, seed: int = 13) -> DataFrame:
    """``df``, or a sample of whole groups where it has more rows than ``most``."""
    return df if most is None or df.limit(most + 1).count() <= most else group_subsample(df, group, most, seed)


def exclude_groups(df: DataFrame, group: str, *others: DataFrame) -> DataFrame:
    """Rows whose group is in none of the ``others``."""
    for o in others:
        df = df.join(o.select(F.col(group).alias("_x")).where("_x is not null").distinct(), F.col(group) == F.col("_x"), "left_anti")
    return df


#: Texts of a block at most, and the share of a group's texts from which on a term may have a column of its own.
STORY_BLOCK, STORY_DENSE = 4096, 0.002
#: Columns that a bound's table may have; texts of the sample that lays them out; groups of texts at most.
STORY_WIDTHS, STORY_SAMPLE, STORY_GROUPS = (512, 768, 1024, 1536, 2048), 4000, 8
#: Columns that take as long as measuring a pair in full.
STORY_MEASURE = 400_000
#: What float32 sums may be off by.
STORY_SLACK = 1e-4


def _story_terms(texts: list[list[str]]) -> dict[str, int]:
    """How often each word and pair of neighbours is in the texts of a document."""
    tf: Counter[str] = Counter()
    for w in texts:
        tf.update(w)
        tf.update([f"{a} {b}" for a, b in zip(w, w[1:])])
    return tf


def _packed(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them all, or float32, compressed."""
    if x.dtype.kind == "i":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.dtype.char.encode() + x.size.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="lz4", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    kind, n = np.dtype(x[:1].decode()), int.from_bytes(x[1:9], "little")
    return np.frombuffer(pa.decompress(x[9:], n * kind.itemsize, codec="lz4", asbytes=True), dtype=kind)


def _story_weights(row: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray) -> np.ndarray:
    w = (np.log(tf) + 1) * idf[term]
    return w / np.sqrt(np.bincount(row, w * w, n))[row]


def _story_layout(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, terms: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the unit vectors of a sample: centres of groups of like texts (languages, code), the group in which
    each term has most weight, per group the column of each term, and for two groups the one whose columns serve
    best. Terms that mostly occur together share a column of their own, as do, by turns, those for which none is
    left; there are so many columns as make the least work of the sample. What is laid out only bears on how
    close bounds are, not on what is linked."""
    df = np.bincount(term, minlength=terms)
    seen = np.argsort(-df, kind="stable")[:2000]
    at = np.full(terms, -1)
    at[seen] = np.arange(len(seen))
    x = np.zeros((n, len(seen)), np.float32)
    k = at[term] >= 0
    x[row[k], at[term[k]]] = w[k]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    x = unit(x)
    best, c = x @ unit(x.sum(0)), []
    for g in range(STORY_GROUPS):
        near = x @ x[int(best.argmin() if g else best.argmax())]
        c.append(unit(x[np.argsort(-near, kind="stable")[: max(1, n // 40)]].sum(0)))
        best = np.maximum(best, x @ c[-1]) if g else x @ c[-1]
    c = np.array(c)
    for _ in range(10):
        group = (x @ c.T).argmax(1)
        size = np.bincount(group, minlength=len(c))
        c = unit(np.array([x[group == g].sum(0) for g in np.flatnonzero(size >= min(size.max(), max(1, n // 100)))]))
    group = (x @ c.T).argmax(1)
    c = c[np.argsort(-np.bincount(group, minlength=len(c)), kind="stable")]  # the largest first
    group = (x @ c.T).argmax(1)
    del x
    centre = np.zeros((len(c), terms), np.float32)
    centre[:, seen] = c
    mass = np.array([np.bincount(term[k], w[k] ** 2, terms) for k in (group[row] == g for g in range(len(c)))])
    column = np.zeros((len(c), terms), np.int32)
    some = [np.flatnonzero(group == g)[:400] for g in range(len(c))]

    def table(rows, to):
        k, width = np.isin(row, rows), int(to.max()) + 1
        return np.sqrt(np.bincount(np.searchsorted(rows, row[k]) * width + to[term[k]], w[k] ** 2, len(rows) * width)).astype(np.float32).reshape(-1, width)

    def work(x, y):
        return x.shape[1] + STORY_MEASURE * ((x @ y.T >= threshold).sum() - len(x) * (x is y)) / max(1, len(x) * len(y))

    for g in range(len(c)):
        rows = np.flatnonzero(group == g)
        k = group[row] == g
        order = np.argsort(-mass[g], kind="stable")
        often = np.bincount(term[k], minlength=terms)[order[:3000]]
        own = order[:3000][often >= max(1, STORY_DENSE * len(rows))]
        at = np.full(terms, -1)
        at[own] = np.arange(len(own))
        k &= at[term] >= 0
        x = np.zeros((len(rows), len(own)), np.float32)
        x[np.searchsorted(rows, row[k]), at[term[k]]] = w[k]
        x /= np.maximum(np.linalg.norm(x, axis=0), 1e-9)
        like = x.T @ x >= 0.8
        del x
        best = np.inf
        for width in STORY_WIDTHS:
            col, used = np.full(len(own), -1), 0
            for i in range(len(own)):
                if used == width * 5 // 8:
                    break
                if col[i] < 0:
                    like[i, i] = True
                    col[like[i] & (col < 0)] = used
                    used += 1
            to = np.full(terms, -1)
            to[own] = col
            rest = order[to[order] < 0]
            to[rest] = used + np.arange(len(rest)) % (width - used)
            x = table(some[g], to)
            if (now := work(x, x)) < best:
                best, column[g] = now, to
    cost = np.zeros((len(c), len(c), len(c)))
    for m in range(len(c)):
        x = [table(rows, column[m]) for rows in some]
        cost[m] = [[work(p, q) for q in x] for p in x]
    return centre, mass.argmax(0), column, cost.argmin(0)


class _StoryBlock:
    """Unit vectors of a block's documents, and tables whose products are no less than the vectors'."""

    def __init__(self, n: int, packed: tuple[bytes, bytes, bytes], idf: np.ndarray):
        self.n = n
        self.size, term, self.tf = (_unpacked(x) for x in packed)
        self.term, self.size = term.astype(np.int32), self.size.astype(np.int32)
        self.at = np.cumsum(self.size) - self.size
        self.log = np.log(np.arange(1, int(self.tf.max(initial=1)) + 1)) + 1
        w = self.log.take(self.tf - 1)
        w *= idf.take(self.term)
        self.norm = np.sqrt(np.add.reduceat(w * w, self.at))
        w /= np.repeat(self.norm, self.size)
        self.w, self.idf = w.astype(np.float32), idf

    def entries(self, rows: np.ndarray) -> np.ndarray:
        """Where the terms of some documents are."""
        m = self.size[rows]
        ends = np.cumsum(m)
        k = np.repeat((self.at[rows] - (ends - m)).astype(np.int32), m)
        k += np.arange(len(k), dtype=np.int32)
        return k

    def table(self, column: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The norms of what falls into each column, of all or some documents."""
        n, size, term, w, width = self.n, self.size, self.term, self.w, int(column.max()) + 1
        if rows is not None:
            k = self.entries(rows)
            n, size, term, w = len(rows), size[rows], term.take(k), w.take(k)
        at = np.repeat(np.arange(n, dtype=np.int32) * width, size)
        at += column.take(term)
        s = np.bincount(at, w * w, n * width)
        return np.sqrt(s, out=np.empty(len(s), np.float32), casting="same_kind").reshape(n, width)

    def linked(self, r: np.ndarray, o: _StoryBlock, c: np.ndarray, threshold: float, terms: int) -> np.ndarray:
        """Which pairs (r, c) of this and another block reach the threshold."""
        out = np.zeros(len(r), bool)
        order = np.argsort(r.astype(np.uint16), kind="stable")
        r, c = r[order], c[order]
        full, a = np.zeros((8, terms), np.float32), 0
        while a < len(order):
            b = min(len(order), a + 500)
            rows, local = np.unique(r[a:b], return_inverse=True)
            if len(rows) > len(full):
                b = a + int(np.searchsorted(local, len(full)))
                rows, local = rows[: len(full)], local[: b - a]
            for i, x in enumerate(rows):
                k = slice(self.at[x], self.at[x] + self.size[x])
                full[i, self.term[k]] = self.w[k]
            m = o.size[c[a:b]]
            k = o.entries(c[a:b])
            at = np.repeat((local * terms).astype(np.int32), m)
            at += o.term.take(k)
            v = full.reshape(-1).take(at)
            v *= o.w.take(k)
            out[order[a:b]] = (v := np.add.reduceat(v, np.cumsum(m) - m)) >= threshold
            for j in np.flatnonzero(np.abs(v - threshold) < STORY_SLACK):
                out[order[a + j]] = self.dot(int(r[a + j]), o, int(c[a + j])) >= threshold
            for i, x in enumerate(rows):
                full[i, self.term[self.at[x] : self.at[x] + self.size[x]]] = 0
            a = b
        return out

    def dot(self, r: int, o: _StoryBlock, c: int) -> float:
        x, y = slice(self.at[r], self.at[r] + self.size[r]), slice(o.at[c], o.at[c] + o.size[c])
        _, i, j = np.intersect1d(self.term[x], o.term[y], assume_unique=True, return_indices=True)
        p, q = (v.log[v.tf[k] - 1] * v.idf[v.term[k]] / v.norm[z] for v, k, z in ((self, x, r), (o, y, c)))
        return float(np.sum(p[i] * q[j]))

    def forest(self, o: _StoryBlock, r: np.ndarray, c: np.ndarray, bound: np.ndarray, threshold: float, terms: int) -> np.ndarray:
        """For each document of this block, then of the other one, the smallest that links among the pairs (r, c)
        reach. The likeliest pairs are measured first; one whose documents are connected by then needs no measuring."""

        def best(v, bound):
            order = np.argsort(v.astype(np.uint16), kind="stable")
            v = v[order]
            first = np.flatnonzero(np.diff(v, prepend=-1))
            most = np.repeat(np.maximum.reduceat(bound[order], first), np.diff(first, append=len(v)))
            at = np.flatnonzero(bound[order] == most)
            return order[at[np.flatnonzero(np.diff(v[at], prepend=-1))]]

        off = 0 if o is self else self.n
        n = off + o.n
        low, a, b = np.arange(n), np.zeros(0, int), np.zeros(0, int)
        while len(r):
            pick = np.arange(len(r))
            if len(r) > 2 * n:
                pick = np.unique(np.concatenate([best(v, bound) for v in (r, c)]))
            ok = pick[self.linked(r[pick], o, c[pick], threshold, terms)]
            a, b = np.concatenate([a, r[ok]]), np.concatenate([b, c[ok] + off])
            low = _forest(a, b, n)
            rest = np.ones(len(r), bool)
            rest[pick] = False
            rest &= low[r] != low[c + off]
            if len(pick) < len(r) and 10 * len(ok) < len(pick):  # few links are left to find
                ok = np.flatnonzero(rest)
                ok = ok[self.linked(r[ok], o, c[ok], threshold, terms)]
                return _forest(np.concatenate([a, r[ok]]), np.concatenate([b, c[ok] + off]), n)
            r, c, bound = r[rest], c[rest], bound[rest]
        return low


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the edges (a, b) reach."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _fewer_links(batches):
    """Links (a, b) with the same components, one less than documents at most for all batches so far."""
    x = y = None
    for b in batches:
        x, y = (b.column(0), b.column(1)) if x is None else (pa.concat_arrays([x, b.column(0)]), pa.concat_arrays([y, b.column(1)]))
        if n := len(x):
            ids = pa.concat_arrays([x, y]).dictionary_encode()
            at = ids.indices.to_numpy(zero_copy_only=False)
            low = _forest(at[:n], at[n:], len(ids.dictionary))
            k = np.flatnonzero(low != np.arange(len(low)))
            x, y = ids.dictionary.take(pa.array(low[k])), ids.dictionary.take(pa.array(k))
    if x is not None:
        yield pa.RecordBatch.from_arrays([x, y], names=["a", "b"])


def story_groups(df: DataFrame, threshold: float = 0.45, terms: int = 60_000, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, cluster)``: texts whose TF-IDF vectors have a cosine of at least ``threshold``, carried on.

    Terms are words of two or more characters and pairs of them that at least two texts have, the
    ``terms`` most frequent ones; weights are (1 + ln tf) (1 + ln((1 + n) / (1 + df))), vectors have
    length 1. Equal texts are measured once. Each block of texts meets each other one from the checkpoint, without
    a shuffle. No pair is passed over but those whose product can't reach the threshold: by the norms
    of the parts that their terms have in each group of texts, then by a product of dense tables, in which a column
    has the norm of several terms. The others are measured in full, unless links already connect them. A pair
    of blocks gives a link per text at most. So the room it takes grows with the texts, the time with the
    square of those that differ. The driver gets the terms and a sample's vectors.
    """
    kind = dict(df.dtypes)[id_]
    d = df.where(F.col(id_).isNotNull()).select(F.col(id_), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    n, ids = d.agg(F.count("*"), F.count_distinct(id_)).first()
    d = d.select(id_, F.array("t").alias("ts")) if n == ids else d.groupBy(id_).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    d = d.withColumn("h", F.sha2(F.to_json("ts"), 256))
    words = lambda x, *c: x.select(*c, F.transform("ts", lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("ws"))
    once = d.repartition(max(8, min(64, ids // (6 * STORY_BLOCK))), "h").groupBy("h").agg(F.min(id_).alias(id_), F.count("*").alias("m"), F.first("ts").alias("ts"))
    once = words(once, id_, "m")

    def count(batches):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["term", "df", "all"])

        seen: dict[str, list[int]] = {}
        for b in batches:
            for m, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                for t, k in _story_terms(ws).items():
                    if x := seen.get(t):
                        x[0] += m
                        x[1] += k * m
                    else:
                        seen[t] = [m, k * m]
                if len(seen) > 300_000:
                    yield rows()
                    seen = {}
        yield rows()

    top = once.mapInArrow(count, "term string, df bigint, all bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all")).where("df >= 2").orderBy(F.desc("all"), "term").limit(terms)
    top = top.select("term", "df").collect()
    idf = np.log((1.0 + n) / (1.0 + np.array([r["df"] for r in top], dtype=np.float64))) + 1
    sc = df.sparkSession.sparkContext
    known = sc.broadcast([r["term"] for r in top])

    def numbered(batches):
        """Batches with the numbers and frequencies of each document's terms."""
        number = {t: i for i, t in enumerate(known.value)}
        for b in batches:
            at, tf = [], []
            for ws in b.column(b.num_columns - 1).to_pylist():
                got = sorted((number[t], k) for t, k in _story_terms(ws).items() if t in number)
                at.append(np.array([i for i, _ in got], dtype=np.int32))
                tf.append(np.array([k for _, k in got], dtype=np.int32))
            yield b, at, tf

    def sample(batches):
        for _, at, tf in numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary()) for v in (at, tf)], names=["k", "f"])

    some = d.where(F.pmod(F.xxhash64(id_), F.lit(max(1, ids // STORY_SAMPLE))) == 0).limit(STORY_SAMPLE)
    some = [(x["k"], x["f"]) for x in words(some).mapInArrow(sample, "k binary, f binary").collect() if x["k"]]
    row = np.repeat(np.arange(len(some)), [len(k) // 4 for k, _ in some])
    term, tf = (np.frombuffer(b"".join(x[i] for x in some), dtype=np.int32) for i in (0, 1))
    if some:
        centre, home, column, serves = _story_layout(row, term, _story_weights(row, term, tf, len(some), idf), len(some), len(top), threshold)
    else:
        serves = np.zeros((1, 1), int)
        centre, home, column = np.zeros((1, len(top)), np.float32), np.zeros(len(top), int), np.arange(len(top), dtype=np.int32)[None] % STORY_WIDTHS[-1]
    laid = sc.broadcast((idf, centre, home, column, serves))

    def pack(batches):
        from pyspark import TaskContext

        idf, centre, home = laid.value[:3]
        no, kept = TaskContext.get().partitionId() << 32, [([], [], [], []) for _ in centre]

        def block(g):
            ids, at, tf, parts = kept[g]
            data = [np.array([len(x) for x in at], dtype=np.int32), np.concatenate(at), np.concatenate(tf), np.array(parts, dtype=np.float32)]
            cols = [pa.array([_packed(x)], pa.binary()) for x in data]
            kept[g] = ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([g], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)), *cols], names=["no", "g", "ids", "r", "k", "f", "z"])

        for b, at, tf in numbered(batches):
            size = np.array([len(x) for x in at])
            row, term = np.repeat(np.arange(len(at)), size), np.concatenate(at)
            w = _story_weights(row, term, np.concatenate(tf), len(at), idf)
            group = np.array([np.bincount(row, w * c[term], len(at)) for c in centre]).argmax(0)
            parts = np.sqrt([np.bincount(row, w * w * (home[term] == g), len(at)) for g in range(len(centre))]).T
            for i in np.flatnonzero(size):
                for x, v in zip(kept[group[i]], (b.column(0).slice(i, 1), at[i], tf[i], parts[i])):
                    x.append(v)
                if len(kept[group[i]][0]) == STORY_BLOCK:
                    yield block(group[i])
                    no += 1
        for g in range(len(kept)):
            if kept[g][0]:
                yield block(g)
                no += 1

    blocks = cut_lineage(once.mapInArrow(pack, f"no bigint, g int, ids array<{kind}>, r binary, k binary, f binary, z binary"))
    other = blocks.select(*(F.col(c).alias(f"_{c}") for c in blocks.columns))

    def link(batches):
        idf, centre, _, column, serves = laid.value
        least, room = threshold - STORY_SLACK, np.empty(STORY_BLOCK * STORY_BLOCK, np.float32)
        first, kept, tables = None, {}, {}

        def keep(known, most, key, make):
            """What came first comes again first, so what came last makes room; the first block stays."""
            if key not in known:
                if len(known) >= most:
                    known.pop(next((x for x in reversed(known) if x[0] != first), next(iter(known))))
                known[key] = make()
            return known[key]

        for b in batches:
            for i in range(b.num_rows):
                no, g, _no, h = (b.column(k)[i].as_py() for k in (0, 1, 7, 8))
                may = None
                if g != h:
                    p, q = (_unpacked(b.column(k)[i].as_py()).reshape(-1, len(centre)) for k in (6, 13))
                    may = p @ q.T >= least
                    rows, cols = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
                    if not len(rows):
                        continue
                if no != first and first is not None and first >> 32 != _no >> 32:
                    for known in (kept, tables):
                        for x in [x for x in known if x[0] == first]:
                            known.pop(x)
                first = no
                x, y = (keep(kept, 16, (k,), lambda: _StoryBlock(len(b.column(c + 2)[i]), tuple(b.column(c + j)[i].as_py() for j in (3, 4, 5)), idf)) for k, c in ((no, 0), (_no, 7)))
                to = int(serves[g, h])
                if may is not None and np.count_nonzero(may) * STORY_MEASURE < len(rows) * len(cols) * (int(column[to].max()) + 1):
                    r, c = np.nonzero(may)
                    bound = p[r, 0]
                else:
                    s, t = (
                        v.table(column[to], some) if may is not None and 3 * len(some) < v.n else keep(tables, 6, (k, to), lambda: v.table(column[to]))[slice(None) if may is None else some]
                        for v, k, some in ((x, no, None if may is None else rows), (y, _no, None if may is None else cols))
                    )
                    s = np.matmul(s, t.T, out=room[: len(s) * len(t)].reshape(len(s), len(t)))
                    r, c = np.divmod(np.flatnonzero(s.reshape(-1) >= least), s.shape[1])
                    bound = s[r, c]
                    if may is not None:
                        r, c = rows[r], cols[c]
                        k = may[r, c]
                    elif x is y:
                        k = r < c
                    else:
                        k = slice(None)
                    r, c, bound = r[k], c[k], bound[k]
                low = x.forest(y, r, c, bound, threshold, len(idf))
                linked = np.flatnonzero(low != np.arange(len(low)))
                ids = b.column(2)[i].values if x is y else pa.concat_arrays([b.column(2)[i].values, b.column(9)[i].values])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(low[linked])), ids.take(pa.array(linked))], names=["a", "b"])

    tiles = blocks.join(other.hint("shuffle_replicate_nl"), F.col("no") <= F.col("_no"))
    edges = cut_lineage(tiles.mapInArrow(lambda batches: _fewer_links(link(batches)), f"a {kind}, b {kind}"))
    edges = edges.repartition(8).mapInArrow(_fewer_links, f"a {kind}, b {kind}")
    # Copies of a text that has terms are linked to the first of them.
    copies = d.join(d.groupBy("h").agg(F.min(id_).alias("a"), F.count("*").alias("m")).where("m > 1").drop("m"), "h").where(F.col("a") != F.col(id_)).select("a", F.col(id_).alias("b"))
    copies = copies.join(blocks.select(F.explode("ids").alias("a")), "a", "left_semi")
    return components(edges.union(copies), d, id_)


def leaks(assigned: DataFrame, group: str, partition: str = "partition") -> DataFrame:
    """Groups that are in more than one partition; empty where the split is sound."""
    return assigned.groupBy(group).agg(F.countDistinct(partition).alias("partitions")).where("partitions > 1")


def leakage_audit(df: DataFrame, group: Column, split: str = "split") -> DataFrame:
    """By split but train: rows, and those whose group is also in train."""
    d = df.withColumn("_g", group).where(F.col("_g").isNotNull() & F.col(split).isNotNull())
    train = d.where(F.col(split) == "train").select("_g").distinct().withColumn("_in", F.lit(1))
    return d.where(F.col(split) != "train").join(train, "_g", "left").groupBy(split).agg(F.count("*").alias("n"), F.count("_in").alias("leaked"))


def hash_split(key: Column, salt: str, shares: dict[str, int]) -> Column:
    """Split by sha256 mod 10000: the digest is reduced in chunks of 4 hex digits."""
    hex_ = F.sha2(F.concat(F.lit(salt), key), 256)
    chunk = lambda i: F.conv(F.substring(hex_, i * 4 + F.lit(1), F.lit(4)), 16, 10).cast("bigint")
    m = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0).cast("bigint"), lambda a, i: (a * 65536 + chunk(i)) % 10000)
    out, acc = F.lit(list(shares)[-1]), 0
    for name, s in reversed(list(shares.items())[:-1]):
        acc = sum(v for k, v in list(shares.items())[: list(shares).index(name) + 1])
        out = F.when(m < acc, name).otherwise(out)
    return F.when(key.isNotNull(), out)


def deal(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """``(size, first rank, order)`` for distinct sizes with their numbers of groups, largest first: from
    that rank on, groups of the size go to the folds of ``order`` in turn. Each group goes to the
    lightest fold, the first of equals; groups that only repeat a turn are dealt at once, so the work
    grows with the distinct sizes, not with the groups."""
    load = [0] * folds
    out: list[tuple[int, int, list[int]]] = []
    for size, many in sizes:
        at = 0
        while at < many:
            low = sorted(range(folds), key=lambda f: (load[f], f))
            # Folds within one size of the lightest take turns until the next fold is reached.
            ring = [f for f in low if load[f] < load[low[0]] + size]
            rest = [load[f] for f in low if f not in ring]
            turns = (many - at) // len(ring)
            if rest:
                turns = min(turns, (min(rest) - load[ring[-1]] - 1) // size)
            if turns > 1:
                out.append((size, at, ring))
                for f in ring:
                    load[f] += size * turns
                at += turns * len(ring)
            else:
                out.append((size, at, [low[0]]))
                load[low[0]] += size
                at += 1
    return out


def grouped_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``(group, n, fold)``: groups from the largest on, each to the fold with the fewest rows so far; those
    of equal size in the order of their names' digests. Fewer groups than folds give as many folds as groups, at least 2.
    The driver gets a row per distinct size, of which there are at most the root of twice the rows;
    null groups are in no fold."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    sizes = sorted(((r["n"], r["c"]) for r in g.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True)
    k = max(2, min(folds, sum(c for _, c in sizes)))
    steps = df.sparkSession.createDataFrame(deal(sizes, k), "n bigint, at bigint, ring array<int>").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("at", "ring"))).alias("steps"))
    r = ranked(g.withColumn("_v", F.lit(0)), ["n"], "_v", group, "_rank").join(steps, "n")
    step = F.element_at(F.filter("steps", lambda x: x["at"] <= F.col("_rank")), -1)
    return r.withColumn("_x", step).select(group, "n", F.get("_x.ring", (F.col("_rank") - F.col("_x.at")) % F.size("_x.ring")).cast("int").alias("fold"))


def exact_copies(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents whose text another one with a smaller id has, with that id."""
    h = df.where(F.col(text).isNotNull()).select(id_, content_hash(text).alias("h"))
    low = h.groupBy("h").agg(F.min(id_).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return h.join(low, "h").where(F.col(id_) != F.col("first_id")).select(id_, "first_id")
