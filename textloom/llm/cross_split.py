"""Problem 6: same or near-same records across splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.canonical import MIN_WORDS, classes_of, digests, folded_words
from textloom.llm.common import Bounded, join_rows, key, map_rows, only_ids
from textloom.session import cut_lineage

RUN, SIMILARITY = 3, 0.6
#: Bands and rows of the index over n-gram hashes: a pair of similarity 0.6 is missed with a chance
#: of (1 - 0.6**4)**55 = 0.0005, one of 0.7 with 3e-7.
BANDS, ROWS = 55, 4
_U = np.uint64


def _constants(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**32, size=n, dtype=np.uint64).astype(np.uint32), rng.integers(0, 2**31, size=n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


MINIMA = BANDS * ROWS
_XOR, _ODD = _constants(6, MINIMA)


class Hasher:
    """64-bit hashes of runs of words, from word hashes that a bounded cache keeps."""

    def __init__(self, run: int = RUN):
        from xxhash import xxh64_intdigest

        self.run, self.cache, self.hash = run, Bounded(500_000), xxh64_intdigest

    def runs(self, words: list[str]) -> np.ndarray:
        """Distinct hashes of the runs, sorted; of the words as one run if there are fewer."""
        get, put = self.cache.get, self.cache.put
        a = np.array([get(w) or put(w, self.hash(w) or 1) for w in words], dtype=np.uint64)
        n = max(len(a) - self.run + 1, 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.run, len(a))):
            h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15) + a[k : k + n]
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        return np.unique(h)


def _minima(x: np.ndarray, xor: np.ndarray, odd: np.ndarray) -> np.ndarray:
    y = (x[None, :] ^ xor[:, None]) * odd[:, None]
    y ^= y >> np.uint32(15)
    return y.min(axis=1)


def signature(h: np.ndarray) -> tuple[list[int], bytes]:
    """A 32-bit key for each band, and a sketch of one bit of each of the same minima."""
    m = _minima((h >> _U(32)).astype(np.uint32), _XOR, _ODD)
    k = np.zeros(BANDS, dtype=np.uint64)
    for r in m.reshape(BANDS, ROWS).astype(np.uint64).T:
        k = (k ^ (k >> _U(31))) * _U(0x9E3779B97F4A7C15) + r
    k ^= k >> _U(32)
    return (k & _U(0xFFFFFFFF)).astype(np.uint32).view(np.int32).tolist(), np.packbits((m >> np.uint32(7)) & np.uint32(1)).tobytes()


def sketch_floor(similarity: float) -> int:
    """Equal bits of a sketch that a pair of this similarity has all but surely (five deviations); that the pair shares
    a band only adds to them."""
    p = (1 + similarity) / 2
    return int(MINIMA * p - 5 * (MINIMA * p * (1 - p)) ** 0.5)


def index_records(records: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per record that has a split and enough words: its side (in train or not), digests as in
    problem 5, digest of its set of word runs, size of the set, band keys and sketch."""

    def make():
        hasher = Hasher()

        def work(ids, texts, trains):
            from xxhash import xxh128_hexdigest

            out: list[list] = [[] for _ in range(8)]
            for rid, text, train in zip(ids, texts, trains):
                words = folded_words(text)
                if len(words) < min_words:
                    continue
                _, plain, by_fields = digests(text, words=words)
                h = hasher.runs(words)
                bands, sketch = signature(h)
                for column, v in zip(out, (rid, train, plain, by_fields, xxh128_hexdigest(h.tobytes()), len(h), bands, sketch)):
                    column.append(v)
            return out

        return work

    s = key("split")
    r = records.select("record_id", "text", (s == "train").alias("train")).where(s.isin("train", "development", "calibration", "test") & F.col("record_id").isNotNull() & F.col("text").isNotNull())
    return map_rows(r, ["record_id", "text", "train"], make, "record_id bigint, train boolean, plain string, by_fields string, runs string, n int, bands array<int>, sketch binary")


def candidate_pairs(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(eval_id, train_id)`` of representatives that share a band key, fit in size and agree in
    their sketches."""
    rows = reps.select("record_id", "train", F.posexplode("bands").alias("band", "k")).select((F.shiftleft(F.col("band").cast("bigint"), 32) + F.col("k").cast("bigint")).alias("k"), "record_id", "train")
    e = rows.where("not train").select("k", F.col("record_id").alias("eval_id"))
    t = rows.where("train").select("k", F.col("record_id").alias("train_id"))
    pairs = join_rows(e, t, "k").select("eval_id", "train_id").distinct()
    sk = reps.select("record_id", "n", "sketch")
    pairs = join_rows(pairs, sk.withColumnsRenamed({"record_id": "eval_id", "n": "eval_n", "sketch": "eval_sketch"}), "eval_id")
    pairs = join_rows(pairs, sk.withColumnsRenamed({"record_id": "train_id", "n": "train_n", "sketch": "train_sketch"}), "train_id")
    pairs = pairs.where(F.least("eval_n", "train_n") >= F.lit(similarity) * F.greatest("eval_n", "train_n"))

    def alike(batches):
        import pyarrow as pa

        floor = sketch_floor(similarity)
        bits = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint16)
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in b.columns[2:])
                ok = pa.array(MINIMA - bits[x ^ y].sum(axis=1) >= floor)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["eval_id", "train_id"])

    return pairs.select("eval_id", "train_id", "eval_sketch", "train_sketch").mapInArrow(alike, "eval_id bigint, train_id bigint")


def run_sets(records: DataFrame) -> DataFrame:
    """``(record_id, runs)``: the sorted 64-bit hashes of each record's word runs, as bytes."""

    def make():
        hasher = Hasher()
        return lambda ids, texts: (ids, [hasher.runs(folded_words(t)).tobytes() for t in texts])

    return map_rows(records.select("record_id", "text"), ["record_id", "text"], make, "record_id bigint, runs binary")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Similarity of the pairs' sets, and the evaluation record's containment in its partner."""
    x = join_rows(pairs, sets.withColumnsRenamed({"record_id": "eval_id", "runs": "eval_runs"}), "eval_id")
    x = join_rows(x, sets.withColumnsRenamed({"record_id": "train_id", "runs": "train_runs"}), "train_id").select("eval_id", "train_id", "eval_runs", "train_runs")

    def make():
        def work(es, ts, xs, ys):
            sims, cons = [], []
            for a, b in zip(xs, ys):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                sims.append(both / (len(a) + len(b) - both))
                cons.append(both / len(a))
            return es, ts, sims, cons

        return work

    return map_rows(x, x.columns, make, "eval_id bigint, train_id bigint, similarity double, containment double")


def cross_split_pairs(records: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``(eval_id, train_id, similarity, containment)``: each record of an evaluation split with each
    record of the training split that has the same text in the sense of problem 5 (similarity and
    containment are null if only that holds) or a set of 3-word runs with at least ``similarity``.

    Records with the same set of runs on the same side are one representative, so that copies,
    however many, cost nothing in the search; they come back in the last join, whose rows are the
    result itself. Representatives meet by bands of minimal n-gram hashes, partitioned by key; each
    pair that fits is then measured on its whole sets. Records without a split, id or text, or with
    fewer than ``min_words`` words, are in no pair; a record delivered twice counts once.
    """
    index = cut_lineage(index_records(records, min_words))
    # A record delivered twice is there twice, which the last aggregation mends at the least cost.
    members = index.select("record_id", "train", "runs")
    low = members.groupBy("runs", "train").agg(F.min("record_id").alias("rep"), F.count("*").alias("copies"))
    others = join_rows(members, low.where("copies > 1"), ["runs", "train"]).where("record_id <> rep").select("record_id")
    reps = only_ids(index, others, "record_id", "left_anti")
    pairs = cut_lineage(candidate_pairs(reps, similarity))
    wanted = pairs.select(F.col("eval_id").alias("record_id")).union(pairs.select("train_id"))
    texts = only_ids(records.select("record_id", "text").where("text is not null"), wanted, "record_id", "left_semi")
    near = measured(pairs.distinct(), run_sets(texts).dropDuplicates(["record_id"])).where(F.col("similarity") >= similarity)
    of_rep = join_rows(members, low, ["runs", "train"]).select("record_id", "rep")
    near = join_rows(near, of_rep.withColumnsRenamed({"rep": "eval_id", "record_id": "eval_record"}), "eval_id")
    near = join_rows(near, of_rep.withColumnsRenamed({"rep": "train_id", "record_id": "train_record"}), "train_id")
    near = near.select(F.col("eval_record").alias("eval_id"), F.col("train_record").alias("train_id"), "similarity", "containment")
    c = classes_of(index.select("record_id", "train", "plain", "by_fields"), "train")
    same = join_rows(c.where("not train").select("class_id", F.col("record_id").alias("eval_id")), c.where("train").select("class_id", F.col("record_id").alias("train_id")), "class_id")
    none = F.lit(None).cast("double")
    return near.union(same.select("eval_id", "train_id", none, none)).groupBy("eval_id", "train_id").agg(F.max("similarity").alias("similarity"), F.max("containment").alias("containment"))


def overlap_report(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Records and overlapping records of each evaluation split and family."""
    hit = cross_split_pairs(records, similarity).groupBy(F.col("eval_id").alias("record_id")).agg(F.count("*").alias("partners"), F.max("containment").alias("containment"))
    s = key("split")
    r = records.select("record_id", s.alias("split"), "family").where(s.isin("development", "calibration", "test")).dropDuplicates(["record_id"])
    return join_rows(r, hit, "record_id", "left").groupBy("split", "family").agg(F.count("*").alias("records"), F.count("partners").alias("overlapping"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.max("containment").alias("most_contained"))
