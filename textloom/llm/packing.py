"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import map_rows
from textloom.llm.tokensize import TOKENIZER, token_sizes

#: Items that are numbered together within one length.
BUCKET_ITEMS = 50_000


class Group:
    """So many containers alike: their lengths, largest first, and the room left in each."""

    def __init__(self, many: int, capacity: int, lengths: tuple[tuple[int, int], ...]):
        self.many, self.capacity, self.lengths = many, capacity, lengths
        self.room = capacity - sum(x * k for x, k in lengths)


def fill_left(room: int, lengths: list[int]) -> int:
    """What is left of ``room`` when it takes the largest of the sorted ``lengths`` again and again."""
    while room:
        i = bisect_left(lengths, room + 1) - 1
        if i < 0:
            break
        room %= lengths[i]
    return room


def best_fit(histogram: dict[int, int], capacities: list[int]) -> list[Group]:
    """Containers for ``histogram`` (length to number of items), best fit decreasing over lengths.

    Items of one length are interchangeable, so all of a length are placed at once and the work
    depends on the capacity, not on the number of items. An item goes where it leaves least room;
    where none has room, a container is opened, of the permitted capacity that promises the least
    waste for the items yet to come. In the end each container shrinks to the smallest permitted
    capacity that holds its contents.
    """
    caps = sorted(set(capacities))
    left = dict(sorted((k, v) for k, v in histogram.items() if k > 0 and v > 0))
    if left and max(left) > caps[-1]:
        raise ValueError("an item exceeds every capacity")
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []  # sorted keys of open_

    def put(g: Group) -> None:
        if g.room not in open_:
            open_[g.room] = []
            rooms.insert(bisect_left(rooms, g.room), g.room)
        open_[g.room].append(g)

    lengths = list(left)
    while lengths:
        size = lengths.pop()
        n = left[size]
        while n:
            i = bisect_left(rooms, size)
            if i < len(rooms):
                room = rooms[i]
                g = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                fit = room // size
                if fit <= n:
                    take, each = min(g.many, n // fit), fit
                else:
                    take, each = 1, n
                if g.many > take:
                    put(Group(g.many - take, g.capacity, g.lengths))
                put(Group(take, g.capacity, (*g.lengths, (size, each))))
                n -= take * each
                continue
            fitting = [c for c in caps if c >= size]
            cap = min(fitting, key=lambda c: (fill_left(c - min(c // size, n) * size, lengths) / c, -c))
            each = min(cap // size, n)
            many = n // each
            put(Group(many, cap, ((size, each),)))
            n -= many * each
    done = []
    for g in (g for room in sorted(open_) for g in open_[room]):
        used = g.capacity - g.room
        done.append(Group(g.many, caps[bisect_left(caps, used)], g.lengths))
    return done


def slots(groups: list[Group]) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """By length, in order of rank: ``(first rank, first container, items each, offset, capacity)``;
    and the number of containers."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for g in groups:
        at = 0
        for size, each in g.lengths:
            start = ranks.get(size, 0)
            out.setdefault(size, []).append((start, base, each, at, g.capacity))
            ranks[size] = start + each * g.many
            at += size * each
        base += g.many
    return out, base


def cut(sizes: DataFrame, largest: list[int]) -> DataFrame:
    """Items by pack (its number in ``largest``): whole documents, or the full pieces and the rest of
    one above the capacity."""
    n, c = F.col("n_tokens"), F.col("largest")
    p = sizes.select("*", F.posexplode(F.array(*map(F.lit, largest))).alias("pack", "largest"))
    p = p.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / c) - 1, F.lit(0)).cast("int"))))
    start = F.col("piece_no") * c
    return p.select("pack", "doc_id", "piece_no", start.cast("bigint").alias("token_start"), F.least(n, start + c).cast("bigint").alias("token_end")).withColumn("len", (F.col("token_end") - F.col("token_start")).cast("int"))


PACKED = "pack_name string, doc_id bigint, piece_no int, token_start bigint, token_end bigint, container_no bigint, capacity int, offset bigint"


def pack_items(sizes: DataFrame, packs: dict[str, list[int]]) -> DataFrame:
    """``(pack_name, doc_id, piece_no, token_start, token_end, container_no, capacity, offset)``: all
    items of ``sizes`` (doc_id, n_tokens) in containers, once for each pack, which names its
    permitted capacities.

    Only an item above the largest capacity is split, into full pieces and a rest. The driver gets
    the histogram of lengths (at most as many rows as the largest capacity, per pack) and plans
    containers by best fit; items then find their place by their rank within their length, counted
    in hash buckets, so that a length that a third of all items share is no single task. Items
    without tokens lie in the first container. Repeated document ids are separate items; null
    sizes count as 0. No items or no packs give an empty result.
    """
    if any(c < 1 for caps in packs.values() for c in caps):
        raise ValueError("capacities must be positive")
    spark = sizes.sparkSession
    if not packs:
        return spark.createDataFrame([], PACKED)
    names = list(packs)
    largest = [max(packs[p]) for p in names]
    n_docs = sizes.count()
    buckets = max(1, math.ceil(n_docs / BUCKET_ITEMS))
    items = cut(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")), largest).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    counts = items.groupBy("pack", "len", "bucket").agg(F.count("*").alias("n"))
    histogram: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("pack", "len").agg(F.sum("n").alias("n")).collect():
        histogram.setdefault(r["pack"], {})[r["len"]] = r["n"]
    keys, rows = [], []
    for p, h in histogram.items():
        groups = best_fit(h, packs[names[p]])
        by, _ = slots(groups)
        by[0] = [(0, 0, max(h.get(0, 0), 1), 0, groups[0].capacity if groups else min(packs[names[p]]))]
        for size, ranges in sorted(by.items()):
            for first, base, each, at, capacity in ranges:
                keys.append(((p << 32 | size) << 64) + first)
                rows.append((first, base, each, at, capacity, size))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    # One row per length and group of like containers: no more than the lengths that a container can
    # hold allow, whatever the number of documents.
    plan = spark.sparkContext.broadcast(([keys[i] for i in order], np.array([rows[i] for i in order], dtype=np.int64).reshape(len(rows), 6)))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("pack", "len").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    ranked = items.withColumn("rn", F.row_number().over(W.partitionBy("pack", "len", "bucket").orderBy("doc_id", "piece_no")))
    ranked = ranked.join(before.select("pack", "len", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["pack", "len", "bucket"])
    ranked = ranked.select("pack", "doc_id", "piece_no", "token_start", "token_end", "len", (F.col("before") + F.col("rn") - 1).cast("bigint").alias("rank"))

    def make():
        from bisect import bisect_right

        keys, rows = plan.value

        def work(ps, docs, pieces, froms, tos, lens, ranks):
            places = [bisect_right(keys, ((p << 32 | size) << 64) + r) - 1 for p, size, r in zip(ps, lens, ranks)]
            t, r = rows[places], np.array(ranks, dtype=np.int64)
            k = r - t[:, 0]
            return [names[p] for p in ps], docs, pieces, froms, tos, (t[:, 1] + k // t[:, 2]).tolist(), t[:, 4].tolist(), (t[:, 3] + k % t[:, 2] * t[:, 5]).tolist()

        return work

    return map_rows(ranked, ranked.columns, make, PACKED)


def read_packs(pack_sizes: DataFrame, most: int = 1000) -> dict[str, int]:
    """The capacities by name; a table of more than ``most`` rows is no table of capacities."""
    rows = pack_sizes.select("pack_name", "capacity_tokens").where("pack_name is not null and capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities")
    return dict(sorted(map(tuple, rows)))


JOINT = "joint"


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents in containers of each capacity of ``pack_sizes`` alone, and, as the pack ``joint``, in
    one set of containers of any of these capacities, opened and downsized as costs least. A pack of
    that name in ``pack_sizes`` makes the other ``joint+``."""
    sizes = token_sizes(documents.where("doc_id is not null"), tokenizer)
    from textloom.session import cut_lineage

    caps = read_packs(pack_sizes)
    packs = {k: [v] for k, v in caps.items()}
    if caps:
        packs[joint_name(caps)] = sorted(set(caps.values()))
    return pack_items(cut_lineage(sizes), packs)


def joint_name(packs) -> str:
    name = JOINT
    while name in packs:
        name += "+"
    return name


def usage(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of room used, by pack and capacity."""
    c = packed.groupBy("pack_name", "container_no").agg(F.max("capacity").alias("capacity"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("items"))
    return c.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / F.sum("capacity")).alias("used_share"))
