"""Splits that keep related records together.

Components: records and root users make a two-sided graph. Each record starts with its own label; in each round every
user tells its records the least label among them, the old label hears of it too, and labels are replaced by their
labels' labels, so chains collapse in few rounds. Users of a single record join nothing and are left out first, which
leaves a small graph. Rounds are written to the shared folder.

Users and components with more than a thousandth of the rows are salted in the joins.

Balance, by largest differencing: the weights of the components (their rows) are brought to a bounded number of
packets, light components by hash, each heavy one by itself. The packets are combined into many equal bins: partial
solutions are ordered by the spread of their bins, and the two of widest spread are combined again and again, the
heaviest bin of one with the lightest of the other. Whole bins then go to the split that lacks most.

Defined cases: the record is ``record_id`` of the JSON, or the part of the id before ``_node_`` where that is missing
or unreadable; root users are the same if they differ only in letter case, outer white space or a leading ``@``; blank
or unreadable ones join nothing; rows with a null id are left out of ``groups`` and repeated ids give one row; an
empty table gives empty results.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graftline.runtime import Scratch, clean_strip, copied, dealt, hot_keys, join_one

PACKETS, BINS = 2048, 64


def keyed(rows: DataFrame) -> DataFrame:
    """(id, record, user) of each row; user may be null."""
    info = F.from_json("sft_chunk_info", "record_id STRING, root_user STRING, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    rows = rows.where("id IS NOT NULL").select("id", info.alias("info"))
    whole = F.col("info._broken").isNull()
    record = F.when(whole, F.regexp_replace(clean_strip(F.col("info.record_id")), r"^(\d+)\.0+$", "$1"))
    user = F.when(whole, F.lower(clean_strip(F.regexp_replace(clean_strip(F.col("info.root_user")), "^@", ""))))
    return rows.select("id", F.coalesce(F.when(record != "", record), F.substring_index("id", "_node_", 1)).alias("record"), F.when(user != "", user).alias("user"))


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct pairs(record, user) to (record, label) of the records that are joined to another."""
    shared = pairs.groupBy("user").agg(F.count("*").alias("n")).where("n > 1").select("user")
    plain = scratch.write(pairs.join(shared, "user", "left_semi"))
    hot = hot_keys(plain, "user")  # one user may have a third of all records
    edges = scratch.write(dealt(plain, hot, "user", "record"))
    labels = scratch.write(edges.select("record", F.col("record").alias("label")).distinct())
    while True:
        told = edges.join(labels, "record")
        least = told.groupBy("user").agg(F.min("label").alias("least"))
        heard = told.join(copied(least, hot, "user"), ["user", "_salt"]).where("least < label")
        news = heard.select("record", F.col("least").alias("label")).unionByName(heard.select(F.col("label").alias("record"), F.col("least").alias("label")))
        best = labels.unionByName(news).groupBy("record").agg(F.min("label").alias("label"), F.max("label").alias("old"))
        hop = best.select(F.col("record").alias("label"), F.col("label").alias("further"))
        seen = Observation()
        nxt = best.join(hop, "label", "left").select("record", F.least(F.col("label"), F.col("further")).alias("label"), (F.coalesce("further", "label") < F.col("old")).alias("moved"))
        old, labels = labels, scratch.write(nxt.observe(seen, F.count_if("moved").alias("n")).drop("moved"))
        scratch.drop(old)
        if not seen.get["n"]:
            return labels


def groups(rows: DataFrame) -> DataFrame:
    """(id, group_id, weight): one row per distinct id; weight is its number of rows."""
    scratch = Scratch(rows.sparkSession, "balance")
    # repeated rows of an id may differ in what can be read: each (id, record, user) counts for the links
    seen = scratch.write(keyed(rows).groupBy("id", "record", "user").agg(F.count("*").alias("weight")))
    # an id seen with several records joins them: the id acts as one more user
    own = seen.select("record", F.concat(F.lit("i"), "id").alias("user")).distinct()
    pairs = seen.where("user IS NOT NULL").select("record", F.concat(F.lit("u"), "user").alias("user")).distinct()
    labels = components(pairs.unionByName(own), scratch)
    labelled = scratch.write(seen.groupBy("id").agg(F.min("record").alias("record"), F.sum("weight").alias("weight")).join(labels, "record", "left").select(
        "id", "weight", F.coalesce("label", "record").alias("label")))
    least = labelled.groupBy("label").agg(F.min("id").alias("group_id"))
    return join_one(labelled, least, "label", "id").select("id", "group_id", "weight")  # one component may hold most rows


@dataclass(order=True)
class Partial:
    """A partial solution: sums of its bins, lightest first, with the packets in each."""

    key: float
    n: int
    sums: np.ndarray = None
    packets: list = None


def difference(weights: dict[int, int], bins: int) -> list[tuple[int, list[int]]]:
    """Bins (sum, packets) of near equal sums by largest differencing."""
    heap: list[Partial] = []
    for n, (packet, w) in enumerate(sorted(weights.items())):
        sums = np.zeros(bins, dtype=np.int64)
        sums[-1] = w
        heap.append(Partial(-float(w), n, sums, [None] * (bins - 1) + [(packet,)]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums = a.sums + b.sums[::-1]
        joined = [x if y is None else y if x is None else (x, y) for x, y in zip(a.packets, reversed(b.packets))]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        n += 1
        heapq.heappush(heap, Partial(-float(sums[-1] - sums[0]), n, sums, [joined[i] for i in order]))
    if not heap:
        return []

    def flat(tree: tuple | None) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            elif x is not None:
                out.append(x)
        return sorted(out)

    return [(int(s), flat(p)) for s, p in zip(heap[0].sums, heap[0].packets)]


def allocate(bins: list[tuple[int, list[int]]], portions: dict[str, float]) -> dict[int, str]:
    """Packet to split: whole bins, heaviest first, go to the split that lacks most of its portion."""
    total = sum(s for s, _ in bins)
    lack = {k: p * total / (sum(portions.values()) or 1) for k, p in portions.items()}
    out = {}
    for s, packets in sorted(bins, key=lambda b: (-b[0], b[1])):
        split = max(sorted(lack), key=lambda k: lack[k])
        lack[split] -= s
        out.update(dict.fromkeys(packets, split))
    return out


def splits(rows: DataFrame, portions: dict[str, float], packets: int = PACKETS, bins: int = BINS) -> DataFrame:
    """(id, group_id, weight, split_name). The driver sees at most 2 x packets weights, however many groups there are."""
    spark = rows.sparkSession
    member = Scratch(spark, "splits").write(groups(rows))
    sizes = member.groupBy("group_id").agg(F.sum("weight").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("size") * packets > total  # fewer than packets groups
    hashed = F.pmod(F.xxhash64("group_id"), F.lit(packets))
    light = sizes.where(~heavy).groupBy(hashed.alias("packet")).agg(F.sum("size").alias("size")).collect()
    big = sizes.where(heavy).select("group_id", "size").orderBy("group_id").collect()
    weights = {r["packet"]: r["size"] for r in light} | {packets + i: r["size"] for i, r in enumerate(big)}
    goal = allocate(difference(weights, bins), portions)
    of_light = spark.createDataFrame([(p, goal[p]) for p in weights if p < packets], "packet bigint, light_split string")
    of_big = spark.createDataFrame([(r["group_id"], goal[packets + i]) for i, r in enumerate(big)], "group_id string, big_split string")
    return member.withColumn("packet", hashed).join(F.broadcast(of_big), "group_id", "left").join(F.broadcast(of_light), "packet", "left").select(
        "id", "group_id", "weight", F.coalesce("big_split", "light_split").alias("split_name"))
