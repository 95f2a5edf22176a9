"""Filling fixed-capacity containers with texts measured in tokens.

Method: hierarchical multi-length packing. Tier ``t`` has windows of ``capacity >> t`` tokens; a text is routed to the
shortest window that holds it. From the longest tier down, each tier's texts get windows of their own, the gaps in these
are filled from the shorter tiers by best fit, ``1 << t`` windows are joined into a container, and what the joined gaps
still hold is filled from the shorter tiers again. The shortest tier has no gaps filled from below: its texts go into
whole containers by best fit. Windows can waste more than they are worth where short texts are few, so the plan is made
for ``tiers``, ``tiers - 1``, ... 1 tiers and the one with the fewest containers is taken, of equal ones that with the most tiers.
Last, the containers are dealt into step groups of like load.

Only sizes decide a packing, and sizes up to the capacity are few: the plan is made on the driver from the histogram
of sizes, of at most ``capacity`` rows however many texts there are. It is a table of runs: the texts of one size with
ranks a to b go ``per`` by ``per`` into the windows from w on. Texts get their rank within their size by salted
counting (counts per size and salt, prefix sums, ranks within), so a size that holds a third of all texts is ranked
by many tasks. Assignment is then a search in the runs, row by row.

Defined cases: texts without tokens get no place; a text above the capacity fills whole containers and only its rest
is packed; equal texts and repeated rows each get their place; an empty table gives an empty table; a null capacity or
one below 1 raises.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graftline.llm.encode import count
from graftline.runtime import Scratch

ROWS_PER_SALT = 50_000
STEP, TIERS = 32, 4


@dataclass(order=True)
class Span:
    """Windows or containers first..first+many-1, all with the same room left."""

    room: int
    first: int
    many: int = field(compare=False)


class Run(NamedTuple):
    """``many`` texts of a size from a rank on: the k-th goes to container base + (window + k // per) >> shift."""

    size: int
    rank: int
    many: int
    base: int
    shift: int
    window: int
    per: int


def tier(size: int, capacity: int, tiers: int) -> int:
    """The shortest window that holds the size: 0 above half the capacity, 1 above a quarter, and so on."""
    t = 0
    while t < tiers - 1 and size <= capacity >> (t + 1):
        t += 1
    return t


class _Packing:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank = capacity, dict(histogram), dict.fromkeys(histogram, 0)
        self.runs: list[Run] = []
        self.spans: list[Span] = []
        self.made = 0

    def place(self, size: int, many: int, base: int, shift: int, window: int, per: int) -> None:
        self.runs.append(Run(size, self.rank[size], many, base, shift, window, per))
        self.rank[size] += many
        self.left[size] -= many

    def fill(self, gaps: list[Span], sizes: list[int], base: int = 0, shift: int = 0) -> None:
        """Texts of the sizes, the largest first, into the smallest gaps that hold them; gaps are kept in order of room."""
        for size in sizes:
            while self.left[size] and (i := bisect_left(gaps, Span(size, -1, 0))) < len(gaps):
                span = gaps.pop(i)
                per = span.room // size
                many = min(span.many, self.left[size] // per)
                if many == 0:  # fewer texts than the first gap takes
                    many, per = 1, self.left[size]
                self.place(size, many * per, base, shift, span.first, per)
                if many < span.many:
                    insort(gaps, Span(span.room, span.first + many, span.many - many))
                insort(gaps, Span(span.room - size * per, span.first, many))

    def windows(self, t: int, sizes: list[int], shorter: list[int]) -> None:
        """A tier in its own windows, filled and joined into containers."""
        length, group, opened = self.capacity >> t, 1 << t, 0
        gaps: list[Span] = []
        for size in sizes:
            if many := self.left[size]:
                self.place(size, many, self.made, t, opened, 1)
                insort(gaps, Span(length - size, opened, many))
                opened += many
        self.fill(gaps, shorter, self.made, t)
        joined: list[Span] = []
        used = have = 0
        for span in sorted(gaps, key=lambda x: x.first):
            many, each = span.many, length - span.room
            if have:
                some = min(group - have, many)
                used, have, many = used + some * each, have + some, many - some
                if have == group:
                    joined.append(Span(self.capacity - used, self.made, 1))
                    self.made, used, have = self.made + 1, 0, 0
            whole, rest = divmod(many, group)
            if whole:
                joined.append(Span(self.capacity - group * each, self.made, whole))
                self.made += whole
            if rest:
                used, have = rest * each, rest
        if have:
            joined.append(Span(self.capacity - used, self.made, 1))
            self.made += 1
        joined.sort()
        self.fill(joined, shorter)
        self.spans += joined

    def whole(self, sizes: list[int]) -> None:
        """Texts of the sizes, the largest first, into new containers by best fit."""
        gaps: list[Span] = []
        for size in sizes:
            self.fill(gaps, [size])
            per = self.capacity // size
            many, rest = divmod(self.left[size], per)
            for n, each in ((many, per), (int(rest > 0), rest)):
                if n:
                    self.place(size, n * each, 0, 0, self.made, each)
                    insort(gaps, Span(self.capacity - size * each, self.made, n))
                    self.made += n
        self.spans += gaps


def tiered(histogram: dict[int, int], capacity: int, tiers: int) -> tuple[list[Run], list[Span], int]:
    """Runs, the spans of all containers and their number, with exactly so many tiers."""
    p = _Packing(histogram, capacity)
    sizes = sorted(histogram, reverse=True)
    of = {s: tier(s, capacity, tiers) for s in sizes}
    for t in range(tiers - 1):
        p.windows(t, [s for s in sizes if of[s] == t], [s for s in sizes if of[s] > t])
    p.whole([s for s in sizes if of[s] == tiers - 1])
    return p.runs, sorted(p.spans), p.made


def plan(histogram: dict[int, int], capacity: int, tiers: int = TIERS) -> tuple[list[Run], list[Span], int]:
    """The plan with the fewest containers among those of 1 to ``tiers`` tiers."""
    return min((tiered(histogram, capacity, n) for n in range(tiers, 0, -1)), key=lambda x: x[2])


def _pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, first_token, size): one row for each text, or for each part of a text above the capacity."""
    parts = F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("bigint"))
    cut = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(parts).alias("piece"))
    first = F.col("piece") * capacity
    return cut.select("doc_id", "piece", first.alias("first_token"), F.least(F.col("tokens") - first, F.lit(capacity)).alias("size"))


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with ``rank``, 0.. within their size; no task ranks more than about ROWS_PER_SALT rows of a size.

    How many salts a size has comes from a table of one row a size, at most the capacity, so it may be broadcast.
    """
    salts = pieces.sparkSession.createDataFrame([(s, -(-n // ROWS_PER_SALT)) for s, n in histogram.items()], "size bigint, salts bigint")
    salted = pieces.withColumn("size", F.col("size").cast("bigint")).join(F.broadcast(salts), "size")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), "salts")).drop("salts")
    own = Window.partitionBy("size", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("bigint") - 1)
    counts = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranked.join(starts, ["size", "salt"]).withColumn("rank", F.col("rank") + F.col("start")).drop("salt", "start")


def pack(sizes: DataFrame, capacity: int, tiers: int = TIERS, step: int = STEP) -> DataFrame:
    """sizes(doc_id, tokens) to (container_id, step_id, doc_id, piece, first_token, tokens, context): context is the
    length of the windows the piece was routed to."""
    if capacity is None or capacity < 1:
        raise ValueError("the capacity must be 1 or more")
    pieces = _pieces(sizes, capacity)
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, spans, made = plan(histogram, capacity, tiers)
    groups = max(1, -(-made // step))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = sorted(runs)
        keys = np.array([r.size * 2**40 + r.rank for r in order], dtype=np.int64)
        table = np.array(order, dtype=np.int64).reshape(-1, len(Run._fields))
        base, firsts = np.cumsum([0, *(s.many for s in spans)])[:-1], np.array([s.first for s in spans], dtype=np.int64)
        by_first = np.argsort(firsts)
        for batch in batches:
            size, rank = batch["size"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            at = dict(zip(Run._fields, table[np.searchsorted(keys, size * 2**40 + rank, side="right") - 1].T))
            container = at["base"] + ((at["window"] + (rank - at["rank"]) // at["per"]) >> at["shift"])
            span = by_first[np.searchsorted(firsts[by_first], container, side="right") - 1]
            nth = base[span] + container - firsts[span]  # place among all containers by room
            turn, lane = np.divmod(nth, groups)
            context = [capacity >> tier(int(s), capacity, tiers) for s in size]
            yield pd.DataFrame({
                "container_id": container, "step_id": np.where(turn % 2 == 0, lane, groups - 1 - lane), "doc_id": batch["doc_id"], "piece": batch["piece"],
                "first_token": batch["first_token"], "tokens": size, "context": context})

    return _ranked(pieces, histogram).mapInPandas(run, "container_id bigint, step_id bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint, context bigint")


def pack_documents(documents: DataFrame, path: str, capacity: int) -> DataFrame:
    """Texts measured by the vocabulary at ``path`` and packed; the sizes are kept so that no text is encoded twice."""
    sizes = Scratch(documents.sparkSession, "pack").write(count(documents, path))
    return pack(sizes, capacity)
