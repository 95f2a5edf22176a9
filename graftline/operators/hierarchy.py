"""Parent-child rows to full hierarchies: root, depth, path and descendants of every node, and the cycles.

Method: splitters. A deterministic hash of the id makes about one in ``rate`` inner nodes a splitter. Every inner
node is walked to its next splitter or to its root (by pointer doubling, so a walk of length L takes log2 L rounds
over the nodes that still walk), the graph of the splitters alone is solved the same way, and the results are
expanded to the nodes between splitters and to the leaves. Nodes that reach neither a splitter nor a root hang in a
cycle without splitter; these, and the splitters of cycles, are found exactly: a round that leaves the count of
walking nodes unchanged proves that the rest walks in circles.

Leaves, most rows of any forest, take no part in the rounds. Each round is written to the shared folder, so lost
executors repeat one round at most.

Defined cases: rows without id are left out; of several rows of one id the one with the latest ``fetched_at`` counts
(a null time is the earliest, ties take the greatest parent, then depth); a parent that is null, 0 or no id of the
table makes a root at depth 1; a node on a cycle or below one gets depth -1, the smallest id on that cycle as root,
and a null path; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graftline.runtime import Scratch, join_one

WALKS, SPLITTER, ROOT, CYCLE = 0, 1, 2, 3


def latest_links(rows: DataFrame) -> DataFrame:
    """One row per id: id, parent (as stored), depth (as stored)."""
    best = F.max(F.struct("fetched_at", F.col("reply_comment").alias("parent"), "depth")).alias("best")
    return rows.where("id IS NOT NULL").groupBy("id").agg(best).select("id", "best.parent", F.col("best.depth").alias("stored_depth"))


def _is_splitter(c: Column, rate: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(rate)) == 0


def _double(state: DataFrame, arrive, scratch: Scratch, with_path: bool) -> tuple[DataFrame, int]:
    """Rounds of pointer doubling over state(id, ptr, dist, lo, end[, path]) until no node walks or all that walk circle.

    ``arrive(ptr, met_end)`` says how a walk goes on that has come to ``ptr``. Gives the state and the count of circling
    nodes.
    """
    before = None
    seen = Observation()
    state = scratch.write(state.observe(seen, F.sum(F.when(F.col("end") == WALKS, 1).otherwise(0)).alias("n")))
    while True:
        walking = seen.get["n"] or 0
        if walking == 0 or walking == before:
            return state, walking
        before, seen = walking, Observation()
        nxt = _hop(state, arrive, with_path)
        old, state = state, scratch.write(nxt.observe(seen, F.sum(F.when(F.col("end") == WALKS, 1).otherwise(0)).alias("n")))
        scratch.drop(old)


def _hop(state: DataFrame, arrive, with_path: bool) -> DataFrame:
    met = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("m_ptr"), F.col("dist").alias("m_dist"), F.col("lo").alias("m_lo"), F.col("end").alias("m_end"), *([F.col("path").alias("m_path")] if with_path else []))
    moved = state.where(F.col("end") == WALKS).join(met, "ptr", "left")
    known = F.col("m_ptr").isNotNull()
    moved = moved.select(
        "id",
        F.when(known, F.col("m_ptr")).otherwise(F.col("ptr")).alias("ptr"),
        F.when(known, F.col("dist") + F.col("m_dist")).otherwise(F.col("dist")).alias("dist"),
        F.when(known, F.least("lo", "m_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(known, arrive(F.col("m_ptr"), F.col("m_end"))).otherwise(F.lit(ROOT)).alias("end"),  # a pointer that is no inner non-root node is a root
        *([F.when(known, F.concat("path", "m_path")).otherwise(F.col("path")).alias("path")] if with_path else []),
    )
    return state.where(F.col("end") != WALKS).unionByName(moved)


def _circle(state: DataFrame, nexts: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, ptr) of the walking nodes, ptr being the smallest id on the cycle each comes to; nexts(id, next) are their links.

    All nodes given walk in circles for good. Each knows the minimum of as many nodes from its pointer on as were
    walked so far. Once these minima agree along every link they are the same all the way to and around a cycle, and
    as some of them span its smallest id and none on the cycle spans another's, they are the cycle's; until then the
    steps are doubled.
    """
    now = scratch.write(state.where(F.col("end") == WALKS).select("id", "ptr", "lo").join(nexts, "id"))
    while True:
        met = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("m_ptr"), F.col("lo").alias("m_lo"))
        seen = scratch.write(now.join(met, "ptr").select("id", "next", "lo", "m_ptr", "m_lo"))
        after = seen.select(F.col("id").alias("next"), F.col("m_lo").alias("n_lo"))
        if not seen.join(after, "next").where("m_lo <> n_lo").limit(1).count():
            return seen.select("id", F.col("m_lo").alias("ptr"))
        old, now = now, scratch.write(seen.select("id", F.col("m_ptr").alias("ptr"), F.least("lo", "m_lo").alias("lo"), "next"))
        scratch.drop(old)
        scratch.drop(seen)


def resolve(nodes: DataFrame, rate: int = 8, with_path: bool = False) -> DataFrame:
    """nodes(id, parent) of distinct ids to (id, root_id, node_depth[, path]); path runs from the root to the node."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "hierarchy")
    here = nodes.select("id", F.when(F.col("parent") != 0, F.col("parent")).alias("parent"))
    there = here.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    links = scratch.write(here.join(there, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent")))

    kids = links.where("parent IS NOT NULL")
    inner = kids.join(kids.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    first = inner.select(
        "id", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.col("id").alias("lo"),
        F.when(_is_splitter(F.col("parent"), rate), SPLITTER).otherwise(WALKS).alias("end"),
        *([F.array("parent").alias("path")] if with_path else []),
    )
    walked, circling = _double(first, lambda p, end: F.when(end != WALKS, end).when(_is_splitter(p, rate), SPLITTER).otherwise(WALKS), scratch, with_path)

    done = walked.where(F.col("end") != WALKS)
    none = F.lit(None).cast("array<bigint>").alias("path")
    if circling:
        rest = _circle(walked, kids.select("id", F.col("parent").alias("next")), scratch).select("id", "ptr", F.lit(0).cast("bigint").alias("dist"), F.col("ptr").alias("lo"), F.lit(CYCLE).alias("end"), *([none] if with_path else []))
        full = scratch.write(done.unionByName(rest))
        scratch.drop(walked)
    else:
        full = walked

    # The reduced graph: splitters point to splitters; one that points at a root or into a cycle is solved already.
    splitters = full.where(_is_splitter(F.col("id"), rate)).withColumn("end", F.when(F.col("end") == SPLITTER, WALKS).otherwise(F.col("end")))
    solved, circling = _double(splitters, lambda p, end: end, scratch, with_path)
    if circling:
        rest = _circle(solved, splitters.select("id", F.col("ptr").alias("next")), scratch).select("id", "ptr", F.lit(0).cast("bigint").alias("dist"), F.col("ptr").alias("lo"), F.lit(CYCLE).alias("end"), *([none] if with_path else []))
        old, solved = solved, scratch.write(solved.where(F.col("end") != WALKS).unionByName(rest))
        scratch.drop(old)

    # Expansion: nodes that stopped at a splitter go on with its result.
    end = solved.select(F.col("id").alias("ptr"), F.col("ptr").alias("m_ptr"), F.col("dist").alias("m_dist"), F.col("end").alias("m_end"), *([F.col("path").alias("m_path")] if with_path else []))
    known = F.col("m_ptr").isNotNull()
    waiting = full.where(F.col("end") == SPLITTER).join(end, "ptr", "left").select(
        "id",
        F.coalesce("m_ptr", "ptr").alias("ptr"),
        (F.col("dist") + F.coalesce("m_dist", F.lit(0))).alias("dist"),
        F.coalesce("m_end", F.lit(ROOT)).alias("end"),
        *([F.when(known, F.concat("path", "m_path")).otherwise(F.col("path")).alias("path")] if with_path else []),
    )
    final = full.where(F.col("end") != SPLITTER).drop("lo").unionByName(waiting)

    met = final.select(F.col("id").alias("parent"), F.col("ptr").alias("m_ptr"), F.col("dist").alias("m_dist"), F.col("end").alias("m_end"), *([F.col("path").alias("m_path")] if with_path else []))
    cyclic = F.coalesce(F.col("m_end") == CYCLE, F.lit(False))
    out = join_one(kids, met, "parent", "id", "left")  # one node may have a third of all as children
    up = [F.when(~cyclic, F.concat(F.reverse(F.concat(F.array("parent"), F.coalesce("m_path", F.array().cast("array<bigint>")))), F.array("id"))).alias("path")] if with_path else []
    below = out.select("id", F.coalesce("m_ptr", "parent").alias("root_id"), F.when(cyclic, -1).otherwise(F.coalesce("m_dist", F.lit(0)) + 2).cast("bigint").alias("node_depth"), *up)
    top = links.where("parent IS NULL").select("id", F.col("id").alias("root_id"), F.lit(1).cast("bigint").alias("node_depth"), *([F.array("id").alias("path")] if with_path else []))
    return top.unionByName(below)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): one row for each node below each node, from the paths; cyclic nodes have none."""
    step = F.posexplode("path").alias("pos", "ancestor_id")
    return resolved.where("path IS NOT NULL").select("id", "node_depth", step).where("ancestor_id <> id").select("ancestor_id", "id", (F.col("node_depth") - 1 - F.col("pos")).alias("distance"))
