"""From trees to samples: numbering, chunks, labels, splits and repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """rows with ``pos``, 1.. within ``by``."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def even_parts(rows: DataFrame, by: list[str], order: str, parts: int) -> DataFrame:
    """``part`` 0..parts-1 of size max(1, n // parts); members beyond the last part are dropped."""
    n = F.count("*").over(Window.partitionBy(*by))
    size = F.greatest(F.lit(1), F.floor(n / parts))
    out = numbered(rows.withColumn("size", size), by, order).withColumn("part", F.floor((F.col("pos") - 1) / F.col("size")).cast("int"))
    return out.where(F.col("part") < parts).drop("size")


def chunks(rows: DataFrame, by: list[str], order: Column | str, k: int) -> DataFrame:
    """``chunk`` of k members each, the last one short; k <= 0 gives one chunk."""
    out = numbered(rows, by, order)
    return out.withColumn("chunk", (F.floor((F.col("pos") - 1) / k) if k > 0 else F.lit(0)).cast("int"))


def shuffled(seed: int, *keys: str) -> Column:
    """Order by hash: as good as a seeded shuffle and the same on every run."""
    return F.xxhash64(F.lit(seed), *keys)


def labelled(nodes: DataFrame, pool_chunks: DataFrame, kids: DataFrame) -> DataFrame:
    """One row per node of depth 0 or 1, chunk and candidate: 0 none, 1 comment with its text, 2 repost."""
    asked = nodes.where("depth IN (0, 1)").select("record_id", "node_id", "root_user", "depth")
    cells = asked.join(pool_chunks.select("root_user", "chunk", "pos", F.col("user_name").alias("user")), "root_user")
    met = kids.withColumnRenamed("parent_id", "node_id")
    return cells.join(met, ["record_id", "node_id", "user"], "left").withColumns({"reaction": F.coalesce("reaction", F.lit(0)), "said": F.coalesce("said", F.lit(""))})


def gathered(cells: DataFrame) -> DataFrame:
    """Cells to samples: the labels and texts of a chunk in candidate order; a chunk is bounded by its size."""
    in_order = F.sort_array(F.collect_list(F.struct("pos", "user", "reaction", "said")))
    out = cells.groupBy("record_id", "node_id", "depth", "chunk").agg(in_order.alias("cells"))
    return out.select(
        F.format_string("%s_node_%s_potchunk_%s_tL%s", "record_id", "node_id", "chunk", "depth").alias("id"), "record_id", F.col("depth").alias("node_depth"),
        F.transform("cells", lambda c: c.user).alias("candidates"), F.transform("cells", lambda c: c.reaction).alias("types"), F.transform("cells", lambda c: c.said).alias("texts"))


def _met(asked: DataFrame, pool_chunks: DataFrame, kids: DataFrame) -> DataFrame:
    """The reactions of candidates to the nodes asked: (record_id, node_id, chunk, pos, reaction, said)."""
    by = asked.select("record_id", "node_id", "root_user")
    met = kids.withColumnRenamed("parent_id", "node_id").join(by, ["record_id", "node_id"])
    return met.join(pool_chunks.select("root_user", "chunk", "pos", F.col("user_name").alias("user")), ["root_user", "user"])


def in_arrays(cells: Column) -> list[Column]:
    """Candidates, types and texts of a sample from its cells, as arrays."""
    return [F.transform(cells, lambda c: c.user).alias("candidates"), F.transform(cells, lambda c: c.reaction).alias("types"), F.transform(cells, lambda c: c.said).alias("texts")]


#: Samples below which a block is not copied to occupy more cores.
LEAST = 1 << 16


def sampled(nodes: DataFrame, pool_chunks: DataFrame, kids: DataFrame, form: Callable[[Column], list[Column]] = in_arrays, block: int = 2048, lot: int = 64, task: int = 1 << 22) -> DataFrame:
    """The same as ``gathered(labelled(...))``, without a row per candidate; ``form`` says what is told of a sample's cells.

    Nearly all samples hold no reaction: what they tell is made once a chunk, and only for the others once a sample. About
    ``lot`` nodes (each chunk they react in counts as one more) meet ``block`` chunks of their pool in one row, which is
    unfolded where it is written; a row unfolds at once, so both bound the memory. Each copy of a block meets many lots, one
    after the other, up to about ``task`` samples, so that what is shuffled grows with samples / block + samples * block / task
    and not with samples / lot. A task gets about ``task`` samples: the bytes it reads do not tell how many it makes. Where
    samples are few, a copy meets fewer lots, so that all cores have some.
    """
    from graftline.runtime import Scratch

    spark = nodes.sparkSession
    kept = Scratch(spark, "samples")
    pool_chunks = kept.write(pool_chunks.select("root_user", "chunk", "pos", "user_name"))
    part = F.floor(F.col("chunk") / block).cast("int").alias("part")
    asked = nodes.where("depth IN (0, 1)").select("record_id", "node_id", "root_user", "depth")
    cell = F.struct("pos", F.col("user_name").alias("user"), F.lit(0).alias("reaction"), F.lit("").alias("said"))
    chunk = pool_chunks.groupBy("root_user", "chunk").agg(F.sort_array(F.collect_list(cell)).alias("cells"))

    met = _met(asked, pool_chunks, kids).groupBy("record_id", "node_id", "root_user", "chunk").agg(F.collect_list(F.struct("pos", "reaction", "said")).alias("met"))  # at most a chunk's candidates
    own = lambda c, m: F.struct(c.pos.alias("pos"), c.user.alias("user"), F.coalesce(m.reaction, c.reaction).alias("reaction"), F.coalesce(m.said, c.said).alias("said"))
    cells = F.transform("cells", lambda c: own(c, F.get(F.filter("met", lambda m: m.pos == c.pos), F.lit(0))))
    told = met.join(chunk, ["root_user", "chunk"]).withColumn("cells", cells)
    told = kept.write(told.select("record_id", "node_id", "root_user", part, "chunk", F.struct(*form(F.col("cells"))).alias("told")))

    weight = asked.select("root_user").unionAll(told.select("root_user")).groupBy("root_user").agg(F.count("*").alias("weight"))
    count = asked.groupBy("root_user").agg(F.count("*").alias("n"))
    sizes = pool_chunks.groupBy("root_user").agg((F.max("chunk") + 1).alias("chunks")).join(weight, "root_user").join(count, "root_user")
    sizes = kept.write(sizes.select("root_user", "chunks", "weight", (F.col("n") * F.col("chunks")).alias("samples")))
    cores, total = spark.sparkContext.defaultParallelism, sizes.agg(F.sum("samples")).first()[0] or 0
    tasks, most = max(2 * cores, total // task), min(task, max(LEAST, total // (8 * cores)))
    lots, meets = F.ceil(F.col("weight") / lot), F.ceil(most / (lot * F.least(F.lit(block), "chunks")))
    sizes = sizes.select("root_user", lots.alias("lots"), meets.alias("meets"), F.ceil(F.col("lots") / F.col("meets")).alias("copies"), F.ceil(F.col("chunks") / block).cast("int").alias("parts"))

    by = ["root_user", "part", "copy"]
    head, tail = F.concat("record_id", F.lit("_node_"), "node_id", F.lit("_potchunk_")), F.concat(F.lit("_tL"), "depth")
    rows = asked.join(sizes, "root_user").withColumn("lot", F.pmod(F.xxhash64("record_id", "node_id"), "lots")).withColumn("copy", F.floor(F.col("lot") / F.col("meets"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    reacted = told.groupBy("record_id", "node_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "told"))).alias("own"))
    rows = rows.join(reacted, ["record_id", "node_id", "part"], "left").select(*by, "lot", F.struct("record_id", "depth", head.alias("head"), tail.alias("tail"), "own").alias("node"))
    lots = rows.repartition(tasks, *by).groupBy(*by, "lot").agg(F.collect_list("node").alias("nodes"))
    cell = F.struct("chunk", F.col("chunk").cast("string").alias("number"), F.struct(*form(F.col("cells"))).alias("plain"))
    blocks = chunk.select("root_user", part, cell.alias("cell")).groupBy("root_user", "part").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    blocks = blocks.join(sizes, "root_user").select("root_user", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), "cells").repartition(tasks, *by)

    rows = lots.join(blocks, by).select("cells", F.inline("nodes")).select("record_id", "depth", "head", "tail", "own", F.inline("cells"))
    found = F.coalesce(F.col("own")[F.col("chunk")], F.col("plain"))
    return rows.select(F.concat("head", "number", "tail").alias("id"), "record_id", F.col("depth").alias("node_depth"), *[found[name].alias(name) for name in rows.schema["plain"].dataType.names])


def candidate_stats(nodes: DataFrame, pool_chunks: DataFrame, kids: DataFrame) -> DataFrame:
    """(depth, n_samples, n_cands, n_gold, share), counted from the sizes of the pools."""
    sizes = pool_chunks.groupBy("root_user").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("n"))
    asked = nodes.where("depth IN (0, 1)").select("record_id", "node_id", "root_user", "depth")
    gold = _met(asked, pool_chunks, kids).where("reaction <> 0").groupBy("record_id", "node_id").agg(F.count("*").alias("gold"))
    rows = asked.join(sizes, "root_user").join(gold, ["record_id", "node_id"], "left")
    out = rows.groupBy("depth").agg(F.sum("chunks").alias("n_samples"), F.sum("n").alias("n_cands"), F.coalesce(F.sum("gold"), F.lit(0)).alias("n_gold"))
    return out.withColumn("share", F.round(F.col("n_gold") / F.col("n_cands"), 6))


def split(records: DataFrame, key: str, share: float, order: Column) -> DataFrame:
    """Distinct keys to train or val: the first round-half-even(n * share) in the given order.

    Ranks are found by range-partitioned counting, so no task sorts all keys.
    """
    keys = records.select(key).distinct().withColumn("o", order)
    ranked = global_rank(keys, "o", key)
    n = keys.count()
    return ranked.select(key, F.when(F.col("rank") <= round(n * share), "train").otherwise("val").alias("part"))


def global_rank(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``rank``, 1.. in the order of the columns, without a window over all rows in one task."""
    spread = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part_id", F.spark_partition_id())
    from graftline.runtime import Scratch

    fixed = Scratch(rows.sparkSession, "rank").write(spread)
    sizes = fixed.groupBy("part_id").agg(F.count("*").alias("n"))
    before = sizes.select("part_id", F.coalesce(F.sum("n").over(Window.orderBy("part_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("part_id").orderBy(*order))
    return fixed.withColumn("own", own).join(F.broadcast(before), "part_id").withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "part_id")


def repeated(samples: DataFrame, times: int) -> DataFrame:
    """Samples of depth 0 in ``times`` copies; the first keeps its id, others get ``__d0x1`` and so on."""
    n = F.when(F.col("node_depth") == 0, times).otherwise(1)
    out = samples.withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("id", F.when(F.col("copy") == 0, F.col("id")).otherwise(F.concat("id", F.lit("__d0x"), F.col("copy").cast("string")))).drop("copy")
