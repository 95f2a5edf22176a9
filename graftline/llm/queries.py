"""Queries of the training-data operators on texts and pairs, p2 to p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import balance, encode, garble, overlap, pack, pairs
from graftline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag(table(spark, d, "sft"), table(spark, d, "rollout"), pairs.profiles(table(spark, d, "documents")))


def p2_stored(spark: SparkSession, d: str) -> DataFrame:
    """Steps whose stored items are not those of their text."""
    return pairs.stored_items(table(spark, d, "rollout"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Defective keys per table and defect."""
    return p2_found(spark, d).groupBy("tbl", "defect").agg(F.count("*").alias("n_keys"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.Overlaps(table(spark, d, "sft")).found()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of classes of copies with cosine, dot product and their numbers of rows."""
    return overlap.Overlaps(table(spark, d, "sft")).classes()


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of each row."""
    return overlap.Overlaps(table(spark, d, "sft")).membership()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.Overlaps(table(spark, d, "sft")).report()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return balance.groups(table(spark, d, "sft").select("id", "sft_chunk_info")).select("id", "group_id")


def _portions(spark: SparkSession, d: str) -> dict[str, float]:
    return {r.split_name: r.portion for r in table(spark, d, "split_plan").collect()}  # three rows, fixed


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct id with its group and split."""
    return balance.splits(table(spark, d, "sft").select("id", "sft_chunk_info"), _portions(spark, d)).select("id", "group_id", "split_name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each split against its portion."""
    rows = balance.splits(table(spark, d, "sft").select("id", "sft_chunk_info"), _portions(spark, d))
    by = rows.groupBy("split_name").agg(F.sum("weight").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))
    return by.join(table(spark, d, "split_plan"), "split_name", "full").na.fill(0, ["n_rows", "n_groups"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), encode.vocabulary("byte_bpe_50k"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "pack_plan").first()  # one row, fixed
    return pack.pack_documents(table(spark, d, "documents"), encode.vocabulary(plan.tokenizer), plan.token_capacity)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens, filled share and the loads of the step groups of the whole packing."""
    capacity = table(spark, d, "pack_plan").first().token_capacity
    steps = p8_containers(spark, d).groupBy("step_id").agg(F.count_distinct("container_id").alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    return steps.agg(
        F.sum("containers").alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.count("*").alias("n_steps"),
        F.min("tokens").alias("least_step"), F.max("tokens").alias("most_step"),
    ).withColumn("fill", F.round(F.expr(f"try_divide(n_tokens, n_containers * {capacity})"), 6))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.repair(table(spark, d, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled document with its text as far as it can be known, and whether all of it is."""
    return garble.repair(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p2_stored, p3_found, p3_classes, p3_members, p3_report, p4_found, p4_splits, p4_report, p7_ids, p8_containers, p8_report, p9_found, p9_restored)}
ORACLE: dict[str, str] = {}
