"""Readers of the project's file formats (S1-S15). All give DataFrames; nothing is read on the driver but a first byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.functions.text import strip_ansi
from graftline.runtime import Scratch

MESSAGES = "array<struct<role:string,content:string,loss:bigint>>"


def jsonl_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are skipped; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank and broken lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array or JSON lines, told by the first character of the first file that has one."""
    head = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if head and head[0].value.lstrip("﻿ \t").startswith("["):
        return json_array(spark, path, schema)
    return jsonl_tolerant(spark, path, schema)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines of each file; a file with fewer fails the read."""
    lines = text_lines(spark, path)
    short = F.max("line_no").over(Window.partitionBy("file")) < n - 1
    head = lines.where(F.col("line_no") < n)
    return head.withColumn("line", F.when(short, F.raise_error(F.concat(F.lit("too few lines in "), F.col("file")))).otherwise(F.col("line")))


def text_lines(spark: SparkSession, path: str, fallback: str = "ISO-8859-1", ansi: bool = False) -> DataFrame:
    """(file, line_no, line): the lines of text files with their numbers from 0; escape codes are cut unless ``ansi``.

    Files are split as large ones are: a line's number is its place in its split plus the lines of the splits before, so
    no file is ever one task's or one cell's. A line that is no UTF-8 is read in the ``fallback`` encoding.
    """
    at = F.monotonically_increasing_id()  # rising within a split
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    fixed = Scratch(spark, "lines").write(read)
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = fixed.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", before.alias("start"))  # one row a split
    line = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), fallback))
    out = fixed.withColumn("own", own).join(starts, ["file", "block"]).select("file", (F.col("own") - 1 + F.col("start")).alias("line_no"), line.alias("line"))
    return out if ansi else out.withColumn("line", strip_ansi(F.col("line")))


def scan_layers(samples: DataFrame, verify: bool = False, limit: int | None = None) -> DataFrame:
    """One row: rows and those of depth 0 and 1; with ``verify`` also the layers at the ends of the user messages and how
    many differ from the depth. Messages are read only then. ``limit`` stops after so many rows, for a quick look."""
    missing = [c for c in ("node_depth", "messages")[: 1 + verify] if c not in samples.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    rows = samples.limit(limit) if limit is not None else samples
    depth = F.col("node_depth")
    out = [F.count("*").alias("n_rows"), F.count_if(depth == 0).alias("depth0"), F.count_if(depth == 1).alias("depth1")]
    if verify:
        tail = F.rtrim(F.regexp_replace(F.get(F.filter("messages", lambda m: m.role == "user"), 0).content, r"\s+$", ""))
        layer = F.when(tail.endswith("<TL1>"), 1).when(tail.endswith("<TL0>"), 0)
        out += [F.count_if(layer == 0).alias("v_tl0"), F.count_if(layer == 1).alias("v_tl1"), F.count_if(layer.isNull()).alias("v_unknown"), F.count_if(depth.isin(0, 1) & (layer != depth)).alias("mismatch")]
    return rows.agg(*out)


def parquet_columns(spark: SparkSession, paths: list[str], wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that the files have; each path once, in order."""
    df = spark.read.option("mergeSchema", True).parquet(*dict.fromkeys(paths))
    return df.select(*[c for c in wanted if c in df.columns])


def per_file(df: DataFrame) -> DataFrame:
    """Rows per file of a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"))


def profile_maps(spark: SparkSession, graph: str, ids: str) -> DataFrame:
    """Two JSON dictionaries, real id to anonymous id and that to a profile, joined; no profile gives no interests."""
    mapping = spark.read.option("wholetext", True).text(ids).select(F.explode(F.from_json("value", "map<string,string>")).alias("user_id", "anon_id"))
    known = spark.read.option("wholetext", True).text(graph).select(F.explode(F.from_json("value", "map<string,struct<user_interests:array<string>,user_description:string>>")).alias("anon_id", "p"))
    return mapping.join(known, "anon_id", "left").select("user_id", "anon_id", F.coalesce("p.user_interests", F.array().cast("array<string>")).alias("interests"), F.coalesce("p.user_description", F.lit("")).alias("description"))


def messages_of(c: Column) -> Column:
    """Messages of a JSON text cell; null or broken ones give an empty array."""
    return F.coalesce(F.from_json(c, MESSAGES), F.from_json(F.lit("[]"), MESSAGES))
