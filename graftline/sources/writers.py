"""Writers (K0-K8). Each is one parallel write; only ``pretty_json`` gathers, and only what it is limited to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_KEYS = ("ts", "group_id", "trajectory_id", "depth", "report_depth", "input_text", "output_text", "step_reward")


def parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Typed Parquet; an empty input still leaves its schema."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def messages_as_json(df: DataFrame, path: str) -> None:
    """Parquet with the messages as one JSON text."""
    parquet(df.withColumn("messages", F.to_json("messages")), path)


def head_json(df: DataFrame, path: str, n: int = 10_000) -> None:
    """The first n rows as JSON lines."""
    df.limit(n).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines holding only the allowed keys."""
    df.select(*[c for c in LOG_KEYS if c in df.columns]).write.mode("append").json(path)


def pretty_json(df: DataFrame, path: str, n: int) -> None:
    """One file with an indented JSON array of the first n rows, for reading by eye; n bounds what one task writes."""
    rows = df.limit(n).select(F.struct("*").alias("row")).agg(F.collect_list("row").alias("rows"))
    rows.select(F.to_json("rows", {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def typed_samples(rows: DataFrame) -> DataFrame:
    """Rows of samples as the sink has them: missing lists empty, the origin as JSON text."""
    out = rows
    for name in ("targets_per_potential_types", "targets_comment_texts"):
        if name in rows.columns:
            out = out.withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    if "sft_chunk_info" in rows.columns and not isinstance(rows.schema["sft_chunk_info"].dataType, T.StringType):
        out = out.withColumn("sft_chunk_info", F.to_json("sft_chunk_info"))
    return out


def parquet_somehow(df: DataFrame, path: str, codecs: tuple[str, ...] = ("zstd", "snappy", "gzip", "uncompressed")) -> str:
    """Parquet with the first codec that this cluster has; gives its name."""
    for codec in codecs:
        try:
            parquet(df, path, codec)
        except Exception:
            if codec == codecs[-1]:
                raise
            continue
        return codec
    raise ValueError("no codec given")
