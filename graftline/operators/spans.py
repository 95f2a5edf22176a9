"""Character spans against token spans, and pooled vectors."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def between_marks(text: str, mark: str) -> list[tuple[int, int]]:
    """(start, end) of the text between each pair of marks; an odd last mark is left out."""
    at = [m.start() for m in re.finditer(re.escape(mark), text)]
    return [(a + len(mark), b) for a, b in zip(at[::2], at[1::2])]


def covering(spans: list[tuple[int, int]], tokens: list[tuple[int, int]]) -> list[tuple[int | None, int | None]]:
    """First and last token that overlaps each span, by index; tokens are in order and apart, so two searches do."""
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    out = []
    for s, e in spans:
        first, last = bisect_right(ends, s), bisect_left(starts, e) - 1
        out.append((first, last) if s < e and first <= last else (None, None))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType()) for k in ("start", "end", "first", "last")]))


def span_tokens(c: Column, mark: str) -> Column:
    """(start, end, first, last) of each marked span of a text: its characters and the words that cover it.

    Positions need running sums inside a text, which higher-order functions can only do in quadratic time.
    """
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = between_marks(t or "", mark)
            out.append([{"start": s, "end": e, "first": a, "last": b} for (s, e), (a, b) in zip(spans, covering(spans, [m.span() for m in re.finditer(r"[^ ]+", t or "")]))])
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, SPANS)(c)


def pooled(vectors: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group, component by component; groups of one row give zeros."""
    cells = vectors.select(by, F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy(by, "i").agg(F.when(F.count("*") > 1, F.avg(F.col("v").cast("double"))).otherwise(0.0).alias("m"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: F.round(x.m, 6)).alias("mean"))  # as long as a vector


def beside_global(means: DataFrame, every: list[float]) -> DataFrame:
    """means with ``vector``, the group's mean followed by that of all."""
    return means.withColumn("vector", F.concat("mean", F.array(*map(F.lit, every))))
