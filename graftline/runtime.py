"""Session helpers: the shared scratch folder, and spreading rows before CPU-heavy Python steps."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session does not name one (as in local tests) a folder of this machine is made and used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='graftline-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Intermediate tables in the shared folder; they cut the lineage and outlive any executor.

    A table that later rounds replaced is dropped at once; the others go when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None:
            _delete(self.spark, df._scratch_path)

    def close(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session is gone already
            pass


def _only_scans(df: DataFrame) -> bool:
    """Whether a frame is read from files and filtered, projected or united only, so that its tasks are known without a run."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "Union", "Generate", "LogicalRDD", "LocalRelation") and not node.nodeName().startswith(("Relation", "LogicalRelation")):
            return False
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return True


def spread(df: DataFrame, *key: Column | str) -> DataFrame:
    """Rows dealt over at least as many tasks as there are cores; no shuffle where the scan has that many.

    Meant before Python steps that cost much more than moving their input. What comes out of a shuffle stays as it is: its
    tasks are as many as the session wants, and counting them would run the stages before.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if not _only_scans(df) or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want * 2, *key) if key else df.repartition(want * 2)


#: Share of a frame's rows, one in so many, above which a key is split; so many keys at most can be above it.
HOT = 1000


def hot_keys(many: DataFrame, key: str) -> DataFrame:
    """(key, _salts) of the keys with more than one in HOT rows of many: fewer than HOT, whatever the size, so that their
    table may be broadcast. Reads ``many`` twice: it should be a table of files."""
    total = many.count()
    shares = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total)
    rows = [(r[0], -(-r[1] * HOT // total)) for r in shares.collect()]
    return many.sparkSession.createDataFrame(rows, T.StructType([T.StructField(key, many.schema[key].dataType), T.StructField("_salts", T.LongType())]))


def dealt(many: DataFrame, hot: DataFrame, key: str, salt: str) -> DataFrame:
    """many with ``_salt``, by which the rows of a hot key are dealt out by a hash of the column ``salt``."""
    salts = F.coalesce("_salts", F.lit(1))
    return many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt), salts)).drop("_salts")


def copied(one: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """one, with one row a key, repeated for each salt of a hot key."""
    salts = F.coalesce("_salts", F.lit(1))
    return one.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")


def join_one(many: DataFrame, one: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has one row a key, so that no task gets more than about one in HOT rows of many."""
    hot = hot_keys(many, key)
    return dealt(many, hot, key, salt).join(copied(one, hot, key), [key, "_salt"], how).drop("_salt")


def clean_strip(c: Column) -> Column:
    """White space of any script cut from both ends (plain ``trim`` cuts spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
