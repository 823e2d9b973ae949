"""Helpers shared by the corpus operators: durable cut points, id joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many are broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 400_000
#: Spark's setting that deletes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only a session without
    one (a local test) gets a temporary folder of its own.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like ``cut`` by a Parquet table in that folder, which takes less room for many short rows; ``erase`` its path when done.

    The shuffle files behind the table are deleted as soon as it is written: it takes their place.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def erase(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (one column of the same name, distinct).

    The ids are broadcast only when their counted number is at most
    ``BROADCAST_IDS``; a longer list is joined by a shuffle, with equal results.
    """
    n = ids.count() if n_ids is None else n_ids
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge"), key, "left_semi")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``, so that further columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def components(edges: DataFrame, u: str = "a", v: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list.

    Alternating large-star and small-star contraction: each round is one
    aggregation and one join a star, all keyed and split by Spark, and the number
    of rounds grows with the logarithm of the longest path. ``component`` is the
    smallest node that can be reached.
    """
    now = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi <> lo").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    def large_star(df: DataFrame) -> DataFrame:
        both = df.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(df.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        return both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).where("hi <> lo").distinct()

    def small_star(df: DataFrame) -> DataFrame:
        least = df.groupBy("hi").agg(F.min("lo").alias("low"))
        moved = df.join(least, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        return moved.union(least.select("hi", F.col("low").alias("lo"))).distinct()

    spark = edges.sparkSession
    now, path = stored(now)
    before = state(now)
    for _ in range(max_rounds):
        new, new_path = stored(small_star(large_star(now)))
        erase(spark, path)
        now, path = new, new_path
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def arrow_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
