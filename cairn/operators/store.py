"""Scans, filters, upserts and edges of a record store held as DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def page(records: DataFrame, project: str | None = None, kind: str | None = None, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Records that meet the given predicates, newest first, one page of them."""
    for column, value in (("project_id", project), ("type", kind), ("status", status)):
        if value is not None:
            records = records.where(F.col(column) == value)
    return records.orderBy(F.desc("created_at"), F.asc("id")).offset(offset).limit(limit)


def lookup(records: DataFrame, wanted: DataFrame, kind: str | None = None) -> DataFrame:
    """Records by id for a batch of wanted ids, of one type if it is given."""
    found = wanted.join(records, "id")
    return found if kind is None else found.where(F.col("type") == kind)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Both together, one row a key: the last by ``order`` wins."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return stored.unionByName(incoming).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows to add: first of each key in the batch, unless stored already."""
    w = Window.partitionBy(*keys).orderBy(order)
    return incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(stored.select(*keys).distinct(), keys, "left_anti")


def edges(relations: DataFrame, source: str = "", target: str = "", kind: str = "") -> DataFrame:
    """Edges by any of source, target and type; an empty string asks for nothing."""
    for column, value in (("source_id", source), ("target_id", target), ("relation_type", kind)):
        if value != "":
            relations = relations.where(F.col(column) == value)
    return relations


def incident(relations: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, edge columns) of the edges at each of ``ids``; a loop comes once."""
    out = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id").withColumn("id", F.col("source_id"))
    into = relations.join(ids.withColumnRenamed("id", "target_id"), "target_id").withColumn("id", F.col("target_id"))
    if direction == "source":
        return out
    if direction == "target":
        return into
    return out.unionByName(into.where("source_id <> target_id"))


def degree(relations: DataFrame) -> DataFrame:
    """(id, degree): edges at either end, a loop once."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return relations.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def capped_degree(d: Column, most: float) -> Column:
    return F.least(F.coalesce(d, F.lit(0)) * 0.1, F.lit(most))


def related(relations: DataFrame, ids: DataFrame, most: int = 2) -> DataFrame:
    """The first neighbours of each id, itself left out, in the order of edges."""
    both = relations.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "rank").union(relations.select(F.col("target_id"), F.col("source_id"), "rank")).where("id <> other")
    first = both.join(ids, "id").groupBy("id", "other").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("id").orderBy("rank", "other")
    return first.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).drop("rank")


def newest(records: DataFrame, n: int, *groups: str) -> DataFrame:
    """The newest n records of each group, with their ``place``.

    First of each of 64 parts of a group, then of what these leave: no task sorts a whole group.
    """
    order = [F.desc("created_at"), F.asc("id")]
    part = records.withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(64)))
    near = part.withColumn("__p", F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))).where(F.col("__p") <= n)
    return near.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= n).drop("__part", "__p")


def chains(links: DataFrame) -> DataFrame:
    """(id, root, depth) along ``links`` (id, supersedes): how far each record's chain goes back.

    Pointer doubling until no pointer moves: a chain of n records takes log n rounds,
    whatever n. A row whose target is at its root is done and joins no more. What
    still moves after so many rounds that any chain had ended leads into a cycle:
    such records get some record of the cycle and a null depth.
    """
    now = cut(links.select("id", F.col("supersedes").alias("at"), F.when(F.col("supersedes").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("supersedes").isNotNull().alias("live")))
    rounds = now.count().bit_length() + 1
    for _ in range(rounds):
        if now.where("live").isEmpty():
            break
        up = now.where("at IS NOT NULL").select(F.col("id").alias("at"), F.col("at").alias("up"), F.col("depth").alias("more"), F.col("live").alias("on"))
        moved = now.where("live").join(up, "at", "left").select("id", F.coalesce("up", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("on", F.lit(False)).alias("live"))
        now = cut(now.where("NOT live").union(moved))
    return now.select("id", F.coalesce("at", "id").alias("root"), F.when(~F.col("live"), F.col("depth")).alias("depth"))


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared checkpoint folder, so that a loop's plan doesn't grow."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return df.checkpoint(eager=True)


def digest(records: DataFrame, kind: str, key: str) -> DataFrame:
    """A digest of the state that doesn't depend on row order: the SHA-256 of the sorted digests of parts."""
    parts = records.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2).alias("part"), F.sha2(F.concat_ws("|", F.col(key).cast("string"), kind), 256).alias("h"))
    parts = parts.groupBy("part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("part", "h"))), ""), 256).alias("digest"), F.sum("n").alias("n_records"))
