"""A record store in a folder that Spark reaches: versioned Parquet tables of records, relations and projects.

Every write makes a new version of a table beside the old one, so readers of the old
version are not disturbed and a failed write leaves nothing that is read. Writes are batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as ops
from . import datasets

SCHEMAS = {"records": datasets.RECORD, "relations": datasets.RELATION, "projects": datasets.PROJECT}
ORDER = {"records": "id", "relations": "id", "projects": "id"}
#: Columns of a record that every type has; the others are its type's own.
ENVELOPE = ("id", "type", "content", "project_id", "created_at", "valid_from", "valid_to", "status", "confidence", "entities", "version", "supersedes", "superseded_by", "metadata")
# The columns that each type has besides the envelope, and the phases of an episode in order.
OWN = {"fact": ("assertion", "fact_status"), "decision": ("decision_status", "justification"), "hypothesis": ("hypothesis_state", "prediction"), "evidence": ("location", "limitations"), "checkpoint": ("current_state",), "document": ("is_normative",)}
PHASES = ("goal", "context", "hypothesis", "decision", "action", "error", "evidence", "correction", "result", "lesson")
SNAPSHOT = "snapshot-"


def split_envelope(records: DataFrame) -> DataFrame:
    """The envelope's columns, and all others that are not null as one JSON text, ``extra``."""
    own = [c for c in records.columns if c not in ENVELOPE]
    return records.select(*[c for c in records.columns if c in ENVELOPE], F.to_json(F.struct(*own)).alias("extra") if own else F.lit("{}").alias("extra"))


def merge_envelope(stored: DataFrame, own: str) -> DataFrame:
    """``split_envelope`` undone; ``own`` is the schema of the columns in ``extra``."""
    return stored.select(*[c for c in stored.columns if c != "extra"], F.from_json("extra", own).alias("__x")).select("*", "__x.*").drop("__x")


def typed(records: DataFrame, kind: str) -> DataFrame:
    """The records of one type, with the envelope and the columns of that type."""
    return records.where(F.col("type") == kind).select(*[c for c in records.columns if c in ENVELOPE or c in OWN.get(kind, ())])


def causal_chain(episodes: DataFrame) -> DataFrame:
    """(id, place, phase, text): the phases of an episode that aren't blank, in order; lists are joined by line ends."""
    kinds = dict(episodes.dtypes)
    text = lambda c: F.array_join(F.col(c), "\n") if kinds[c].startswith("array") else F.col(c).cast("string")
    have = [p for p in PHASES if p in kinds]
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("place"), F.lit(p).alias("phase"), text(p).alias("text")) for i, p in enumerate(have)]))
    return episodes.select("id", each.alias("p")).select("id", "p.*").where("text IS NOT NULL AND trim(text) <> ''")


class Store:
    """Opens a store; ``init`` creates what is missing and changes nothing that is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _versions(self, table: str) -> list[int]:
        where = self._path(table)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(self._path(table, n, "_SUCCESS")))

    def init(self) -> None:
        for table, schema in SCHEMAS.items():
            if not self._versions(table):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{table}/v0")

    def read(self, table: str) -> DataFrame:
        versions = self._versions(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}/v{versions[-1]}") if versions else self.spark.createDataFrame([], SCHEMAS[table])

    def _write(self, table: str, df: DataFrame) -> None:
        n = max(self._versions(table), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/v{n}")

    def save(self, table: str, rows: DataFrame) -> None:
        """Upsert: of rows with one id the new one is kept, and of several new ones any that the batch holds last by ``created_at``."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        new = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)
        both = self.read(table).withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)))
        order = F.struct("__seq", F.col("created_at")) if "created_at" in both.columns else F.struct("__seq")
        self._write(table, ops.upsert(both.where("__seq = 0").withColumn("__o", order), both.where("__seq = 1").withColumn("__o", order), "id", "__o").drop("__seq", "__o"))

    def add(self, table: str, rows: DataFrame, keys: list[str], replace: bool = False) -> dict[str, int]:
        """Insert rows whose keys aren't stored; with ``replace`` these take the stored rows' place. Counts of created and skipped rows."""
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        new = empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns)
        now = self.read(table)
        fresh = ops.insert_absent(now.limit(0) if replace else now, new, keys, "id").persist()
        n, offered = fresh.count(), rows.count()
        if n:
            self._write(table, now.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))
        fresh.unpersist()
        return {"created": n, "skipped": offered - n}

    def get(self, ids: DataFrame | list[str], table: str = "records", kind: str | None = None) -> DataFrame:
        """Rows by id, of one type if it is given; ids are a list or, for many, a DataFrame with a column id."""
        rows = self.read(table)
        rows = rows.where(F.col("id").isin(list(ids))) if isinstance(ids, list) else rows.join(ids.select("id").distinct(), "id")
        return rows if kind is None else rows.where(F.col("type") == kind)

    def export(self, path: str) -> None:
        datasets.export_store(path, **{t: self.read(t) for t in SCHEMAS})

    def load(self, path: str) -> None:
        """Upsert of an exported store."""
        for table, df in datasets.import_store(self.spark, path, **SCHEMAS).items():
            self.save(table, df)

    def load_dataset(self, path: str) -> None:
        records, relations, projects = datasets.read_dataset(self.spark, path)
        for table, df in (("records", records), ("relations", relations), ("projects", projects)):
            self.save(table, df)

    def snapshot(self, label: str) -> None:
        """The present state under a name; ``Store.at`` reads it."""
        for table in SCHEMAS:
            self.read(table).write.mode("overwrite").parquet(f"{self.folder}/{SNAPSHOT}{label}/{table}/v0")

    def at(self, label: str) -> Store:
        return Store(self.spark, f"{self.folder}/{SNAPSHOT}{label}")


def is_given(c: Column) -> Column:
    return c.isNotNull() & (c != "")
