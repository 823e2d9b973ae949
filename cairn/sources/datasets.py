"""JSON datasets, query sets, store export and import, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = """id string, type string, content string, project_id string, created_at timestamp, valid_from timestamp, valid_to timestamp, status string, confidence string,
entities array<struct<name:string,entity_type:string>>, version int, supersedes string, superseded_by string, metadata map<string,string>, assertion string, fact_status string,
decision_status string, justification string, hypothesis_state string, prediction string, location string, limitations string, current_state string, is_normative boolean"""
RELATION = "id string, source_id string, target_id string, relation_type string, confidence string, created_at timestamp"
PROJECT = "id string, name string, description string"
QUERY = "query_id string, query string, expected_ids array<string>, expected_project_id string, relevance_grades map<string,double>, expected_conflicts array<string>"
# The types of records and relations.
TYPES = ("fact", "decision", "hypothesis", "evidence", "learning", "episode", "checkpoint", "document")
RELATIONS = ("supports", "supported_by", "contradicted_by", "supersedes", "derived_from", "caused_by", "resolved_by", "part_of", "references", "similar_to", "summarizes", "occurred_during", "related_to")


def _struct(fields: str) -> str:
    out, depth, part = [], 0, ""
    for c in fields.replace("\n", " ") + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.split(maxsplit=1)
            out.append(f"{name}:{kind.strip()}")
            part = ""
        else:
            part += c
    return "struct<" + ",".join(out) + ">"


def default_content() -> Column:
    """The content of a record that has none: from its assertion, justification, prediction or evidence."""
    evidence = F.concat_ws(" | ", F.nullif(F.col("location"), F.lit("")), F.nullif(F.col("limitations"), F.lit("")))
    own = F.when(F.col("type") == "fact", F.col("assertion")).when(F.col("type") == "decision", F.col("justification")).when(F.col("type") == "hypothesis", F.col("prediction")).when(F.col("type") == "evidence", evidence).when(F.col("type") == "checkpoint", F.col("current_state"))
    return F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, F.coalesce(own, F.lit(""))).otherwise(F.col("content"))


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, relations, projects) of a JSON dataset; records of unknown type raise when read."""
    schema = f"projects array<{_struct(PROJECT)}>, memories array<{_struct(RECORD)}>, relations array<{_struct(RELATION)}>"
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    r = raw.select(F.inline("memories")).withColumn("content", default_content())
    r = r.withColumn("type", F.when(F.col("type").isin(*TYPES), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown record type: "), F.coalesce("type", F.lit("null"))))))
    return r, raw.select(F.inline("relations")), raw.select(F.inline("projects"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"queries array<{_struct(QUERY)}>").json(path)
    q = F.coalesce(F.col("queries"), F.raise_error(F.lit("no queries in the file")).cast(f"array<{_struct(QUERY)}>"))
    return raw.select(F.inline(q))


def export_store(folder: str, **tables: DataFrame) -> None:
    """Each table as JSON lines in a folder of its own; ``import_store`` reads them back."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def import_store(spark: SparkSession, folder: str, **schemas: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def markdown_report(title: str, metrics: DataFrame) -> str:
    """A small table of aggregates as Markdown; for aggregates only, since it is collected."""
    rows = metrics.collect()
    head = f"# {title}\n\n| {' | '.join(metrics.columns)} |\n|{'---|' * len(metrics.columns)}\n"
    return head + "".join("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |\n" for r in rows)


def resumption_prompt(capsule: DataFrame, query_id) -> str:
    """One query's capsule as text, layer by layer."""
    rows = capsule.where(F.col("query_id") == query_id).orderBy("layer_ord", "place").collect()
    out, layer = [], None
    for r in rows:
        if r["layer"] != layer:
            layer = r["layer"]
            out.append(f"## {layer}")
        out.append(f"- [{r['id']}] {(r['content'] or '')[:200]}")
    return "\n".join(out)
