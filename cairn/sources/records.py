"""Project files and commits as records and edges: segments with stable ids, provenance, parents and a symbol index."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from . import files

# The version that records carry, lengths at which texts are cut, and rules of segmentation.
PIPELINE = "1.1.0"
CONTENT, DOC, VALUE, IMPORTS, DECORATORS, ERRORS, SHORT_RESULT = 5000, 1000, 2000, 20, 10, 50, 200
RULES = {"markdown": "heading-based segmentation", "python": "AST-based module/class/function extraction", "toml": "top-level table/key extraction", "yaml": "top-level key extraction", "json": "top-level key extraction"}
PART_OF, DERIVED = "part_of", "derived_from"
RECORD = "id string, type string, content string, project_id string, status string, metadata map<string,string>"
EDGE = "id string, source_id string, target_id string, relation_type string"


class Ingested(NamedTuple):
    records: DataFrame
    edges: DataFrame


def rule(kind: Column) -> Column:
    """How a file of a type is segmented."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), kind), F.lit("single-segment"))


def segment_estimate(kind: Column, content: Column) -> Column:
    """About how many segments a file gives; 0 for a blank one. Configuration in other formats than JSON counts as one."""
    times = lambda p: F.regexp_count(content, F.lit(p))
    keys = F.coalesce(F.json_object_keys(content).isNotNull().cast("int") * F.size(F.coalesce(F.json_object_keys(content), F.array())), F.lit(1))
    n = F.when(kind == "markdown", times("\n#") + 1).when(kind == "python", times("\n(?:async )?def ") + times("\nclass ") + 1).when(kind == "json", keys).otherwise(F.lit(1))
    return F.when(F.trim(F.regexp_replace(content, r"\s+", " ")) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), n)).cast("long")


def identity(project: Column, path: Column, sha256: Column, commit: Column) -> Column:
    """Where a file came from."""
    return F.struct(project.alias("project_id"), path.alias("relative_path"), sha256.alias("sha256"), commit.alias("commit_sha"))


def provenance(entry: dict[str, Column], extra: Column) -> Column:
    """The metadata that every ingested record carries; what the segment adds wins."""
    own = F.create_map(*[x for k, v in entry.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(F.map_concat(F.map_filter(own, lambda k, _: ~F.coalesce(F.map_contains_key(extra, k), F.lit(False))), extra), lambda _, v: v.isNotNull())


def _record(rows: DataFrame, project: str, commit: str, at: Column) -> DataFrame:
    """Rows with id, type, content, path, file_type, sha256 and ``extra`` as records."""
    text = F.substring("content", 1, CONTENT)
    entry = {
        "source_type": F.lit("git-tracked-file"), "source_path": F.col("path"), "source_sha256": F.col("sha256"), "source_commit_sha": F.lit(commit), "language": F.col("file_type"),
        "ingestion_pipeline_version": F.lit(PIPELINE), "ingested_at": at, "content_fingerprint": F.sha2(text, 256), "operational_status": F.lit("active"),
    }
    return rows.select("id", "type", text.alias("content"), F.lit(project).alias("project_id"), F.lit("verified").alias("status"), provenance(entry, F.col("extra")).alias("metadata"))


def _map(**values: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())


def _id(project: str, *parts: Column) -> Column:
    return ids.stable_id(F.lit(project), *[F.coalesce(p, F.lit("")) for p in parts])


def edge(source: Column, target: Column, kind: str) -> list[Column]:
    return [ids.stable_id(source, target, F.lit(kind)).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("relation_type")]


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """One row an id, the first in order."""
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), F.struct(*order)).alias("r")).select("id", "r.*")


def markdown_sections(content: str) -> list[tuple[list[str], int, int, int, str]]:
    """(chain of headings, level, first line, last line, text) of a Markdown text, lines from 1; a section ends before the next heading, also inside a code fence."""
    lines, found, stack = content.split("\n"), [], []
    for k, line in enumerate(lines):
        mark, _, title = line.partition(" ") if line[:1] == "#" else ("", "", "")
        if not mark and line[:1] == "#":
            continue
        level = len(mark)
        if 1 <= level <= 6 and mark == "#" * level and title.strip():
            stack = [s for s in stack if s[0] < level] + [(level, title.strip())]
            found.append(([t for _, t in stack], level, k))
    out = []
    first = found[0][2] if found else len(lines)
    if any(x.strip() for x in lines[:first]):
        out.append(([], 0, 1, first, "\n".join(lines[:first])))
    for (chain, level, at), end in zip(found, [f[2] for f in found[1:]] + [len(lines)]):
        out.append((chain, level, at + 1, end, "\n".join(lines[at:end])))
    return out


def from_markdown(sources: DataFrame, project: str, commit: str, at: Column) -> Ingested:
    """A document record a file, one a heading (headings of the same name in a file are one, the first), and part-of edges."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(path, kind, sha, *s) for path, kind, sha, c in zip(p["path"], p["file_type"], p["sha256"], p["content"]) for s in markdown_sections(c or "")], columns=["path", "file_type", "sha256", "chain", "level", "line", "until", "content"])

    rows = sources.select("path", "file_type", "sha256", "content").mapInPandas(run, "path string, file_type string, sha256 string, chain array<string>, level long, line long, until long, content string")
    doc = lambda: _id(project, F.col("path"), F.lit("document"), F.lit(""))
    heading = F.coalesce(F.try_element_at("chain", F.lit(-1)), F.col("path"))
    extra = _map(source_heading=F.array_join("chain", " > "), qualified_name=heading, source_line_start=F.col("line"), source_line_end=F.col("until"), heading_level=F.col("level"))
    sections = _first(rows.select(_id(project, F.col("path"), F.lit("section"), heading).alias("id"), F.lit("document").alias("type"), "content", "path", "file_type", "sha256", extra.alias("extra"), "line"), "line")
    n = rows.groupBy("path").agg(F.count("*").alias("n"))
    whole = sources.join(n, "path")
    whole_extra = _map(source_heading=F.col("path"), qualified_name=F.col("path"), source_line_start=F.lit(1), source_line_end=F.regexp_count("content", F.lit("\n")) + 1, segment_count=F.col("n"))
    docs = whole.select(doc().alias("id"), F.lit("document").alias("type"), "content", "path", "file_type", "sha256", whole_extra.alias("extra"))
    edges = sections.select(*edge(F.col("id"), doc(), PART_OF))
    return Ingested(_record(docs.unionByName(sections.drop("line")), project, commit, at), edges)


def from_python(sources: DataFrame, project: str, commit: str, at: Column) -> Ingested:
    """A fact a module, class, function, method or command, and part-of edges to the class or module that holds it."""
    text = ["path", "kind", "name", "parent", "line", "until", "signature", "doc", "command", "option"]
    entities = files.python_segments(sources).join(sources.select("path", "file_type", "sha256", "content"), "path")
    module = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")
    name = F.when(F.col("kind") == "module", module).otherwise(F.concat(module, F.lit("."), "name"))
    body = F.array_join(F.slice(F.split("content", "\n"), F.greatest(F.col("line"), F.lit(1)).cast("int"), F.greatest(F.lit(1), F.col("until") - F.col("line") + 1).cast("int")), "\n")
    rows = entities.select(*text, "file_type", "sha256", body.alias("content"), name.alias("qualified"), module.alias("module"))
    last = F.element_at(F.split("name", r"\."), -1)
    of = lambda kind: F.when(F.col("kind") == kind, last)
    extra = _map(
        source_heading=F.col("qualified"), qualified_name=F.col("qualified"), signature=F.nullif(F.col("signature"), F.lit("")), docstring=F.substring("doc", 1, DOC), source_line_start=F.col("line"), source_line_end=F.col("until"),
        entity_type=F.col("kind"), symbol_kind=F.col("kind"), module_name=F.col("module"), class_name=F.when(F.col("kind") == "class", last).when(F.col("kind") == "method", F.col("parent")), function_name=F.coalesce(of("function"), of("command")), method_name=of("method"),
        cli_command=F.col("command"), cli_option=F.col("option"),
    )
    own = _id(project, F.col("path"), F.col("kind"), F.col("qualified"))
    rec = _first(rows.select(own.alias("id"), F.lit("fact").alias("type"), "content", "path", "file_type", "sha256", extra.alias("extra"), "line", "kind", "parent", "qualified", "module"), "line")
    # A method of a top-level class hangs on the module, like classes and functions; what lies deeper on the class that holds it.
    depth = F.size(F.split("parent", r"\."))
    holder = F.when((F.col("kind") == "method") & (depth > 1), F.concat("module", F.lit("."), F.regexp_replace("parent", r"\.[^.]*$", ""))).when((F.col("kind") != "method") & F.coalesce(F.col("parent") != "", F.lit(False)), F.concat("module", F.lit("."), "parent"))
    child = rec.where("kind <> 'module'").withColumn("holder", holder)
    classes = rec.where("kind = 'class'").select(F.col("path").alias("p2"), F.col("qualified").alias("holder2"), F.col("id").alias("class_id"))
    up = child.join(classes, (F.col("path") == F.col("p2")) & (F.col("holder") == F.col("holder2")), "left")
    edges = up.select(*edge(F.col("id"), F.coalesce("class_id", _id(project, F.col("path"), F.lit("module"), F.col("module"))), PART_OF))
    return Ingested(_record(rec, project, commit, at), edges)


def from_config(sources: DataFrame, project: str, commit: str, at: Column) -> Ingested:
    """A fact a file and one a top-level key, and part-of edges."""
    segments = files.config_segments(sources).join(sources.select("path", F.col("file_type"), "sha256"), "path")
    whole_id = lambda: _id(project, F.col("path"), F.lit("config"), F.lit(""))
    extra = _map(source_heading=F.col("key"), qualified_name=F.col("key"), config_section=F.col("key"), config_value=F.substring("value", 1, VALUE), config_format=F.col("file_type"))
    keys = _first(segments.select(_id(project, F.col("path"), F.lit("config_key"), F.col("key")).alias("id"), F.lit("fact").alias("type"), F.concat("key", F.lit(" = "), "value").alias("content"), "path", "file_type", "sha256", extra.alias("extra"), "value"), "value")
    n = segments.groupBy("path").agg(F.count("*").alias("n"))
    whole_extra = _map(source_heading=F.col("path"), qualified_name=F.col("path"), source_line_start=F.lit(1), source_line_end=F.regexp_count("content", F.lit("\n")) + 1, config_format=F.col("file_type"), segment_count=F.col("n"))
    whole = sources.join(n, "path").select(whole_id().alias("id"), F.lit("fact").alias("type"), "content", "path", "file_type", "sha256", whole_extra.alias("extra"))
    return Ingested(_record(whole.unionByName(keys.drop("value")), project, commit, at), keys.select(*edge(F.col("id"), whole_id(), PART_OF)))


def from_commits(commits: DataFrame, project: str, commit: str, at: Column) -> Ingested:
    """An evidence record a commit, and derived-from edges to the parents that are there."""
    sha = F.col("sha")
    cid = lambda c: _id(project, F.lit("git_history"), F.lit("commit"), c)
    col = lambda n: F.col(n) if n in commits.columns else F.lit(None).cast("string")
    extra = _map(
        entity_type=F.lit("commit"), symbol_kind=F.lit("commit"), commit_sha=sha, commit_short_sha=F.substring(sha, 1, 7), commit_message=F.substring("message", 1, VALUE), commit_author=F.col("author"), commit_date=F.col("date"),
        commit_parents=F.array_join("parents", " "), commit_files_changed=col("files"), commit_insertions=col("insertions"), commit_deletions=col("deletions"), source_heading=F.concat(F.lit("commit "), F.substring(sha, 1, 7)), qualified_name=sha,
    )
    rows = commits.select(cid(sha).alias("id"), F.lit("evidence").alias("type"), F.col("message").alias("content"), F.lit("git_history").alias("path"), F.lit("git").alias("file_type"), sha.alias("sha256"), extra.alias("extra"))
    up = commits.select("sha", F.explode("parents").alias("parent")).join(commits.select(F.col("sha").alias("parent")).distinct(), "parent")
    return Ingested(_record(rows, project, commit, at), up.select(*edge(cid(F.col("sha")), cid(F.col("parent")), DERIVED)).distinct())


READERS = {"markdown": from_markdown, "python": from_python, "toml": from_config, "yaml": from_config, "json": from_config}


def ingest(sources: DataFrame, project: str, commit: str = "unknown", at: Column | None = None, commits: DataFrame | None = None) -> Ingested:
    """Records and edges of all included files of a manifest, each type by its own reader, and of commits."""
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if at is None else at
    spark = sources.sparkSession
    records, edges = spark.createDataFrame([], RECORD), spark.createDataFrame([], EDGE)
    known = sources.where("status = 'included'") if "status" in sources.columns else sources
    for reader in dict.fromkeys(READERS.values()):
        kinds = [k for k, r in READERS.items() if r is reader]
        part = reader(known.where(F.col("file_type").isin(*kinds)), project, commit, at)
        records, edges = records.unionByName(part.records), edges.unionByName(part.edges)
    if commits is not None:
        part = from_commits(commits, project, commit, at)
        records, edges = records.unionByName(part.records), edges.unionByName(part.edges)
    return Ingested(records, edges.dropDuplicates(["id"]))


def run(store, sources: DataFrame, project: str, commit: str = "unknown", commits: DataFrame | None = None, dry: bool = False, force: bool = False, include: str | None = None, exclude: str | None = None) -> tuple[DataFrame, dict]:
    """Manifest, records, edges into a store: (manifest, report). A second run adds nothing; a dry one stops after the manifest."""
    listed = files.manifest(sources, include, exclude).withColumns({"segmentation_rule": rule(F.col("file_type")), "estimated_segments": segment_estimate(F.col("file_type"), F.coalesce("content", F.lit("")))})
    report = {"files": {r["status"]: r["n"] for r in listed.groupBy("status").agg(F.count("*").alias("n")).collect()}, "commit_sha": commit, "pipeline_version": PIPELINE, "dry_run": dry, "errors": []}
    reasons = listed.where("status = 'excluded'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(ERRORS)
    report["excluded"] = {r["reason"]: r["n"] for r in reasons.collect()}
    if not dry:
        found = ingest(listed, project, commit, commits=commits)
        report["records"] = store.add("records", found.records, ["id"], replace=force)
        report["relations"] = store.add("relations", found.edges, ["source_id", "target_id", "relation_type"])
    return listed, report


def symbol_index(records: DataFrame) -> DataFrame:
    """One row a record with structured metadata: its names, the forms of its symbol, its option's canonical form and its group."""
    m = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    names = ("entity_type", "qualified_name", "source_path", "source_heading", "language", "module_name", "class_name", "function_name", "method_name", "symbol_kind", "cli_command", "cli_option", "file_role")
    out = records.where(F.size(F.coalesce("metadata", F.create_map().cast("map<string,string>"))) > 0).select(F.col("id").alias("memory_id"), *[m(n).alias(n) for n in names])
    symbol = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("source_heading"))
    return out.withColumns({
        "symbol_normalized": F.when(symbol != "", ids.symbol_forms(symbol)).otherwise(F.array().cast("array<string>")),
        "cli_option_normalized": F.when(F.col("cli_option") != "", ids.cli_option(F.col("cli_option"))).otherwise(F.lit("")), "group_id": F.col("source_path"),
    })


def as_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json) of each row."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias("json"))


def write_manifest(listed: DataFrame, path: str) -> None:
    listed.drop("content").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, size_bytes long, sha256 string, file_type string, reason string, status string, segmentation_rule string, estimated_segments long").json(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A run's report as one JSON row; at most the first ``ERRORS`` errors are listed."""
    spark.createDataFrame([(json.dumps({**report, "errors": report.get("errors", [])[:ERRORS]}, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()[:200]}")
    return done.stdout


def head(root: str) -> str:
    """The commit that is checked out; ``unknown`` where there is none or no git."""
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (RuntimeError, OSError, subprocess.TimeoutExpired):
        return "unknown"


def tracked(root: str) -> list[str] | None:
    """The paths that git tracks; None where there is no git to ask, and the folder is walked instead."""
    try:
        return [x for x in _git(root, "ls-files", "-z").split("\0") if x]
    except (RuntimeError, OSError, subprocess.TimeoutExpired):
        return None


def read_project(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes, sha256): the files that git tracks, or all of them."""
    found, names = files.read_project(spark, root), tracked(root)
    return found if names is None else found.join(spark.createDataFrame([(n,) for n in names], "path string"), "path")


def read_commits(spark: SparkSession, root: str, since: str | None = None, most: int = 50) -> DataFrame:
    """(sha, parents, author, date, message, files, insertions, deletions): commits after ``since``, or else the last ``most``. One driver process, as git has the history."""
    span = [f"{since}..HEAD"] if since else [f"-{most}"]
    out = _git(root, "log", *span, "--shortstat", "--format=%x1e%H%x1f%P%x1f%an%x1f%aI%x1f%B%x1f")
    rows = []
    for r in out.split("\x1e")[1:]:
        sha, parents, author, date, message, stat = r.split("\x1f")
        counts = dict.fromkeys(("file", "insertion", "deletion"), 0)
        for part in stat.strip().split(","):
            n, _, what = part.strip().partition(" ")
            for k in counts:
                if what.startswith(k):
                    counts[k] = int(n)
        rows.append((sha, parents.split(), author, date, message.strip(), *counts.values()))
    return spark.createDataFrame(rows, "sha string, parents array<string>, author string, date string, message string, files long, insertions long, deletions long")


def result_json(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, json): each query's rows as one JSON list, contents cut short."""
    row = F.struct("rank", *[F.substring(F.col(k), 1, SHORT_RESULT).alias(k) if k == "content" else F.col(k) for k in keys if k != "rank"])
    return ranked.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a text table."""
    return df._show_string(rows, 80, False)
