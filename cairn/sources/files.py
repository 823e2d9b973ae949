"""Project files as records: manifest, exclusions, secrets, segments of Markdown, Python and configuration."""

from __future__ import annotations

import ast
import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import stable_id

# What is left out of a project, and file types.
FOLDERS = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", "dist", "build", ".mypy_cache", ".ruff_cache", "node_modules", "cache")
EXTENSIONS = (
    ".db", ".sqlite", ".sqlite3", ".pyc", ".pyo", ".so", ".dll", ".pyd", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot",
    ".zip", ".tar", ".gz", ".bz2", ".7z", ".exe", ".bin", ".dmg", ".pdf", ".lock",
)
NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
TYPES = {".md": "markdown", ".py": "python", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json"}
API_KEY = r"(?i)(?:api[_-]?key|secret|token|password)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}"
PRIVATE_KEY = "-----BEGIN [A-Z ]*PRIVATE KEY-----"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def file_type(path: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension(path)), F.lit("other"))


def exclusion(path: Column, prefixes: tuple[str, ...] = (), folders: tuple[str, ...] = FOLDERS) -> Column:
    """Why a file is left out: the first reason that holds, else null. ``prefixes`` are a project's own paths to leave out."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    prefix = F.lit(False)
    for p in prefixes:
        prefix = prefix | F.startswith(path, F.lit(p))
    return (
        F.when(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in folders])), "excluded folder").when(extension(path).isin(*EXTENSIONS), "excluded extension").when(name.isin(*NAMES), "excluded name")
        .when(prefix, "excluded prefix").when(file_type(path) == "other", "unsupported type")
    )


def secret_reasons(name: Column, content: Column) -> Column:
    """Why content must not be read on; the reasons never hold the secret."""
    base = F.element_at(F.split(F.coalesce(name, F.lit("")), "/"), -1)
    return F.array_compact(F.array(
        F.when(F.rlike(base, F.lit(r"^\.env(\..*)?$")), "blocked filename"), F.when(F.endswith(F.lower(base), F.lit(".key")), "blocked extension"),
        F.when(F.rlike(content, F.lit(API_KEY)), "api_key_pattern"), F.when(F.rlike(content, F.lit(PRIVATE_KEY)), "private_key"),
    ))


def read_project(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes, sha256) of all files under a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(F.regexp_replace("path", "^.*?" + root.strip("/").replace(".", r"\.") + "/", "").alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(files: DataFrame, include: str | None = None, exclude: str | None = None, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Files with type, reason for exclusion and status; ``include`` and ``exclude`` are patterns on paths, ``prefixes`` paths to leave out."""
    reason = exclusion(F.col("path"), prefixes)
    if include:
        reason = F.coalesce(reason, F.when(~F.rlike("path", F.lit(include)), "not included"))
    if exclude:
        reason = F.coalesce(reason, F.when(F.rlike("path", F.lit(exclude)), "excluded by pattern"))
    secrets = secret_reasons(F.col("path"), F.col("content"))
    reason = F.coalesce(reason, F.when(F.size(secrets) > 0, F.concat(F.lit("secret: "), F.array_join(secrets, ", "))))
    return files.withColumns({"file_type": file_type(F.col("path")), "reason": reason}).withColumn("status", F.when(F.col("reason").isNull(), "included").otherwise("excluded"))


def markdown_segments(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, heading, until): headings with their first line (from 1) and the line before the next heading."""
    lines = docs.select(key, F.size(F.split(text, "\n", -1)).alias("n"), F.posexplode(F.split(text, "\n", -1)).alias("at", "x"))
    heads = lines.where(F.rlike("x", F.lit(r"^#{1,6}\s+.+$"))).select(key, "n", (F.col("at") + 1).cast("long").alias("line"), F.length(F.regexp_extract("x", r"^(#{1,6})\s", 1)).cast("long").alias("level"), F.trim(F.regexp_extract("x", r"^#{1,6}\s+(.+)$", 1)).alias("heading"))
    w = Window.partitionBy(key).orderBy("line")
    return heads.withColumn("until", F.coalesce(F.lead("line").over(w) - 1, F.col("n").cast("long"))).drop("n")


def _signature(node) -> str:
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)})"


def python_entities(source: str) -> list[tuple]:
    """(kind, name, parent, line, end, signature, doc, command, option); none for source that doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    out = [("module", "", None, 1, len((source or "").splitlines()), "", ast.get_docstring(tree) or "", None, None)]

    def visit(node, parent: str) -> None:
        for child in getattr(node, "body", []):
            if not isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            name = f"{parent}.{child.name}" if parent else child.name
            if isinstance(child, ast.ClassDef):
                out.append(("class", name, parent, child.lineno, child.end_lineno, f"class {child.name}", ast.get_docstring(child) or "", None, None))
                visit(child, name)
                continue
            command = option = None
            for d in child.decorator_list:
                call = d.func if isinstance(d, ast.Call) else d
                first = d.args[0].value if isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant) else None
                if isinstance(call, ast.Attribute) and call.attr == "command":
                    command = str(first) if first else child.name.replace("_", "-")
                elif isinstance(call, ast.Attribute) and call.attr == "option" and first:
                    option = str(first)
            kind = "command" if command else "method" if parent else "function"
            out.append((kind, name, parent, child.lineno, child.end_lineno, _signature(child), ast.get_docstring(child) or "", command, option))

    visit(tree, "")
    return out


def python_segments(files: DataFrame) -> DataFrame:
    """Entities of Python files (path, content)."""
    names = ["kind", "name", "parent", "line", "until", "signature", "doc", "command", "option"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(path, *e) for path, c in zip(p["path"], p["content"]) for e in python_entities(c)]
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, parent string, line long, until long, signature string, doc string, command string, option string")


def config_entries(kind: str, text: str, most: int = 50, value: int = 2000) -> list[tuple[str, str, str]]:
    """(key, entry kind, value) of a configuration's top level; the whole text as one entry when it doesn't parse.

    Of a list the first ``most`` items are entries, and values are cut at ``value`` characters: both are the feature's limits.
    """
    try:
        if kind == "json":
            data = json.loads(text)
        elif kind == "toml":
            import tomllib

            data = tomllib.loads(text)
        else:
            try:
                import yaml
            except ImportError:  # the YAML reader is optional
                return [("", "file", text)]
            data = yaml.safe_load(text)
    except Exception:  # any parser's error means the same here
        return [("", "file", text)]
    if isinstance(data, list):
        return [(f"[{i}]", "item", str(v)[:value]) for i, v in enumerate(data[:most])]
    if not isinstance(data, dict):
        return [("", "file", text)]
    return [(str(k), "table" if isinstance(v, dict) else "key", json.dumps(v, default=str, ensure_ascii=False)[:value]) for k, v in data.items()]


def config_segments(files: DataFrame) -> DataFrame:
    """Top-level entries of configuration files (path, file_type, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(path, *e) for path, k, c in zip(p["path"], p["file_type"], p["content"]) for e in config_entries(k, c or "")], columns=["path", "key", "kind", "value"])

    return files.select("path", "file_type", "content").mapInPandas(run, "path string, key string, kind string, value string")


def git_commits(spark: SparkSession, root: str, most: int = 50) -> DataFrame:
    """(sha, parents, author, date, message) of a repository's last commits; empty without git."""
    run = subprocess.run(["git", "-C", root, "log", f"-{most}", "--format=%H%x1f%P%x1f%an%x1f%aI%x1f%B%x1e"], capture_output=True, text=True, timeout=30)
    rows = [tuple(x.strip("\n").split("\x1f")) for x in run.stdout.split("\x1e") if x.strip()]
    return spark.createDataFrame([(s, p.split(), a, d, m.strip()) for s, p, a, d, m in rows], "sha string, parents array<string>, author string, date string, message string")


def commit_records(commits: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Evidence records of commits, and edges to those parents that are there."""
    rec = commits.select(stable_id(F.lit(project), F.lit("git_history"), F.lit("commit"), F.col("sha")).alias("id"), "sha", F.lit("evidence").alias("type"), F.substring("message", 1, 2000).alias("content"))
    up = commits.select("sha", F.explode("parents").alias("parent"))
    edges = up.join(rec.select("sha", F.col("id").alias("source_id")), "sha").join(rec.select(F.col("sha").alias("parent"), F.col("id").alias("target_id")), "parent")
    edges = edges.select(stable_id(F.col("source_id"), F.col("target_id"), F.lit("derived_from")).alias("id"), "source_id", "target_id", F.lit("derived_from").alias("relation_type"))
    return rec, edges
