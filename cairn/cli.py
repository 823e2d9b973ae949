"""Command line over a store: ``python -m cairn.cli --store FOLDER COMMAND``; every command is a few calls of the package."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assisted, channels, diagnosis, ranking, store
from .sources import datasets, records
from .sources.warehouse import Store

DONT_KNOW = "não sei"
PARTS = ["lexical", "semantic", "type", "relation", "state", "project"]


def _spark() -> SparkSession:
    return SparkSession.builder.appName("cairn").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _row(spark: SparkSession, schema: str, **values) -> DataFrame:
    """One row of a schema from the values that are given."""
    text = json.dumps({k: v for k, v in values.items() if v is not None}, default=str)
    return spark.createDataFrame([(text,)], "j string").select(F.from_json("j", schema).alias("r")).select("r.*").withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))


def _new_id(kind: str, *parts: str | None):
    import uuid

    return f"{kind}-{uuid.uuid5(uuid.NAMESPACE_OID, '|'.join(p or '' for p in parts)).hex[:12]}"


def _view(s: Store) -> tuple[DataFrame, DataFrame]:
    r = s.read("records")
    return r.withColumn("metadata", channels.effective_metadata(r)), s.read("relations").withColumn("rank", F.monotonically_increasing_id())


def _question(spark: SparkSession, text: str, project: str | None) -> DataFrame:
    return spark.createDataFrame([(1, text, project)], "query_id long, query string, project_id string")


def search(s: Store, text: str, project: str | None, strategy: str, k: int) -> DataFrame:
    """The best k records of one query by the lexical, semantic or hybrid strategy."""
    r, e = _view(s)
    pool = r if project is None else r.where(F.col("project_id") == project)
    q = _question(s.spark, text, project)
    if strategy == "hybrid":
        ranked = ranking.hybrid(ranking.hybrid_channels(pool, e, q, k, corpus=r), k)
        return ranked.join(r.select("id", "content"), "id")
    d, t = ranking.terms(r, "id", "content"), ranking.terms(q, "query_id", "query")
    if strategy == "lexical":
        best = ranking.lexical(d.join(pool.select("id"), "id", "left_semi"), t, "id", "query_id", k)
    else:
        idf = ranking.document_frequency(d, "id", F.lit(float(r.count())))
        near = ranking.cosine(ranking.weighted(d, idf, "id").join(pool.select("id"), "id", "left_semi"), ranking.weighted(t, idf, "query_id"), "id", "query_id")
        best = ranking.top(near.withColumnRenamed("cosine", "score"), "query_id", "score", k, F.asc("id"))
    return best.join(r.select("id", "content", F.col("type").alias("type_name")), "id")


def clarify(s: Store, args) -> None:
    """An assisted search; without ``--json`` it asks its questions at the terminal."""
    r, e = _view(s)
    session = channels.Session(r, e, s.read("projects").withColumnRenamed("id", "project_id"))
    turn = session.start(args.query, args.project)
    if args.dimension and args.answer:
        session._history[-1]["dimension"] = args.dimension
        turn = session.answer(args.answer)
    while turn["state"] == "CLARIFICATION_REQUIRED" and not args.json:
        turn = session.answer(input(turn["question"] + " ").strip() or DONT_KNOW)
    print(json.dumps(turn, ensure_ascii=False, default=str, indent=None if args.json else 2))


def evaluate(s: Store, path: str, ablation: bool) -> DataFrame:
    """Means of the metrics over a query set, or of each ablation."""
    r, e = _view(s)
    cases = datasets.read_queries(s.spark, path)
    q = cases.select("query_id", "query", F.col("expected_project_id").alias("project_id"))
    grade = F.coalesce(F.try_element_at("relevance_grades", F.col("id")), F.lit(1.0))
    gold = cases.select("query_id", "relevance_grades", F.explode("expected_ids").alias("id")).select("query_id", "id", grade.alias("grade"))
    variants = ranking.ABLATIONS if ablation else {"full": {}}
    ch = store.cut(ranking.hybrid_channels(r, e, q, variants=tuple(variants.values())))
    out = None
    for name, weights in variants.items():
        ranked = store.cut(ranking.hybrid(ch, weights=weights))
        m = ranking.metrics(ranked, gold)
        expected = cases.select("query_id", F.size(F.coalesce("expected_conflicts", F.array().cast("array<string>"))).alias("n"))
        found = diagnosis.conflicts(ranked.join(r.select("id", "superseded_by"), "id"), e)
        one = diagnosis.rates(m, ranked, ranked.join(r.select("id"), "id", "left_anti"), found, expected, ranking.quality(ranked, q)).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def capsule(s: Store, text: str, project: str | None) -> str:
    items = assisted.capsule(search(s, text, project, "hybrid", ranking.TOP))
    return datasets.resumption_prompt(items, 1)


def lineage(s: Store, ident: str) -> dict:
    """A record's chain forward and backward, and its edges; the walk stops at a record that it has seen."""
    all_ = s.read("records").select("id", "supersedes", "superseded_by")
    if all_.where(F.col("id") == ident).isEmpty():
        raise SystemExit(f"no record {ident}")

    def walk(column: str) -> list[str]:
        seen, now = [ident], ident
        while True:
            row = all_.where(F.col("id") == now).select(column).first()
            now = row and row[0]
            if not now or now in seen:
                return seen[1:]
            seen.append(now)

    edges = store.incident(s.read("relations"), s.spark.createDataFrame([(ident,)], "id string"))
    return {"id": ident, "superseded_by": walk("superseded_by"), "supersedes": walk("supersedes"), "relations": [tuple(r) for r in edges.select("source_id", "relation_type", "target_id").collect()]}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("--store", default="cairn-store")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **flags) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in names:
            c.add_argument(n)
        for n, options in flags.items():
            c.add_argument("--" + n.replace("_", "-"), **options)
        return c

    text, need, yes = {"default": None}, {"required": True}, {"action": "store_true"}
    command("init-db")
    command("load-dataset", "path")
    command("add-memory", id=text, type={"required": True, "choices": datasets.TYPES}, content=need, project=text, extra={"default": "{}"})
    command("add-relation", source=need, target=need, type={"required": True, "choices": datasets.RELATIONS}, confidence={"default": "medium", "choices": ("low", "medium", "high")})
    command("create-episode", id=text, project=text, goal=need, result={"default": ""}, content=text)
    command("create-checkpoint", id=text, project=text, state=need, content=text)
    command("search", "query", project=text, strategy={"default": "hybrid", "choices": ("lexical", "semantic", "hybrid")}, mode={"default": "hybrid", "choices": ("hybrid", "assisted")}, top_k={"type": int, "default": 10}, dimension=text, answer=text, json=yes)
    command("explain", "query", project=text)
    command("build-capsule", "query", project=text, output=text)
    command("evaluate", "dataset", ablation=yes)
    command("export-report", "dataset", output=need)
    command("show-lineage", "id")
    command("ingest-project", "root", project=need, since=text, report=text, manifest=text, include=text, exclude=text, dry_run=yes, force_reindex=yes, no_git=yes, json=yes)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = _spark()
    s = Store(spark, a.store)
    s.init()
    if a.command == "load-dataset":
        s.load_dataset(a.path)
    elif a.command == "add-memory":
        base = {"id": a.id or _new_id(a.type, a.project, a.content), "type": a.type, "content": a.content, "project_id": a.project, "status": "registered", "version": 1}
        s.save("records", _row(spark, datasets.RECORD, **{**base, **json.loads(a.extra)}))
    elif a.command == "add-relation":
        s.save("relations", _row(spark, datasets.RELATION, id=_new_id("rel", a.source, a.target, a.type), source_id=a.source, target_id=a.target, relation_type=a.type, confidence=a.confidence))
    elif a.command == "create-episode":
        s.save("records", _row(spark, datasets.RECORD, id=a.id or _new_id("episode", a.project, a.goal), type="episode", project_id=a.project, content=a.content or f"Goal: {a.goal}\nResult: {a.result}", status="registered", version=1))
    elif a.command == "create-checkpoint":
        s.save("records", _row(spark, datasets.RECORD, id=a.id or _new_id("checkpoint", a.project, a.state), type="checkpoint", project_id=a.project, current_state=a.state, content=a.content or a.state, status="registered", version=1))
    elif a.command == "search" and a.mode == "assisted":
        clarify(s, a)
    elif a.command == "search":
        found = search(s, a.query, a.project, a.strategy, a.top_k).select("query_id", "rank", "id", "score", "content")
        print((records.result_json(found, ["id", "score", "content"]).select("json").first() or ["[]"])[0] if a.json else records.text_table(found.orderBy("rank"), a.top_k))
    elif a.command == "explain":
        r, e = _view(s)
        q = _question(spark, a.query, a.project)
        ranked = store.cut(search(s, a.query, a.project, "hybrid", ranking.TOP))
        clue = ranking.clues(F.col("query"))
        asked = q.select("query_id", "query", clue["absence"].alias("absence"), clue["type_hint"].alias("type_hint")).join(ranking.quality(ranked, q), "query_id")
        print(diagnosis.explain(asked, ranked, diagnosis.conflicts(ranked.join(r.select("id", "superseded_by"), "id"), e), PARTS).first()["explanation"])
    elif a.command == "build-capsule":
        text = capsule(s, a.query, a.project)
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    elif a.command == "evaluate":
        print(records.text_table(evaluate(s, a.dataset, a.ablation)))
    elif a.command == "export-report":
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(datasets.markdown_report("Evaluation", evaluate(s, a.dataset, True)))
    elif a.command == "show-lineage":
        print(json.dumps(lineage(s, a.id), ensure_ascii=False))
    elif a.command == "ingest-project":
        commits = None if a.no_git or records.head(a.root) == "unknown" else records.read_commits(spark, a.root, a.since)
        listed, report = records.run(s, records.read_project(spark, a.root), a.project, records.head(a.root), commits, a.dry_run, a.force_reindex, a.include, a.exclude)
        if a.manifest:
            records.write_manifest(listed, a.manifest)
        if a.report:
            records.write_report(spark, report, a.report)
        print(json.dumps(report, ensure_ascii=False) if a.json else "\n".join(f"{k}: {v}" for k, v in report.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
