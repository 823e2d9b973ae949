"""Assisted retrieval end to end, diagnosis, the store, ingestion to records and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.functions import identifiers as ids
from cairn.operators import assisted, channels, diagnosis, ranking
from cairn.sources import datasets, files, records
from cairn.sources.warehouse import Store, merge_envelope, split_envelope, typed

SCHEMA = "id string, type string, content string, status string, decision_status string, hypothesis_state string, project_id string, created_at long, valid_from timestamp, valid_to timestamp, metadata map<string,string>"


def base(spark):
    def row(i, kind="fact", content="x", status="verified", at=0, project="p1", **meta):
        return (i, kind, content, status, ("superseded" if status == "superseded" else "active") if kind == "decision" else None, None, project, at, None, None, {k: str(v) for k, v in meta.items()})

    rows = [
        row("scale-1", content="balança de pesagem calibrada", serial_number="SN-1001", manufacturer="Toledo", device_model="Prix", environment="produção", at=1),
        row("scale-2", content="balança de pesagem trocada", serial_number="SN-1002", manufacturer="Filizola", device_model="Platina", environment="testes", at=2),
        row("cycle", content="class body", qualified_name="app.retrieval.ClarificationCycle", source_path="src/app/retrieval.py", entity_type="class", at=3),
        row("module", content="module body", qualified_name="app.retrieval", source_path="src/app/retrieval.py", entity_type="module", at=4),
        row("test-cycle", content="pesagem literal da consulta balança calibrada hoje", source_path="tests/test_retrieval.py", qualified_name="tests.other", at=5),
        row("command", content="runs it", cli_command="ingest-project", cli_option="--dry-mode", source_path="src/app/cli.py", qualified_name="app.cli.run", at=6),
        row("commit", "evidence", "fix", commit_sha="a1b2c3d4e5f60718293a4b5c6d7e8f9001122334", at=7),
        row("rule", "decision", "usar fila assíncrona", at=8, project="p2"),
        row("old-rule", "decision", "usar lote noturno", "superseded", at=9, project="p2"),
    ]
    rel = spark.createDataFrame([("rule", "old-rule", "supersedes", 1), ("scale-1", "commit", "references", 2), ("scale-1", "cycle", "references", 3), ("scale-1", "rule", "references", 4)], "source_id string, target_id string, relation_type string, rank long")
    return spark.createDataFrame(rows, SCHEMA), rel, spark.createDataFrame([("p1", "Balanças"), ("p2", "Fila")], "project_id string, name string")


QUERIES = {
    "serial SN-1001": ("CONFIRMED", "MATCHED_UNIQUE", ["scale-1"]),
    "serial SN-9999 balança": ("NOT_FOUND", "NOT_FOUND", []),
    "onde fica ClarificationCycle": ("CONFIRMED", channels.NO_IDENTIFIER, ["cycle"]),
    "abrir src/app/cli.py": ("CONFIRMED", "MATCHED_UNIQUE", ["command"]),
    "opção --dry-mode": ("CONFIRMED", channels.NO_IDENTIFIER, ["command"]),
    "commit a1b2c3d4": ("CONFIRMED", "MATCHED_UNIQUE", ["commit"]),
    "commit ffff1234": ("NOT_FOUND", "NOT_FOUND", []),
    "equipamento prix": ("NOT_FOUND", channels.NO_IDENTIFIER, ["scale-1"]),
    "zzz qqq": ("NOT_FOUND", channels.NO_IDENTIFIER, []),
}


def test_retrieval_of_a_batch(spark):
    r, rel, projects = base(spark)
    q = spark.createDataFrame([(i, t, None, {}) for i, t in enumerate(QUERIES)] + [(90, "regra vigente", "p2", {}), (91, "pesagem", None, {"environment": "TESTES"})], "query_id long, query string, project_id string, filters map<string,string>")
    found, out = channels.retrieve(q, r, rel, F.lit("2024-03-01").cast("timestamp"), projects)
    rows = {}
    for x in found.orderBy("query_id", "rank").collect():
        rows.setdefault(x.query_id, []).append(x)
    state = {x.query_id: x for x in out.collect()}
    for i, (text, (want, status, best)) in enumerate(QUERIES.items()):
        assert (state[i].state, state[i].constraint) == (want, status), text
        assert [x.id for x in rows.get(i, [])][: len(best)] == best and (best or not rows.get(i)), text
    # A test file's words alone are no evidence; segments of one file are one row.
    assert all(x.id != "test-cycle" for x in sum(rows.values(), []))
    assert [x.id for x in rows[90]] == ["rule"] and rows[90][0].final == pytest.approx(0.25)
    assert [x.id for x in rows[91]] == ["scale-2"]
    both = {(x.query_id, x.id): x.score for x in channels.symbol_matches(q, r).collect()}
    assert both[(2, "cycle")] == 1.0
    paths = {(x.query_id, x.id): x.score for x in channels.path_matches(q, r).collect()}
    assert paths == {(3, "command"): 1.0}


def test_session_asks_and_gives_up(spark):
    r, rel, projects = base(spark)
    r = r.where(F.col("id").isin("scale-1", "scale-2")).withColumn("content", F.lit("balança de pesagem com muitas outras palavras diferentes aqui escritas agora"))
    s = channels.Session(r, rel.limit(0), None, F.lit("2024-03-01").cast("timestamp"))
    with pytest.raises(RuntimeError):
        s.answer("x")
    t = s.start("pesagem nova semana passada")
    assert t["state"] == "CLARIFICATION_REQUIRED" and t["dimension"] == "manufacturer" and t["question"]
    t = s.answer(" toledo ")
    assert [i for i, _ in t["results"]] == ["scale-1"] and s.filters() == {"manufacturer": "toledo"} and t["used"] == 1 and len(s.history()) == 2
    s.start("pesagem nova semana passada")
    assert s.answer("não sei")["state"] == "NOT_FOUND" and s.filters() == {}


def test_partial_matches_and_metadata(spark):
    r, _, projects = base(spark)
    q = spark.createDataFrame([(1, "serial SN-100 da marca toledo em balanças", None)], "query_id long, query string, project_id string")
    score = {x.id: x.score for x in channels.identifier_matches(q, r).collect()}
    assert score == {"scale-1": pytest.approx(0.55 * 5 / 6), "scale-2": pytest.approx(0.55 * 5 / 6)}
    fields = {(x.id, x.field) for x in channels.metadata_fields(q, r, projects).collect()}
    assert ("scale-1", "manufacturer") in fields and ("scale-1", "project_id") in fields and not any(i == "scale-2" and f == "manufacturer" for i, f in fields)
    cap = spark.createDataFrame([("a", {f: f"value{k}" for k, f in enumerate(channels.WORD_FIELDS)})], "id string, metadata map<string,string>").withColumn("project_id", F.lit(None).cast("string"))
    every = spark.createDataFrame([(1, " ".join(f"value{k}" for k in range(13)))], "query_id long, query string")
    assert channels.metadata_matches(every, cap).first().score == assisted.FIELDS_CAP


def test_temporal_entity_and_symbols(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    at = lambda d: F.lit(d).cast("timestamp")
    now, none = at("2024-05-05"), F.lit(None).cast("timestamp")
    got = [one(channels.temporal_score(now, a, b)) for a, b in ((at("2024-01-01"), at("2024-12-01")), (at("2024-01-01"), at("2024-02-01")), (at("2024-01-01"), none), (none, at("2025-01-01")), (at("2025-01-01"), at("2026-01-01")))]
    assert got == [0.15, -0.15, 0.075, 0.0, 0.0]
    assert one(ranking.temporal(now, at("2024-01-01"), at("2024-02-01"))) == pytest.approx(0.05)
    assert one(ranking.entity_score(F.lit("o que Ana Silva disse a Bruno"), F.array(F.lit("ana silva"), F.lit("Bruno Costa")))) == pytest.approx(0.6)
    assert one(ids.symbols_match(F.lit("ClarificationCycle"), F.lit("clarification_cycle"))) and not one(ids.symbols_match(F.lit("A1"), F.lit("b2")))
    assert one(ids.cli_options_match(F.lit("--retrieval-mode"), F.lit("retrieval_mode")))


def test_diagnosis(spark):
    ranked = spark.createDataFrame([(1, "a", "fact", "obsolete", "b", 1, 0.9, 1), (1, "b", "decision", "verified", None, 2, 0.8, 1), (1, "b", "decision", "verified", None, 3, -0.1, 2)], "query_id long, id string, type_name string, status string, superseded_by string, rank long, score double, version int")
    rel = spark.createDataFrame([("b", "a", "supersedes"), ("a", "b", "supersedes"), ("a", "b", "similar_to")], "source_id string, target_id string, relation_type string")
    got = sorted(r.message for r in diagnosis.conflicts(ranked, rel).collect())
    assert got == ["CONFLICT: a supersedes b", "STATE_CONFLICT: a is obsolete (superseded_by: b)", "VERSION_CONFLICT: b appears with versions 1, 2"]
    quality, absence = spark.createDataFrame([(1, "absent")], "query_id long, quality string"), spark.createDataFrame([(1, True)], "query_id long, absence boolean")
    assert diagnosis.buckets(ranked, quality, absence).count() == 0 and diagnosis.buckets(ranked, quality, absence.where("NOT absence")).count() == 2
    c = spark.createDataFrame([("x", True, "failure"), ("y", False, "warning")], "name string, met boolean, severity string")
    v = diagnosis.verdict(c).first()
    assert (v.verdict, v.warnings) == ("INCONCLUSIVE", ["y"]) and diagnosis.verdict(c.withColumn("severity", F.lit("failure"))).first().verdict == "FAILED" and diagnosis.verdict(c.where("met")).first().verdict == "PASSED"
    assert [spark.range(1).select(diagnosis.decimals(F.lit(x))).first()[0] for x in (0.00025, 0.00035)] == [0.0002, 0.0004]
    r, _, _ = base(spark)
    anchor, edge = diagnosis.association("ana", "q", r.where("id = 'commit'"), r)
    assert anchor.first().content == "user_confirmed_association:ana" and edge.first().relation_type == "references" and edge.first().metadata["query"] == "q"
    assert diagnosis.association("commit", "q", r.where("id = 'rule'"), r)[0].isEmpty() and diagnosis.phase(spark.range(5).withColumnRenamed("id", "phase"), 2).count() == 3


def test_store_keeps_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.init()
    s.init()
    new = lambda i, text: spark.createDataFrame([(i, "fact", text)], "id string, type string, content string")
    s.save("records", new("a", "one"))
    s.snapshot("first")
    s.save("records", new("a", "two").union(new("b", "three")))
    assert {r.id: r.content for r in s.read("records").collect()} == {"a": "two", "b": "three"} and s.at("first").read("records").first().content == "one"
    assert s.add("records", new("a", "four").union(new("c", "five")), ["id"]) == {"created": 1, "skipped": 1}
    assert s.add("records", new("a", "six"), ["id"], replace=True)["created"] == 1 and s.get(["a"]).first().content == "six" and s.get(["a"], kind="decision").isEmpty()
    s.export(str(tmp_path / "x"))
    t = Store(spark, str(tmp_path / "t"))
    t.load(str(tmp_path / "x"))
    assert sorted(tuple(r) for r in t.read("records").select("id", "content").collect()) == sorted(tuple(r) for r in s.read("records").select("id", "content").collect())
    d = spark.createDataFrame([("d", "decision", "t", "active", "why")], "id string, type string, content string, decision_status string, justification string")
    again = merge_envelope(split_envelope(d), "decision_status string, justification string")
    assert again.collect() == d.collect() and typed(d, "decision").columns == d.columns and typed(d, "fact").isEmpty()


SOURCES = [
    ("docs/a.md", "intro\n# One\ntext\n## Two\nmore\n# One\nagain\n"), ("src/app/core.py", "import os\n\nclass A:\n    '''doc'''\n    def m(self):\n        return 1\n    class B:\n        def n(self): pass\n\ndef f(x):\n    return x\n"),
    ("conf.json", '{"k": 1, "t": {"a": 2}}'), ("bad.py", "def ("), ("x.png", ""), ("keys.md", "api_key = abcdefghijklmnop1234"),
]


def test_ingestion_to_records(spark, tmp_path):
    src = spark.createDataFrame([(p, c, len(c), "h" + p) for p, c in SOURCES], "path string, content string, size_bytes long, sha256 string")
    s = Store(spark, str(tmp_path / "s"))
    s.init()
    commits = spark.createDataFrame([("c2", ["c1", "gone"], "ana", "d", "second"), ("c1", [], "ana", "d", "first")], "sha string, parents array<string>, author string, date string, message string")
    listed, report = records.run(s, src, "p", "c2", commits)
    assert report["files"] == {"included": 4, "excluded": 2} and report["records"]["skipped"] == 0
    state = {r.path: (r.reason, r.estimated_segments, r.segmentation_rule) for r in listed.collect()}
    assert state["docs/a.md"] == (None, 4, "heading-based segmentation") and state["keys.md"][0] == "secret: api_key_pattern" and state["conf.json"][1] == 2
    rows = {r.id: r for r in s.read("records").collect()}
    by_name = {(r.metadata.get("source_path"), r.metadata.get("qualified_name")): r for r in rows.values()}
    md = {r.metadata["source_heading"] for r in rows.values() if r.metadata["source_path"] == "docs/a.md"}
    assert md == {"docs/a.md", "", "One", "One > Two"} and by_name[("docs/a.md", "One")].content == "# One\ntext"
    parent = {rows[e.source_id].metadata["qualified_name"]: rows[e.target_id].metadata["qualified_name"] for e in s.read("relations").collect() if rows[e.source_id].metadata["source_path"] == "src/app/core.py"}
    assert parent == {"src.app.core.A": "src.app.core", "src.app.core.A.m": "src.app.core", "src.app.core.A.B": "src.app.core.A", "src.app.core.A.B.n": "src.app.core.A", "src.app.core.f": "src.app.core"}
    m = by_name[("src/app/core.py", "src.app.core.A.m")].metadata
    assert m["entity_type"] == "method" and m["class_name"] == "A" and m["ingestion_pipeline_version"] == records.PIPELINE and m["source_commit_sha"] == "c2" and len(m["content_fingerprint"]) == 64
    derived = [e for e in s.read("relations").collect() if e.relation_type == "derived_from"]
    assert len(derived) == 1 and rows[derived[0].target_id].content == "first"
    again = records.run(s, src, "p", "c2", commits)[1]
    assert again["records"]["created"] == 0 == again["relations"]["created"] and records.run(s, src, "p", dry=True)[1].get("records") is None
    index = {r.memory_id: r for r in records.symbol_index(s.read("records")).collect()}
    assert "src app core a m" in index[by_name[("src/app/core.py", "src.app.core.A.m")].id].symbol_normalized
    records.write_manifest(listed, str(tmp_path / "m"))
    assert records.read_manifest(spark, str(tmp_path / "m")).count() == len(SOURCES)


def test_python_entities_by_their_syntax():
    """Every class and function outside of functions, with its lines, as a plain walk of the source finds them."""
    source = "\n".join(["import click", *[f"class C{i}:\n    def m{i}(self):\n        def inner(): pass\n        return {i}\n    async def n{i}(self, *, k=1): pass" for i in range(5)], "@click.command('go-on')", "@click.option('--size')", "def go(size): pass"])
    got = {(e[0], e[1]) for e in files.python_entities(source)}
    want = {("module", ""), ("command", "go")} | {("class", f"C{i}") for i in range(5)} | {("method", f"C{i}.{m}{i}") for i in range(5) for m in "mn"}
    assert got == want
    command = next(e for e in files.python_entities(source) if e[0] == "command")
    assert command[7:] == ("go-on", "--size")


def test_command_line(spark, tmp_path, capsys):
    folder, data = str(tmp_path / "s"), tmp_path / "d.json"
    data.write_text(json.dumps({"projects": [{"id": "p", "name": "Fila"}], "memories": [{"id": "r2", "type": "decision", "content": "fila assíncrona de mensagens", "decision_status": "active", "supersedes": "r1", "project_id": "p"}, {"id": "r1", "type": "decision", "content": "lote noturno de mensagens", "status": "superseded", "superseded_by": "r2", "project_id": "p"}], "relations": [{"id": "e", "source_id": "r2", "target_id": "r1", "relation_type": "supersedes"}]}))
    run = lambda *a: (cli.main(["--store", folder, *a]), capsys.readouterr().out)[1]
    run("init-db")
    run("load-dataset", str(data))
    run("add-memory", "--id", "f1", "--type", "fact", "--content", "mensagens perdidas na fila", "--project", "p", "--extra", '{"status": "verified"}')
    run("add-relation", "--source", "f1", "--target", "r2", "--type", "supports")
    run("create-episode", "--id", "ep", "--goal", "migrar", "--result", "feito")
    run("create-checkpoint", "--id", "ck", "--state", "fila em produção")
    s = Store(spark, folder)
    got = {r.id: r for r in s.read("records").collect()}
    assert set(got) == {"r1", "r2", "f1", "ep", "ck"} and got["ep"].content == "Goal: migrar\nResult: feito" and got["f1"].status == "verified"
    for strategy in ("lexical", "semantic", "hybrid"):
        assert "r2" in {x["id"] for x in json.loads(run("search", "fila de mensagens", "--strategy", strategy, "--json"))}
    assert json.loads(run("search", "fila de mensagens", "--mode", "assisted", "--json"))["results"]
    assert "Quality: " in run("explain", "fila de mensagens") and "## decision" in run("build-capsule", "fila de mensagens")
    assert json.loads(run("show-lineage", "r2"))["supersedes"] == ["r1"]
    with pytest.raises(SystemExit):
        run("show-lineage", "nobody")
    cases = tmp_path / "q.json"
    cases.write_text(json.dumps({"queries": [{"query_id": "q1", "query": "fila assíncrona", "expected_ids": ["r2"], "expected_conflicts": ["r1"]}]}))
    assert "full" in run("evaluate", str(cases))
    project = tmp_path / "proj"
    (project / "docs").mkdir(parents=True)
    (project / "docs/a.md").write_text("# T\nbody\n")
    report = json.loads(run("ingest-project", str(project), "--project", "p", "--no-git", "--json"))
    assert report["files"] == {"included": 1} and report["records"]["created"] == 2 and datasets.RELATIONS
