"""Expression and operator tests of the store, ranking, assisted retrieval, ingestion and streams."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import identifiers as ids
from cairn.functions import text as tx
from cairn.operators import assisted, ranking, store
from cairn.sources import datasets, files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_text(spark):
    want = {"simulador": "simul", "calendario": "calendari", "mudanca": "mudanc", "atual": "atu"}
    assert {w: one(spark, tx.stem, w) for w in want} == want
    assert one(spark, lambda v: tx.tokens(v, True), "A Decisão não É do Projeto x9") == ["decisao", "nao", "projeto", "x9"]


def test_identifiers(spark):
    assert one(spark, ids.path, "D:\\Foo\\bar.py/") == "/d/Foo/bar.py" and one(spark, ids.path, "foo//b/") == "/foo/b" and one(spark, ids.path, "/") == "/"
    assert one(spark, ids.file_name, "D:\\Foo\\Bar.py") == "bar.py" and one(spark, ids.ticket, " JIRA-123 ") == "123"
    assert {"clarification cycle", "clarification_cycle", "clarificationcycle"} <= set(one(spark, ids.symbol_forms, "ClarificationCycle"))
    assert one(spark, ids.cli_option, "--retrieval-mode") == "retrieval_mode"
    assert one(spark, ids.commit_prefix, "commit A1B2C3D") == "a1b2c3d" and one(spark, ids.commit_prefix, "call 1234567 now") is None
    h = {(r["field"], r["raw"]) for r in one(spark, ids.hints, "serial SN-ACME-1002, MAC AA:BB:CC:DD:EE:02 ticket 1002 deadbeef src/a.py")}
    assert {("serial_number", "SN-ACME-1002"), ("mac_address", "AA:BB:CC:DD:EE:02"), ("ticket_number", "1002"), ("file_path", "src/a.py")} <= h and ("commit_sha", "deadbeef") not in h


def test_store(spark):
    m = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id long, v string, seq long")
    assert {tuple(r) for r in store.upsert(m.limit(0), m, "id", "seq").collect()} == {(1, "b", 2), (2, "c", 1)}
    assert [r.v for r in store.insert_absent(m.where("id = 2"), m, ["id"], "seq").collect()] == ["a"]
    r = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a")], "source_id string, target_id string")
    assert store.incident(r, spark.createDataFrame([("a",)], "id string")).count() == 3
    links = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 51), (51, 50)], "id long, supersedes long")
    got = {x.id: (x.root, x.depth) for x in store.chains(links).collect()}
    assert all(got[i] == (0, i) for i in range(20)) and 50 in got


def test_long_chain(spark):
    """A chain of more than 4,096 records reaches its root; records that lead into a cycle have no depth."""
    n = 9_000
    links = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS supersedes").union(spark.createDataFrame([(n, n + 1), (n + 1, n), (n + 2, n)], "id long, supersedes long"))
    got = {r.id: (r.root, r.depth) for r in store.chains(links).collect()}
    assert len(got) == n + 3 and all(got[i] == (0, i) for i in range(n))
    assert all(got[i][0] in (n, n + 1) and got[i][1] is None for i in range(n, n + 3))


def test_entity_spans_all(spark):
    """Every item has its row, with the spans that Python's regular expressions find."""
    import re

    from cairn.plans import registry

    sf = "/root/testdata/sf0.01"
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    assert any(not r.text.isascii() for r in items)
    got = {r.item_id: r.n_entities for r in registry.QUERIES["entity_spans_all"](spark, sf).collect()}
    assert got == {r.item_id: len(re.findall(ranking.ENTITY, r.text)) for r in items}
    for v in ("Água Évora e São Paulo", "éAbc Nãoß Über", "Ação\u00a0Já x_Abc Abc1 Abc", "A b", "Zé\nÍris"):
        assert one(spark, ranking.all_entities, v) == re.findall(ranking.ENTITY, v)


def test_assisted(spark):
    rec = spark.createDataFrame([(1, {"serial_number": "SN-1001"}, 1), (2, {"serial_number": "SN-1001"}, 2), (3, {"serial_number": "SN-1002", "commit_sha": "a1b2c3d4e5" * 4}, 3)], "id long, metadata map<string,string>, created_at long")
    q = spark.createDataFrame([(1, "serial SN-1002"), (2, "serial SN-1001"), (3, "serial SN-9999"), (4, "commit a1b2c3d")], "query_id long, query string")
    h, s = assisted.query_hints(q), assisted.stored_identifiers(rec)
    e = assisted.identifier_exact(h, s)
    assert {r.query_id: r.status for r in assisted.constraint(h, e).where("query_id < 4").collect()} == {1: "MATCHED_UNIQUE", 2: "MATCHED_MULTIPLE", 3: "NOT_FOUND"}
    ranked = assisted.ranked(assisted.final_score(e.select("query_id", "id", F.lit(1.0).alias("identifier")).join(rec, "id")))
    assert {r.query_id: r.state for r in assisted.states(ranked, q).collect()} == {1: "CONFIRMED", 2: "AMBIGUOUS", 3: "NOT_FOUND", 4: "NOT_FOUND"}
    assert [tuple(r) for r in assisted.commit_matches(q, s).collect()] == [(4, 3, 0.6)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "query_id long, id string, rank long")
    gold = spark.createDataFrame([(1, "b", 1.0)], "query_id long, id string, grade double")
    got = {r.query_id: r for r in ranking.metrics(ranked, gold).collect()}
    assert got[1].rr == 0.5 and got[1].hit_1 == 0 and got[1].precision_3 == 0.5 and got[2].recall_1 == 1.0 and round(got[1].ndcg, 4) == 0.6309


def test_datasets(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"projects": [{"id": "p", "name": "P"}], "memories": [{"id": "1", "type": "evidence", "location": "here", "limitations": ""}], "relations": []}))
    records, relations, projects = datasets.read_dataset(spark, str(p))
    assert records.first().content == "here" and relations.count() == 0 and projects.count() == 1
    datasets.export_store(str(tmp_path / "s"), projects=projects)
    assert datasets.import_store(spark, str(tmp_path / "s"), projects=datasets.PROJECT)["projects"].collect() == projects.collect()
    (tmp_path / "bad.json").write_text(json.dumps({"memories": [{"id": "1", "type": "nothing"}]}))
    with pytest.raises(Exception, match="unknown record type"):
        datasets.read_dataset(spark, str(tmp_path / "bad.json"))[0].collect()


def test_files(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("@cli.command('run')\ndef run(a, *, b=1):\n    'doc'\nclass A:\n    def m(self): pass\n")
    (root / "b.md").write_text("# One\ntext\n## Two\nmore\n")
    (root / "c.toml").write_text("[x]\na = 1\n")
    (root / "d.json").write_text('{"api_key": "abcdefghijklmnop1234"}')
    (root / "e.png").write_text("x")
    m = files.manifest(files.read_project(spark, str(root)))
    status = {r.path: (r.status, r.reason) for r in m.collect()}
    assert status["src/a.py"][0] == "included" and status["e.png"] == ("excluded", "excluded extension") and status["d.json"][1] == "secret: api_key_pattern"
    assert {(r.kind, r.name) for r in files.python_segments(m.where("file_type = 'python'")).collect()} == {("module", ""), ("command", "run"), ("class", "A"), ("method", "A.m")}
    assert [(r.line, r.level, r.heading, r.until) for r in files.markdown_segments(m.where("file_type = 'markdown'"), "path", "content").orderBy("line").collect()] == [(1, 1, "One", 2), (3, 2, "Two", 5)]
    assert [(r.key, r.kind) for r in files.config_segments(m.where("file_type = 'toml'")).collect()] == [("x", "table")]
    c = spark.createDataFrame([("s1", [], "m"), ("s2", ["s1", "gone"], "n")], "sha string, parents array<string>, message string")
    assert [d.count() for d in files.commit_records(c, "p")] == [2, 1]


def test_ingest_twice(spark, tmp_path):
    from cairn.streaming import sessions

    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.json(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema("id long, v string").json(str(tmp_path / "in"))
        sessions.ingest(stream, str(tmp_path / "out"), "id", str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
