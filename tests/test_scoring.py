"""Scoring where texts are read against the plain joins, and channels whose pairs grow with copies."""

import numpy as np
from pyspark.sql import functions as F

from cairn.operators import ranking, scoring


def corpus(spark):
    """Texts with copies, an empty one, none, and words that many or no query has."""
    words = "balança pesagem fila mensagem lote noturno serviço rede acesso ponto".split()
    rows = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(1, i % 6 + 1)) + (f" raro{i}" if i % 3 else "")) for i in range(120)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, ""), (301, None)]
    queries = [(1, "balança da fila"), (2, "lote noturno lote"), (3, "nada disso"), (4, None), (5, "raro7 rede")]
    return spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(queries, "query_id long, query string")


def test_scores_equal_the_plain_joins(spark, monkeypatch):
    """With few terms held by the tasks, small batches and blocks: the same pairs, best rows and frequencies as by joins on terms."""
    monkeypatch.setattr(scoring, "FREQUENT", 3)
    r, q = corpus(spark)
    index, asked = ranking.terms(r, "id", "content"), ranking.terms(q, "query_id", "query")
    idf = ranking.document_frequency(index, "id", F.lit(float(r.count())))
    frequency = scoring.document_frequency(r, "content")
    assert {x.term: x.df for x in frequency.collect()} == {x.term: x.df for x in idf.collect()}
    near = ranking.cosine(ranking.weighted(index, idf, "id"), ranking.weighted(asked, idf, "query_id"), "id", "query_id")
    want = {(x.query_id, x.id): (x.shared, x.shared / (x.nd + x.nq - x.shared), x.cosine) for x in ranking.overlap(index, asked, "id", "query_id").join(near, ["query_id", "id"]).collect()}
    batch = scoring.Batch(q)
    batch.weigh(frequency, r.count())
    v = scoring.vectors(r, batch, "id", "content", frequency, r.count())
    got = {(x.query_id, x.id): (x.shared, x.lexical, x.semantic) for x in scoring.pairs(v, batch, "id").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    found = scoring.best(v.repartition(3), batch, "id", 5, lambda b, who, shared, lexical, semantic: [np.where(shared > 0, lexical, -np.inf)], (0, False)).collect()
    assert len(found) <= 3 * 5 * 5
    for query in (1, 2, 5):
        best = sorted((-s[1], i) for (k, i), s in want.items() if k == query)[:5]
        assert sorted((-x.lexical, x.id) for x in found if x.query_id == query)[:5] == best


def test_rounds_as_spark(spark):
    x = [0.0078125, 0.2578125, 1.0000005, 0.1234565, -0.0000015, 0.3333333333, 2.5e-7, 5e-7]
    assert scoring.rounded(np.array(x)).tolist() == [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 6)).collect()]


def test_partial_identifiers_by_brute_force(spark):
    """Beginnings and ends in both directions, each pair at its best share, no equal values."""
    from cairn.operators import assisted

    values = ["ABCD", "ABCDE", "XABCD", "ABCDABCD", "BCDE", "ABC", "ZZZZ1", "ABCDE"]
    stored = spark.createDataFrame([(i, "serial_number", v) for i, v in enumerate(values)], "id long, field string, norm string")
    hints = spark.createDataFrame([(10 + i, "serial_number", v) for i, v in enumerate(values)] + [(99, "ticket_number", "ABCD")], "query_id long, field string, norm string")
    fits = lambda a, b: min(len(a), len(b)) >= 4 and a != b and (a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a))
    want = {(10 + i, j): round(0.55 * min(len(a), len(b)) / max(len(a), len(b)), 9) for i, a in enumerate(values) for j, b in enumerate(values) if fits(a, b)}
    got = assisted.identifier_partial(hints, stored)
    assert {(r.query_id, r.id): round(r.score, 9) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and "EndsWith" not in plan


def test_a_shared_identifier_needs_no_pairs(spark):
    """Status and ranking of many queries that name one identifier of many records, without each query's pairs with all of them."""
    from cairn.operators import assisted

    rec = spark.range(300).selectExpr("id", "map('ticket_number', if(id < 299, '7', '8')) AS metadata", "id % 100 AS created_at", "if(id % 3 = 0, 'superseded', 'verified') AS status")
    q = spark.createDataFrame([(i, "ticket 7" if i else "ticket 8") for i in range(20)], "query_id long, query string")
    h, s = assisted.query_hints(q), assisted.stored_identifiers(rec)
    pairs = assisted.identifier_exact(h, s)
    assert sorted(assisted.constraint_of(h, assisted.counted(s)).collect()) == sorted(assisted.constraint(h, pairs).collect())
    few = assisted.identifier_best(h, s, rec, pool=5)
    assert few.count() == 19 * 5 + 1
    rank = lambda p: sorted((r.query_id, r.rank, r.id) for r in assisted.ranked(assisted.final_score(p.select("query_id", "id", F.lit(1.0).alias("identifier")).join(rec, "id")), 5).collect())
    assert rank(few) == rank(pairs)


def test_channels_by_distinct_values(spark):
    """Copies of queries and records, with filters and missing fields: the pairs and scores of the plain channels, each pair once."""
    from cairn.operators import channels

    meta = [
        {"source_path": "src/a/run.py", "qualified_name": "a.RunIt", "cli_command": "run-it", "cli_option": "--dry-size", "manufacturer": "Toledo", "environment": "produção"},
        {"source_path": "tests/run.py", "source_heading": "RunIt", "cli_command": "run", "manufacturer": "Filizola", "serial_number": "X-1"}, {},
    ]
    r = spark.createDataFrame([(i, meta[i % 3], f"p{i % 2}") for i in range(24)], "id long, metadata map<string,string>, project_id string")
    texts = ["open src/a/run.py", "see RunIt run-it", "x --dry-size da toledo em produção fila", "nada"]
    q = spark.createDataFrame([(i, texts[i % 4], None, {"manufacturer": " TOLEDO"} if i % 5 == 0 else {"serial_number": "x1"} if i % 5 == 1 else {}) for i in range(40)], "query_id long, query string, project_id string, filters map<string,string>")
    projects = spark.createDataFrame([("p0", "Fila"), ("p1", "Outra")], "project_id string, name string")
    rows = lambda df: sorted((x.query_id, x.id, x.score) for x in df.collect())
    for name in ("path", "symbol", "cli"):
        got = rows(getattr(channels, f"{name}_matches")(q, r))
        assert got and got == rows(getattr(channels, f"{name}_pairs")(q, r)), name
    for asked in (q, q.drop("filters")):
        got = rows(channels.metadata_matches(asked, r, projects))
        assert got and got == rows(channels.metadata_pairs(asked, r, projects))


def test_candidates_rank_as_all_pairs(spark):
    """Copies, scopes, filters, intents and identifiers: the first of each query's ranking as from all its pairs, from a small share of them."""
    from cairn.operators import assisted, channels, store

    kinds, meta = ("fact", "decision", "hypothesis"), [
        {"source_path": "src/a/run.py", "qualified_name": "a.RunIt", "cli_command": "run-it", "manufacturer": "Toledo"}, {"source_path": "tests/run.py", "cli_option": "--dry-size", "manufacturer": "Filizola"}, {"environment": "fila"}, {},
    ]
    rows = [
        (i, kinds[i % 3], "balança da fila" if i % 2 else "lote noturno", "superseded" if i % 5 == 0 else "verified", ("superseded" if i % 5 == 0 else "active") if i % 3 == 1 else None, f"p{i % 2}", i * 7 % 50 if i % 11 else None, i % 7 == 0,
         {**meta[i % 4], **({"serial_number": f"SN-100{i % 3}"} if i % 6 == 0 else {}), "commit_sha": f"{i:08x}" * 5})
        for i in range(240)
    ]
    r = spark.createDataFrame(rows, "id long, type string, content string, status string, decision_status string, project_id string, created_at long, dated boolean, metadata map<string,string>")
    day = F.lit("2024-01-01").cast("timestamp")
    r = r.withColumns({"hypothesis_state": F.lit(None).cast("string"), "valid_from": F.when(F.col("dated"), day), "valid_to": F.lit(None).cast("timestamp")})
    texts = ["run-it balança", "a RunIt vigente", "fila antiga da toledo", "serial SN-1001 atual", "commit 0000000a lote", "nada vigente", "abrir src/a/run.py --dry-size"]
    filters = [{}, {"manufacturer": " TOLEDO"}, {"serial_number": "sn1001"}]
    q = spark.createDataFrame([(i, texts[i % 7], "p1" if i % 4 == 0 else None, filters[i % 3 if i > 20 else 0]) for i in range(84)], "query_id long, query string, project_id string, filters map<string,string>")
    projects = spark.createDataFrame([("p0", "Fila"), ("p1", "Outra")], "project_id string, name string")
    rel = spark.createDataFrame([(1, 3, "references", 1), (5, 3, "references", 2)], "source_id long, target_id long, relation_type string, rank long")
    every, few = (store.cut(f(q, r, rel, day, projects, 4)) for f in (channels.scored, channels.candidates))
    rank = lambda df: sorted((x.query_id, x.rank, x.id, x.final, x.segments, *[x[c] for c in (*channels.CHANNELS, "relation", "temporal")]) for x in assisted.ranked(df, 4).collect())
    assert set(every.columns) == set(few.columns) and rank(few) == rank(every)
    assert few.count() < every.count() / 3


def test_filters_by_distinct_values(spark):
    """Filters of many queries and records with the same values: each pair once, and the values that meet are far fewer than the pairs."""
    from cairn.operators import channels

    meta = [{"manufacturer": "Toledo", "device_model": "Prix 4"}, {"manufacturer": " toledo", "serial_number": "SN-1"}, {"device_model": "prix  4", "serial_number": "sn1"}, {}]
    r = spark.createDataFrame([(i, {**meta[i % 4], "commit_sha": f"{i:040x}"}) for i in range(80)], "id long, metadata map<string,string>")
    asks = [{"manufacturer": "TOLEDO", "branch": ""}, {"manufacturer": "toledo", "device_model": "PRIX 4"}, {"serial_number": "sn/1"}, {"branch": "x"}, {}, None]
    q = spark.createDataFrame([(i, asks[i % 6]) for i in range(30)], "query_id long, filters map<string,string>")
    fits = {0: {0, 1}, 1: {0}, 2: {1, 2}}
    want = sorted((i, k) for i in range(30) for k in range(80) if k % 4 in fits.get(i % 6, ()))
    assert sorted((x.query_id, x.id) for x in channels.filter_pool(q, r).collect()) == want
    assert not channels.filter_pool(q.drop("filters"), r).collect()
    seen, met = [], channels._filters_met
    channels._filters_met = lambda f, records, named: seen.append(met(f, records, named).count()) or met(f, records, named)
    try:
        channels.filter_pool(q, r)
    finally:
        channels._filters_met = met
    assert seen[0] <= 8 < len(want)


def test_an_identifier_of_many_is_dealt_out(spark, monkeypatch):
    """Every pair once, and no task makes most of the pairs of one identifier."""
    from cairn.operators import assisted

    monkeypatch.setattr(assisted, "SHARE", 500)
    h = spark.createDataFrame([(i, "ticket_number", "7" if i < 100 else str(i)) for i in range(120)], "query_id long, field string, norm string")
    s = spark.createDataFrame([(i, "ticket_number", "7" if i < 200 else str(i - 100)) for i in range(230)] + [(900, "serial_number", "7")], "id long, field string, norm string")
    pairs = assisted.identifier_exact(h, s)
    want = sorted((q, i) for q in range(100) for i in range(200)) + [(q, q + 100) for q in range(100, 120)]
    assert sorted((x.query_id, x.id) for x in pairs.collect()) == want
    made = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) > 4 and max(made) < len(want) / 3


def test_hint_fields_of_long_keys(spark, tmp_path):
    """Keys of seven and eight digits: as the query's SQL has it, though commits are found there too."""
    import duckdb

    from cairn.functions import identifiers as ids
    from cairn.plans import registry, retrieval  # noqa: F401

    keys = [5, 999_999, 1_000_000, 12_345_678]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["identifier_hint_fields"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLE_SQL["identifier_hint_fields"]).fetchall()) and len(got) == 20
    found = spark.range(1).select(ids.hints(F.lit("ticket #12345678 in src/a1000000.py")).alias("h")).first().h
    assert {(h.field, h.raw) for h in found} >= {("commit_sha", "12345678"), ("commit_sha", "a1000000")}


def test_nearest_by_brute_force(spark):
    """Copies, vectors of zeros and none: each query's best rows by the rounded cosine and the key are among those handed out, and these are few."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=(300, 8)).round(1)
    e[40:90], e[7], e[50] = e[3], 0.0, e[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)]
    df = spark.createDataFrame([*rows, (300, None)], "id long, e array<double>")
    got = scoring.nearest(df, df.where("id % 50 = 0"), "id", "e", 5).collect()
    found = {(r.query_id, r.id) for r in got}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    assert len(found) == len(got) <= 7 * 6 * tasks
    norm = np.sqrt((e * e).sum(axis=1))
    for q in range(0, 300, 50):
        cos = [-2 if not norm[i] else round(float(e[q] @ e[i] / (norm[q] * norm[i])), 5) for i in range(300)]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-cos[i], i))[:5]
        assert {(q, i) for i in want} <= found


def test_threshold_counts_every_label():
    """Counts of paths give what the paths themselves give; no number of labels is left out."""
    from cairn.llm import quality

    rng = np.random.default_rng(1)
    good, bad = (np.round(rng.normal(m, 1.0, n), 3) for m, n in ((9.0, 50_000), (7.0, 3_000)))
    edges = np.unique(np.concatenate([good, bad]))
    gap = [(bad < e).mean() - (good < e).mean() for e in edges[::50]]
    best = quality.counted_threshold(edges, *(np.searchsorted(np.sort(x), edges, "right") - np.searchsorted(np.sort(x), edges) for x in (good, bad)))
    assert best == quality.threshold(good, bad) and (bad < best).mean() - (good < best).mean() >= max(gap)
    assert not hasattr(quality, "CALIBRATION")


def test_words_of_many_texts_at_once(spark, monkeypatch):
    """Split by their bytes together: each text's words are those that the expressions on columns give, at its edges too."""
    from cairn.functions import text as tx

    texts = ["Ação É ÀÇÃO", "fim", "de a1 b", None, "", "x", "œuvre straße Ünïcode…K9 İx ÿÿ æa", "日本abc語de", "fim", "a" * 300, "ab" + "ÿ" * 3, "ç", "1 22"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    want = [sorted(r.w or []) for r in df.orderBy("id").select(tx.tokens(F.col("t")).alias("w")).collect()]
    low = df.orderBy("id").select(F.lower("t").alias("t")).toArrow().column(0).combine_chunks()
    for part, first in ((low, 0), (low.slice(1, 9), 1), (low.slice(3, 2), 3)):
        row, words, place = scoring.split(part)
        got = [sorted(words.take(place[row == i]).to_pylist()) for i in range(len(part))]
        assert got == want[first : first + len(part)]
    row, words, place = scoring.split(low.slice(0, 1).cast("string"), False)
    assert words.take(place).to_pylist() == []
    monkeypatch.setattr(scoring, "BYTES", 10)
    sizes = [b.num_rows for b in scoring._sliced(iter([df.toArrow().combine_chunks().to_batches()[0]]), 1)]
    assert sum(sizes) == len(texts) and len(sizes) > 5


def joined_texts(df):
    """Joins of a plan that hand texts on."""
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    walk = lambda node: [node, *[x for c in each(node.children()) for x in walk(c)]]
    return [n for n in walk(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join" and {"text", "content"} & {a.name() for a in each(n.output())}]


def test_texts_are_not_shuffled(spark, tmp_path, monkeypatch):
    """No text passes a shuffle or join on its way to its scores, and no more than the most frequent terms reach the driver."""
    from cairn.plans import views

    spark.createDataFrame([(i, f"texto {i} da fila", "en", "s", 9) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 50, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    m, t = views.memories(spark, str(tmp_path)), views.texts(spark, str(tmp_path))
    assert sorted(t.collect()) == sorted(m.select("id", "content").collect())
    batch = scoring.Batch(spark.createDataFrame([(1, "fila")], "query_id long, query string"))
    base, plain = (ranking.light(m, views.relations(spark, str(tmp_path)), *x) for x in ((t,), ()))
    assert sorted(base.collect()) == sorted(plain.collect())
    frequency = scoring.document_frequency(t, "content")
    assert joined_texts(plain)
    assert not any(joined_texts(df) for df in (base, frequency, scoring.vectors(t, batch, "id", "content")))
    monkeypatch.setattr(scoring, "FREQUENT", 3)
    assert {(r.term, r.df) for r in scoring.frequent(frequency).collect()} == {("text", 50), ("fil", 50)}
    monkeypatch.setattr(scoring, "FREQUENT", 1)
    assert scoring.frequent(frequency).collect() == []


def test_texts_that_hold_a_query(spark, monkeypatch):
    """As the columns' ``contains`` has it: parts of words at both ends, queries without a word inside, none and empty ones."""
    monkeypatch.setattr(scoring, "BLOCK", 3)
    rows = ["a fila do lote noturno", "A fila da mesa", "lote de balanças", "xyz-1 b2", None, "", "fila do lote", "É a fila do Lote noturno, sim", "ação do lote e a"]
    asks = ["ila do lot", "fila", "la da m", "", None, "do lote noturno", "ção do", "a f", "z-1 b", "Lote", "nada disso aqui", "a fila do lote noturno"]
    t = spark.createDataFrame([(i, r) for k in range(3) for i, r in enumerate(rows, 100 * k)], "id long, content string")
    q = spark.createDataFrame(list(enumerate(asks)), "query_id int, query string")
    got = scoring.holding(t, q, "id", "content")
    want = t.crossJoin(q).where(F.contains("content", F.col("query"))).select("query_id", "id")
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())
    assert {x.query_id for x in got.collect()} >= {0, 1, 2, 3, 5, 6, 7, 8, 9, 11}


def test_a_ranking_meets_its_texts_where_they_are_read(spark, monkeypatch):
    """However small Spark is told to take for small, no text is shuffled to meet a ranking."""
    from cairn.plans import registry

    monkeypatch.setattr(registry, "texts", lambda spark, sf: spark.createDataFrame([(i, f"t{i}") for i in range(9)], "id long, content string"))
    monkeypatch.setattr(registry, "memories", lambda spark, sf: registry.texts(spark, sf))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = registry._with_content(spark, "", spark.createDataFrame([(1, 3, 1), (1, 4, 2), (2, 3, 1)], "query_id long, id long, rank long"))
        assert sorted((r.query_id, r.id, r.content) for r in got.collect()) == [(1, 3, "t3"), (1, 4, "t4"), (2, 3, "t3")]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_conflict_pairs_rank_once(spark, monkeypatch):
    """The ranking is there before its pairs are looked for, and the relations meet it where they are."""
    from pyspark.sql import Window

    from cairn.plans import registry

    rows = spark.createDataFrame([(1, 3, "fact"), (1, 4, "fact"), (2, 3, "decision"), (2, 5, "checkpoint")], "query_id long, id long, type_name string")
    monkeypatch.setattr(registry, "_channels", lambda spark, sf: rows)
    monkeypatch.setattr(registry.ranking, "hybrid", lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))))
    monkeypatch.setattr(registry, "relations", lambda spark, sf: spark.createDataFrame([(4, 3), (5, 3)], "source_id long, target_id long"))
    got = registry.QUERIES["conflict_pairs"](spark, "")
    assert [tuple(r) for r in got.collect()] == [(1, 3, 4)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_channels_by_what_can_match(spark, monkeypatch):
    """Queries that differ only in words no value has are asked once; odd white space, names inside words, empty and missing queries give the plain channels' pairs."""
    from cairn.operators import channels

    meta = [
        {"source_path": "src/a/run.py", "qualified_name": "a.RunIt", "cli_command": "run-it", "cli_option": "--dry-size", "manufacturer": "Toledo", "environment": "sala  de testes"},
        {"source_path": "tests/run.py", "source_heading": "RunIt", "cli_command": "run", "manufacturer": " Filizola", "branch": "a\tb"}, {"device_model": "prix quatro"}, {},
    ]
    r = spark.createDataFrame([(i, meta[i % 4], f"p{i % 2}") for i in range(24)], "id long, metadata map<string,string>, project_id string")
    texts = ["commit {0} run it da toledo", "{0} RunIt prix {0} quatro", "prix quatro {0}", "na sala  de testes {0}", "na sala de testes {0}", "x a\tb {0}", "da  filizola {0}", "toledo\tprix {0} quatro", "abrir src/a/run.py --dry-size {0}"]
    asks = [t.format(f"{i * 2654435761 % 2**32:08x}") for i in range(12) for t in texts] + ["", None, "fila1", "zz1fila1zz", "commit aaf1la99 x"]
    q = spark.createDataFrame([(i, t, None, {"manufacturer": "toledo"} if i % 10 == 0 else {}) for i, t in enumerate(asks)], "query_id long, query string, project_id string, filters map<string,string>")
    projects = spark.createDataFrame([("p0", "Fila1"), ("p1", "f1la9")], "project_id string, name string")
    rows = lambda df: sorted((x.query_id, x.id, x.score) for x in df.collect())
    seen = {}

    def watched(name):
        plain = getattr(channels, name)
        monkeypatch.setattr(channels, name, lambda queries, *more: (seen.setdefault(name, queries.count()), plain(queries, *more))[1])
        return plain

    for name in ("path", "symbol", "cli"):
        plain = watched(f"{name}_pairs")
        assert rows(getattr(channels, f"{name}_matches")(q, r)) == rows(plain(q, r)), name
    plain = watched("metadata_pairs")
    for asked in (q, q.drop("filters")):
        got = rows(channels.metadata_matches(asked, r, projects))
        assert got and got == rows(plain(asked, r, projects))
        some = spark.createDataFrame([(i, k) for i in range(60) for k in range(0, 24, 5)], "query_id long, id long")
        wanted = {(x.query_id, x.id) for x in some.collect()}
        assert rows(channels.metadata_matches(asked, r, projects, only=some)) == [x for x in got if x[:2] in wanted]
    assert {k: v < 40 for k, v in seen.items()} == dict.fromkeys(seen, True) and len(seen) == 4


def test_pairs_of_copies_are_dealt_out_and_pack(spark, tmp_path, monkeypatch):
    """Of one value and one text: every pair once, over many tasks, and in an order that a file packs to a small part of a pair's bytes."""
    from cairn.operators import assisted, channels

    monkeypatch.setattr(assisted, "SHARE", 100_000)
    q = spark.range(301).selectExpr("id * 7 AS query_id", "'run it' AS query", "CAST(NULL AS string) AS project_id")
    r = spark.range(3001).selectExpr("id * 11 + 1 AS id", "map('cli_command', 'run') AS metadata")
    got = channels.cli_matches(q, r)
    got.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 301 * 3001 and out.where("query_id % 7 = 0 AND id % 11 = 1 AND score = 1").count() == 301 * 3001
    made = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) > 4 and max(made) < 301 * 3001 / 3
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 301 * 3001


def test_retrieval_asks_alike_queries_once(spark, monkeypatch):
    """Copies of a query are answered once, and those that differ in a word that nothing has meet the classes once; rankings as from all pairs."""
    from cairn.operators import assisted, channels

    rows = [(i, "fact", "balança da fila" if i % 2 else "lote noturno", "verified", None, None, f"p{i % 2}", i, None, None, {"manufacturer": "Toledo" if i % 3 else "Filizola", "commit_sha": f"{i + 1:08x}" * 5, "qualified_name": f"a.Run{i % 4}"}) for i in range(40)]
    r = spark.createDataFrame(rows, "id long, type string, content string, status string, decision_status string, hypothesis_state string, project_id string, created_at long, valid_from timestamp, valid_to timestamp, metadata map<string,string>")
    texts = ["commit {0} da fila toledo", "{0} lote Run1", "fila {0} {0}x atual"]
    q = spark.createDataFrame([(i * 2 + c, texts[i % 3].format(f"{i * 2654435761 % 2**32:08x}" if i % 5 else f"{i + 1:08x}"), None) for i in range(18) for c in (0, 1)], "query_id long, query string, project_id string")
    rel = spark.createDataFrame([(1, 3, "references", 1)], "source_id long, target_id long, relation_type string, rank long")
    seen = {}
    for name in ("candidates", "text_matches"):
        monkeypatch.setattr(channels, name, lambda queries, *more, name=name, plain=getattr(channels, name): (seen.setdefault(name, queries.count()), plain(queries, *more))[1])
    day = F.lit("2024-03-01").cast("timestamp")
    found, out = channels.retrieve(q, r, rel, day)
    assert seen == {"candidates": 18, "text_matches": 3} and out.count() == 36
    got = sorted((x.query_id, x.id, x.final, x.content, x.metadata["manufacturer"]) for x in found.where("rank <= 3").collect())
    best = channels.not_only_test_text(assisted.ranked(channels.scored(q, r, rel, day)))
    want = channels.constrained(best, channels.constraint(channels.identifiers_met(q, best)))
    want = sorted((x.query_id, x.id, x.final, x.content, x.metadata["manufacturer"]) for x in want.withColumn("n", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rank)")).where("n <= 3").collect())
    assert got == want and len({x[0] for x in got}) > 6


def test_test_files_are_left_out_before_pairs(spark):
    """The pairs that the filter of ranked rows leaves, from a plan that joins no pairs with records' paths."""
    from cairn.operators import channels

    paths = ["src/a.py", "tests/a.py", "tests\\b.py", None]
    r = spark.createDataFrame([(i, {"manufacturer": "Toledo" if i % 3 else "Filizola", "commit_sha": f"{i + 1:08x}" * 5, **({"source_path": paths[i % 4]} if paths[i % 4] else {})}, f"p{i % 2}") for i in range(48)], "id long, metadata map<string,string>, project_id string")
    q = spark.createDataFrame([(i, f"commit {i + 1:08x} da toledo" if i % 2 else "commit 0000000a filizola", None) for i in range(20)], "query_id long, query string, project_id string")
    projects = spark.createDataFrame([("p1", "da")], "project_id string, name string")
    rows = channels.metadata_pairs(q, r, projects).join(channels.commit_matches(q, r).withColumnRenamed("score", "commit"), ["query_id", "id"], "left").fillna({"commit": 0.0})
    rows = rows.join(r.select("id", F.col("metadata")["source_path"].alias("source_path")), "id").withColumns({c: F.lit(0.0) for c in ("identifier", "path", "symbol", "cli")})
    want = sorted((x.query_id, x.id) for x in channels.not_only_test_text(rows).collect())
    got = channels.metadata_beyond_tests(q, r, projects)
    assert sorted((x.query_id, x.id) for x in got.collect()) == want
    # No join stands above the lists that pairs are made from.
    assert want and "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    tests = [i for i in range(48) if i % 4 in (1, 2)]
    assert {i for _, i in want} & set(tests) and len(want) < channels.metadata_pairs(q, r, projects).count()


def test_pairs_of_an_identifier_pack(spark, tmp_path):
    """All hints meet one list of records before the next, so that a pair takes a small part of a byte in a file."""
    from cairn.operators import assisted

    h = spark.range(200).selectExpr("id * 3 AS query_id", "'ticket_number' AS field", "'7' AS raw", "'7' AS norm")
    s = spark.range(5003).selectExpr("id * 5 AS id", "'ticket_number' AS field", "'7' AS norm")
    assisted.identifier_exact(h, s).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert set(out.columns) == {"query_id", "field", "raw", "norm", "id"} and out.distinct().count() == out.count() == 200 * 5003
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.5 * 200 * 5003
