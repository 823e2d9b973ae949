"""What a ranking says about itself: conflicts, gaps, inferences, explanations, summaries, rates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is compared for conflicts, and the sentences of a diagnosis.
COMPARED = ("fact", "decision", "hypothesis")
CONFLICTING = ("contradicted_by", "supersedes")
STALE = ("obsolete", "superseded")
NOTHING, EXPECTED = "No relevant memories found for this query", "This query likely expects a 'no evidence' answer — absence is the correct response"
HINTED, WEAK = "No strong matches for hinted type ", "Only weak candidates found; results may be unreliable"
INFERENCES = {"absent": "No direct matches; this represents a genuine absence of evidence.", "weak": "Weak matches only; verify before relying on these results."}
NOT_FOUND = "Nenhuma lembrança confiável foi localizada com os parâmetros e esclarecimentos fornecidos. Resultados aproximados não devem ser usados como memória confirmada."
SNIPPET, SHOWN, SHOWN_CONFLICTS = 80, 5, 5


def decimals(c: Column, places: int = 4) -> Column:
    """Rounded half to even, as scores are shown."""
    return F.bround(c, places)


def buckets(ranked: DataFrame, quality: DataFrame, absence: DataFrame) -> DataFrame:
    """The rows that are handed out: none with a negative score, and none at all where the query asks for absence and finds it.

    ``quality`` is (query_id, quality), ``absence`` (query_id, absence).
    """
    silent = quality.where("quality = 'absent'").join(absence.where("absence"), "query_id").select("query_id")
    return ranked.where("score >= 0").join(silent, "query_id", "left_anti")


def conflicts(ranked: DataFrame, relations: DataFrame) -> DataFrame:
    """(query_id, kind, a, b, message): stale records, contradicting or superseding pairs (each once), and ids with several versions.

    Pairs come from the relations by two joins, never from the ranking's own pairs.
    """
    top = ranked.where(F.col("type_name").isin(*COMPARED))
    by = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit(" (superseded_by: "), F.col("superseded_by").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    ident = F.col("id").cast("string")
    stale = top.where(F.col("status").isin(*STALE)).select("query_id", F.lit("state").alias("kind"), ident.alias("a"), F.lit(None).cast("string").alias("b"), F.concat(F.lit("STATE_CONFLICT: "), ident, F.lit(" is "), "status", by).alias("message"))
    r = relations.where(F.col("relation_type").isin(*CONFLICTING)).select("source_id", "target_id", "relation_type")
    place = top.select("query_id", "id", "rank")
    pairs = r.join(place.toDF("query_id", "source_id", "rs"), "source_id").join(place.toDF("query_id", "target_id", "rt"), ["query_id", "target_id"]).where("source_id <> target_id")
    # Of both directions of one pair and type the one from the better ranked record is told.
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    w = Window.partitionBy("query_id", "relation_type", low, high).orderBy((F.col("rs") > F.col("rt")).cast("int"))
    pairs = pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    s, t = F.col("source_id").cast("string"), F.col("target_id").cast("string")
    pairs = pairs.select("query_id", F.col("relation_type").alias("kind"), s.alias("a"), t.alias("b"), F.concat(F.lit("CONFLICT: "), s, F.lit(" "), "relation_type", F.lit(" "), t).alias("message"))
    out = stale.unionByName(pairs)
    if "version" in ranked.columns:
        v = top.groupBy("query_id", "id").agg(F.array_sort(F.collect_set(F.col("version").cast("string"))).alias("v")).where("size(v) > 1")
        out = out.unionByName(v.select("query_id", F.lit("version").alias("kind"), ident.alias("a"), F.lit(None).cast("string").alias("b"), F.concat(F.lit("VERSION_CONFLICT: "), ident, F.lit(" appears with versions "), F.array_join("v", ", ")).alias("message")))
    return out


def missing(quality: Column, absence: Column, hint: Column) -> Column:
    """What a query's answer lacks, as an array of sentences."""
    absent, weak = quality == "absent", quality == "weak"
    return F.array_compact(F.array(
        F.when(absent, F.lit(NOTHING)), F.when(absent & F.coalesce(absence, F.lit(False)), F.lit(EXPECTED)),
        F.when(weak & hint.isNotNull(), F.concat(F.lit(HINTED), hint)), F.when(weak, F.lit(WEAK)),
    ))


def inference(quality: Column) -> Column:
    """The sentence that an absent or weak answer comes with; null for a relevant one."""
    return F.when(quality == "absent", F.lit(INFERENCES["absent"])).when(quality == "weak", F.lit(INFERENCES["weak"]))


def _lines(ranked: DataFrame, score: str, parts: list[str], reasons: bool) -> DataFrame:
    shown = F.array_join(F.transform(F.array(*[F.struct(F.lit(p).alias("n"), decimals(F.col(p).cast("double")).alias("v")) for p in parts]), lambda x: F.concat(x["n"], F.lit("="), x["v"].cast("string"))), ", ")
    line = F.concat(F.lit("  ["), F.format_number(F.col(score), 3), F.lit("] "), F.col("id").cast("string"), F.lit(" ("), F.coalesce("type_name", F.lit("?")), F.lit("): "), F.substring(F.coalesce("content", F.lit("(not found)")), 1, SNIPPET), F.lit("\n     "), shown)
    if reasons:
        line = F.concat(line, F.when(F.size("reasons") > 0, F.concat(F.lit("\n     reasons: "), F.array_join(F.slice("reasons", 1, SHOWN), "; "))).otherwise(F.lit("")))
    best = ranked.where(F.col("rank") <= SHOWN).select("query_id", F.struct("rank", line.alias("line")).alias("l"))
    return best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("lines"))


def explain(queries: DataFrame, ranked: DataFrame, found: DataFrame, parts: list[str]) -> DataFrame:
    """(query_id, explanation) of a hybrid ranking: its best five rows with channels, up to five conflicts, gaps and the inference.

    ``queries`` is (query_id, query, quality, absence, type_hint), ``found`` what ``conflicts`` returns.
    """
    told = found.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("message"))).groupBy("query_id").agg(F.count("*").alias("n_conflicts"), F.array_sort(F.collect_list(F.when(F.col("__n") <= SHOWN_CONFLICTS, F.col("message")))).alias("told"))
    counts = ranked.groupBy("query_id").agg(F.count("*").alias("n"))
    j = queries.join(_lines(ranked, "score", parts, False), "query_id", "left").join(told, "query_id", "left").join(counts, "query_id", "left")
    gaps = missing(F.col("quality"), F.col("absence"), F.col("type_hint"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Quality: "), "quality", F.lit(" | Retrieved "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" items.")), F.col("lines"),
        F.when(F.col("n_conflicts") > 0, F.concat(F.lit("Conflicts detected: "), F.col("n_conflicts").cast("string"), F.lit("\n  "), F.array_join("told", "\n  "))),
        F.when(F.size(gaps) > 0, F.concat(F.lit("Missing information:\n  - "), F.array_join(gaps, "\n  - "))), F.when(inference(F.col("quality")).isNotNull(), F.concat(F.lit("[INFERENCE] "), inference(F.col("quality")))),
    )
    return j.select("query_id", text.alias("explanation"))


def explain_assisted(queries: DataFrame, ranked: DataFrame, outcome: DataFrame, parts: list[str], most: int = 3) -> DataFrame:
    """(query_id, explanation) of an assisted retrieval; ``queries`` is (query_id, query, used)."""
    j = queries.join(outcome, "query_id").join(_lines(ranked.withColumnsRenamed({"type": "type_name"}) if "type_name" not in ranked.columns else ranked, "final", parts, "reasons" in ranked.columns), "query_id", "left")
    text = F.concat_ws(
        "\n", F.concat(F.lit("State: "), "state"), F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Clarifications used: "), F.col("used").cast("string"), F.lit(f"/{most}")), F.col("lines"),
        F.when((F.col("state") == "CLARIFICATION_REQUIRED") & F.col("question").isNotNull(), F.concat(F.lit("Clarification ("), "dimension", F.lit("): "), "question")), F.when(F.col("state") == "NOT_FOUND", F.lit(NOT_FOUND)),
    )
    return j.select("query_id", text.alias("explanation"))


def reasons(scored: DataFrame, channels: list[str]) -> DataFrame:
    """``scored`` with ``reasons``: the channels that speak for a row, strongest first."""
    each = F.filter(F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("n")) for c in channels]), lambda x: x["v"] != 0)
    return scored.withColumn("reasons", F.transform(F.array_sort(each, lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)), lambda x: F.concat(x["n"], F.lit(": "), F.round(x["v"], 4).cast("string"))))


def top_records(ranked: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, top, scores): the first record and the best k scores of each query."""
    best = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("top"), F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    return best.select("query_id", "top", F.transform("s", lambda x: x["score"]).alias("scores"))


def rates(metrics: DataFrame, ranked: DataFrame, fakes: DataFrame, found: DataFrame, expected: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: means of the per-query ``metrics`` and the rates of fake sources, marked inferences and detected conflicts.

    ``fakes`` are ranked rows without a record, ``expected`` is (query_id, n) of expected conflicts. The last rate has no bound.
    """
    means = [c for c in metrics.columns if c not in ("query_id", "recall_1")]
    m = metrics.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in means])
    one = lambda df, c: df.agg(c)
    out = m.join(one(ranked, F.count("*").alias("n_retrieved"))).join(one(fakes, F.count("*").alias("n_fakes"))).join(one(found, F.count("*").alias("n_conflicts")))
    out = out.join(one(expected, F.coalesce(F.sum("n"), F.lit(0)).alias("n_expected"))).join(one(quality, F.count_if(F.col("quality").isin("absent", "weak")).alias("n_inferences")))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.select("n_queries", *means, F.round(share("n_fakes", "n_retrieved"), 6).alias("fake_source_rate"), F.round(share("n_inferences", "n_queries"), 6).alias("inference_mark_rate"), F.round(share("n_conflicts", "n_expected"), 6).alias("conflict_detection_rate"))


def capsule_summary(items: DataFrame, layers: tuple[str, ...]) -> DataFrame:
    """(query_id, num_<layer> for each layer, total_characters, estimated_tokens)."""
    chars = (F.sum(F.length("content")) + 2 * (F.count("*") - 1)).cast("long")
    out = items.groupBy("query_id").agg(*[F.count_if(F.col("layer") == x).alias(f"num_{x}") for x in layers], chars.alias("total_characters"))
    return out.withColumn("estimated_tokens", F.greatest(F.lit(1), F.floor(F.col("total_characters") / 4)).cast("long"))


def capsule_averages(sizes: DataFrame, raw_chars: int = 0) -> DataFrame:
    """One row: mean characters and tokens cut to whole numbers, and the share that a capsule saves of the raw history."""
    out = sizes.agg(F.floor(F.coalesce(F.avg("chars"), F.lit(0.0))).cast("long").alias("avg_chars"), F.floor(F.coalesce(F.avg("tokens"), F.lit(0.0))).cast("long").alias("avg_tokens"))
    return out.withColumn("reduction", (1 - F.col("avg_chars") / F.lit(float(raw_chars))) if raw_chars > 0 else F.lit(0.0))


def verdict(criteria: DataFrame) -> DataFrame:
    """One row (verdict, failures, warnings) from (name, met, severity 'failure' or 'warning'): an unmet failure fails, an unmet warning leaves it open."""
    unmet = criteria.where("NOT coalesce(met, false)")
    named = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("name"))))
    out = unmet.agg(named("failure").alias("failures"), named("warning").alias("warnings"))
    return out.select(F.when(F.size("failures") > 0, "FAILED").when(F.size("warnings") > 0, "INCONCLUSIVE").otherwise("PASSED").alias("verdict"), "failures", "warnings")


def phase(rows: DataFrame, n: int, column: str = "phase") -> DataFrame:
    """What a replay has seen after phase n."""
    return rows.where(F.col(column) <= n)


def association(user: str, query: str, record: DataFrame, stored: DataFrame, filters: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(anchor records to add, edges to add) for a record that a user has confirmed: the anchor is a fact, unless it is stored."""
    spark = record.sparkSession
    anchor = spark.createDataFrame([(user, "fact", f"user_confirmed_association:{user}", "")], "id string, type string, content string, project_id string").join(stored.select("id"), "id", "left_anti")
    meta = F.map_concat(F.create_map(F.lit("kind"), F.lit("user_confirmed_association"), F.lit("query"), F.lit(query)), filters if filters is not None else F.create_map().cast("map<string,string>"))
    edge = record.select(F.lit(user).alias("source_id"), F.col("id").cast("string").alias("target_id"), F.lit("references").alias("relation_type"), meta.alias("metadata"))
    return anchor, edge.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "source_id", "target_id", "relation_type"), 256), 1, 16))
