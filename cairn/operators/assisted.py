"""Identifier-constrained ranking: match channels, constraint status, outcome state, clarification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from .store import cut

# Weights, thresholds and texts of the assisted ranking.
WEIGHTS = {"identifier": 2.0, "path": 1.5, "symbol": 1.2, "commit": 1.0, "cli": 0.8, "attributes": 0.6, "text": 0.5, "temporal": 0.3, "relation": 0.25}
CONFIRMED, MARGIN, AMBIGUOUS, CLARIFY, FLOOR = 0.35, 0.15, 0.22, 0.10, 0.06
PARTIAL, PARTIAL_FROM, PER_FIELD, FIELDS_CAP, POOL = 0.55, 4, 0.25, 0.9, 50
#: Pairs of one key that a task makes; pairs of a task; values of a list, a multiple of eight as files pack them by eights.
SHARE, TASK, LIST = 2_000_000, 50_000_000, 256
OBSOLETE, SUPERSEDED, HYPOTHESIS = 0.20, 0.25, 0.10
PRIORITY = (
    "project_id", "manufacturer", "device_model", "serial_number", "mac_address", "protocol_number", "ticket_number", "file_path", "file_name", "environment", "responsible",
    "repository", "branch", "commit_sha", "valid_from", "memory_type", "status", "organization_id", "client_id", "entity_id",
)
QUESTIONS = {
    "project_id": "Você lembra em qual projeto isso aconteceu?", "organization_id": "Você lembra a qual empresa ou organização isso se refere?", "client_id": "Você lembra de qual cliente se trata?",
    "entity_id": "Você lembra de qual entidade ou equipamento se trata?", "environment": "Era no ambiente de testes ou produção?", "responsible": "Você lembra quem era o responsável?",
    "manufacturer": "Você lembra o fabricante do equipamento?", "device_model": "Você lembra o modelo do equipamento?", "serial_number": "Você tem parte do número de série?",
    "mac_address": "Você lembra do endereço MAC do equipamento?", "protocol_number": "Você lembra do número do protocolo?", "ticket_number": "Você lembra do número do chamado?",
    "file_path": "Você lembra do caminho da pasta ou arquivo?", "file_name": "Você lembra do nome do arquivo?", "repository": "Você lembra do repositório onde isso estava?",
    "branch": "Você lembra do nome da branch?", "commit_sha": "Você lembra do commit SHA?", "valid_from": "Você lembra aproximadamente de quando isso aconteceu?",
    "memory_type": "Era uma decisão aprovada, um fato verificado ou uma hipótese?", "status": "Era uma decisão vigente ou já substituída?",
}
GIVE_UP = ("nao", "não", "no", "n", "nao sei", "não sei", "")


def stored_identifiers(records: DataFrame) -> DataFrame:
    """(id, field, norm) from records with ``metadata`` MAP<STRING, STRING>."""
    e = records.select("id", F.explode("metadata").alias("field", "raw")).where(F.col("field").isin(*ids.FIELDS))
    return e.withColumn("norm", ids.identifier(F.col("field"), F.col("raw"))).where("norm <> ''")


def query_hints(queries: DataFrame) -> DataFrame:
    """(query_id, field, raw, norm)."""
    h = queries.select("query_id", F.explode(ids.hints(F.col("query"))).alias("h")).select("query_id", "h.field", "h.raw")
    return h.withColumn("norm", ids.identifier(F.col("field"), F.col("raw"))).where("norm <> ''")


def tasks_for(spark, n: int) -> int:
    """Tasks that make ``n`` pairs: the inputs are far smaller than the pairs, so it isn't for the size of these to say."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-n // TASK))


def listed(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, list): each key's values in order, ``LIST`` a row."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    return rows.select(*key, value, F.floor((place - 1) / LIST).alias("__list")).groupBy(*key, "__list").agg(F.array_sort(F.collect_list(value)).alias("list")).drop("__list")


def identifier_exact(hints: DataFrame, stored: DataFrame) -> DataFrame:
    """Every pair of a hint and a record with its identifier, ``SHARE`` pairs a part or so.

    An identifier of many queries and records has its records dealt out over parts and its hints sent to each, so that no task makes
    all its pairs; the number of tasks grows with the pairs. Records come as lists, and all hints meet one list before the next, so that a file of the pairs packs well.
    """
    key, spark = ["field", "norm"], hints.sparkSession
    own = stored.select("id", *key)
    n = hints.groupBy(*key).agg(F.count("*").alias("a")).join(own.groupBy(*key).agg(F.count("*").alias("b")), key).select(*key, (F.col("a") * F.col("b")).alias("n"))
    n = cut(n)
    heavy = F.broadcast(n.select(*key, F.ceil(F.col("n") / SHARE).cast("int").alias("parts")).where("parts > 1"))
    tasks = tasks_for(spark, n.agg(F.sum("n")).first()[0] or 0)
    parts = F.coalesce("parts", F.lit(1))
    h = hints.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    s = listed(own.join(heavy, key, "left").withColumn("__part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts"), "id", *key, "__part")
    key = [*key, "__part"]
    pairs = s.repartition(tasks, *key).hint("merge").join(h.repartition(tasks, *key), key)
    return pairs.select("field", "norm", *[c for c in hints.columns if c not in key], F.explode("list").alias("id"))


def identifier_partial(hints: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, id, field, score): one value begins or ends the other; 0.55 * shorter / longer.

    The whole shorter value is the join key: each value meets those that equal one of the longer one's
    beginnings or ends, of lengths that the other side has. Equal values are one row on either side until they are matched.
    """
    n = PARTIAL_FROM
    own = hints.select("query_id", "field", "norm").where(F.length("norm") >= n)
    have = stored.select("id", "field", F.col("norm").alias("snorm")).where(F.length("snorm") >= n)
    a, b = own.select("field", "norm").distinct(), have.select("field", "snorm").distinct()

    def sizes(df: DataFrame, c: str) -> DataFrame:
        return df.groupBy("field").agg(F.array_sort(F.collect_set(F.length(c))).alias("sizes"))

    def ends(longer: DataFrame, c: str, shorter: DataFrame, d: str) -> DataFrame:
        """Pairs where ``d`` is a proper beginning or end of ``c``."""
        text = F.col(c)
        cuts = F.flatten(F.transform(F.filter("sizes", lambda k: k < F.length(text)), lambda k: F.array(F.substring(text, F.lit(1), k), F.right(text, k))))
        return longer.join(F.broadcast(sizes(shorter, d)), "field").select("field", c, F.explode(F.array_distinct(cuts)).alias(d)).join(shorter, ["field", d]).select("field", "norm", "snorm")

    q, s = F.col("norm"), F.col("snorm")
    share = F.lit(PARTIAL) * F.least(F.length(q), F.length(s)) / F.greatest(F.length(q), F.length(s))
    met = ends(b, "snorm", a, "norm").union(ends(a, "norm", b, "snorm")).withColumn("score", share)
    return own.join(met, ["field", "norm"]).join(have, ["field", "snorm"]).groupBy("query_id", "id", "field").agg(F.max("score").alias("score"))


def commit_matches(queries: DataFrame, stored: DataFrame) -> DataFrame:
    """(query_id, id, score): 1 for a whole SHA, 0.6 for a beginning of 7 digits or more."""
    p = queries.select("query_id", ids.commit_prefix(F.col("query")).alias("prefix")).where("prefix IS NOT NULL").withColumn("key", F.substring("prefix", 1, 7))
    s = stored.where("field = 'commit_sha' AND length(norm) >= 7").select("id", "norm", F.substring("norm", 1, 7).alias("key"))
    return p.join(s, "key").where(F.startswith("norm", F.col("prefix"))).groupBy("query_id", "id").agg(F.max(F.when(F.col("norm") == F.col("prefix"), 1.0).otherwise(0.6)).alias("score"))


def complete(field: Column, raw: Column) -> Column:
    """Whether a hint is specific enough that finding nothing means there is nothing."""
    least = F.when(field == "commit_sha", 7).otherwise(4)
    bare = (field == "file_path") & ~F.rlike(raw, F.lit(r"[\\/]"))
    digit = ~field.isin("protocol_number", "ticket_number", "issue_id") | F.rlike(raw, F.lit("[0-9]"))
    return (F.length(raw) >= least) & ~bare & digit


def counted(stored: DataFrame) -> DataFrame:
    """(field, norm, n): the records of each identifier."""
    return stored.groupBy("field", "norm").agg(F.countDistinct("id").alias("n"))


def constraint(hints: DataFrame, matches: DataFrame) -> DataFrame:
    """(query_id, status, n_matches) for queries with hints; ``matches`` is (query_id, field, norm, id)."""
    return constraint_of(hints, matches.groupBy("query_id", "field", "norm").agg(F.countDistinct("id").alias("n")))


def constraint_of(hints: DataFrame, counts: DataFrame) -> DataFrame:
    """(query_id, status, n_matches) for queries with hints; ``counts`` is (field, norm, n), each query's own or of all records (``counted``).

    Hints are grouped by canonical value: nothing matched and something complete, or
    a complete value matched by nothing, is NOT_FOUND; otherwise what is missing
    makes it PARTIAL, one match MATCHED_UNIQUE, more MATCHED_MULTIPLE.
    """
    h = hints.join(counts, [c for c in ("query_id", "field", "norm") if c in counts.columns], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sure": complete(F.col("field"), F.col("raw")) | (F.col("field") == "commit_sha")})
    g = h.groupBy("query_id", "norm").agg(F.sum("n").alias("n"), F.max("sure").alias("sure"))
    q = g.groupBy("query_id").agg(F.sum("n").cast("long").alias("n_matches"), F.min("n").alias("low"), F.max(F.col("sure") & (F.col("n") == 0)).alias("sure_miss"))
    status = F.when((F.col("low") == 0) & F.col("sure_miss"), "NOT_FOUND").when(F.col("low") == 0, "PARTIAL").when(F.col("n_matches") == 1, "MATCHED_UNIQUE").otherwise("MATCHED_MULTIPLE")
    return q.select("query_id", status.alias("status"), "n_matches")


def identifier_best(hints: DataFrame, stored: DataFrame, records: DataFrame, pool: int = POOL) -> DataFrame:
    """(query_id, id) of the exact matches that ``ranked`` can keep where nothing but an identifier speaks for a record: of each
    identifier the best ``pool`` records, which rank alike for every query that names it. Records without a positive score are left out."""
    scores = final_score(records.withColumn("identifier", F.lit(1.0))).where("final > 0").select("id", "final", "created_at")
    order = [F.desc("final"), F.desc("created_at"), F.asc("id")]
    s = stored.select("id", "field", "norm").distinct().join(scores, "id").withColumn("__part", F.pmod(F.xxhash64("id"), F.lit(64)))
    # First of each of 64 parts of an identifier's records, then of what these leave: no task sorts all of them.
    near = s.withColumn("__p", F.row_number().over(Window.partitionBy("field", "norm", "__part").orderBy(*order))).where(F.col("__p") <= pool)
    first = near.withColumn("__p", F.row_number().over(Window.partitionBy("field", "norm").orderBy(*order))).where(F.col("__p") <= pool)
    return identifier_exact(hints, first).select("query_id", "id").distinct()


def final_score(channels: DataFrame) -> DataFrame:
    """``final`` from channel columns (missing ones count 0), status, type and intent columns."""
    have = set(channels.columns)
    c = {n: (F.col(n) if n in have else F.lit(0.0)) for n in WEIGHTS}
    total = F.lit(0.0)
    for n, w in WEIGHTS.items():
        total = total + c[n] * w
    signal = F.lit(False)
    for n in ("identifier", "attributes", "text", "path", "symbol", "cli", "commit"):
        signal = signal | (c[n] > 0)
    col = lambda n, d: F.coalesce(F.col(n), F.lit(d)) if n in have else F.lit(d)
    active = (col("type", "") == "decision") & (col("decision_status", "") == "active")
    gone = col("status", "") == "superseded"
    base = F.when(signal, total).otherwise(0.0) - F.when(signal & (col("status", "") == "obsolete"), OBSOLETE).when(signal & gone, SUPERSEDED).otherwise(0.0) - F.when(signal & (col("type", "") == "hypothesis") & (col("hypothesis_state", "") != "sustained"), HYPOTHESIS).otherwise(0.0)
    now = F.when(active, 0.25).when(gone, -0.15).otherwise(0.0)
    past = F.when(gone, 0.15).when(active, -0.10).otherwise(0.0)
    moved = base + F.when(col("wants_current", False), now).when(col("wants_past", False), past).otherwise(0.0)
    return channels.withColumn("final", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6))


def ranked(scored: DataFrame, pool: int = POOL) -> DataFrame:
    """Positive scores, best first, at most ``pool`` a query; one row a source path, with the number of its rows."""
    order = [F.desc("final"), F.desc("identifier"), F.desc("created_at"), F.asc("id")]
    w = Window.partitionBy("query_id").orderBy(*order)
    best = scored.where("final > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)
    own = F.concat(F.lit("id "), F.col("id").cast("string"))
    group = F.coalesce(F.concat(F.lit("path "), F.col("source_path")), own) if "source_path" in scored.columns else own
    best = best.withColumn("__g", group)
    g = Window.partitionBy("query_id", "__g")
    best = best.withColumns({"segments": F.count("*").over(g).cast("long"), "__first": F.row_number().over(g.orderBy("rank"))}).where("__first = 1")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")).drop("__g", "__first")


def states(ranking: DataFrame, queries: DataFrame, has_dimension: DataFrame | None = None, exhausted: Column | None = None) -> DataFrame:
    """(query_id, state, best, second): the outcome of each query, first rule that fits."""
    exact = F.col("identifier") >= 1.0
    top = ranking.where("rank <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("final"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("final"))).alias("second"),
        F.max(F.when(F.col("rank") == 1, exact)).alias("e1"), F.max(F.when(F.col("rank") == 2, exact)).alias("e2"),
    )
    j = queries.select("query_id", *(["spent"] if "spent" in queries.columns else [])).join(top, "query_id", "left")
    asks = F.lit(False)
    if has_dimension is not None:
        j = j.join(has_dimension.select("query_id", F.lit(True).alias("asks")), "query_id", "left")
        asks = F.coalesce("asks", F.lit(False))
    b, s = F.col("best"), F.coalesce("second", F.lit(-1.0))
    state = (
        F.when(b.isNull(), "NOT_FOUND").when(F.col("e1") & (b >= CONFIRMED), F.when(F.coalesce("e2", F.lit(False)) & (s >= CONFIRMED), "AMBIGUOUS").otherwise("CONFIRMED"))
        .when(b >= CONFIRMED, F.when(F.col("second").isNull() | (b - s >= MARGIN), "CONFIRMED").when(s >= AMBIGUOUS, "AMBIGUOUS").otherwise("CONFIRMED"))
        .when((b >= AMBIGUOUS) & (s >= AMBIGUOUS), "AMBIGUOUS").when(b < FLOOR, "NOT_FOUND").when(F.lit(False) if exhausted is None else exhausted, "NOT_FOUND")
        .when((b >= CLARIFY) & asks, "CLARIFICATION_REQUIRED").otherwise("NOT_FOUND")
    )
    return j.select("query_id", state.alias("state"), "best", "second")


def clarification(ranking: DataFrame, dimensions: list[str], answered: DataFrame | None = None) -> DataFrame:
    """(query_id, dimension, question): the first dimension on which the best three differ."""
    named = F.array(*[F.struct(F.lit(PRIORITY.index(d)).alias("p"), F.lit(d).alias("dimension"), F.lower(F.col(d).cast("string")).alias("v")) for d in dimensions])
    long_ = ranking.where("rank <= 3").select("query_id", F.explode(named).alias("d")).select("query_id", "d.*").where("v IS NOT NULL AND v <> ''")
    if answered is not None:
        long_ = long_.join(answered.select("query_id", "dimension"), ["query_id", "dimension"], "left_anti")
    differs = long_.groupBy("query_id", "p", "dimension").agg(F.count("*").alias("n"), F.countDistinct("v").alias("k")).where("n >= 2 AND k >= 2")
    first = differs.groupBy("query_id").agg(F.min_by("dimension", "p").alias("dimension"))
    text = F.create_map(*[F.lit(x) for d in PRIORITY for x in (d, QUESTIONS[d])])
    return first.withColumn("question", F.element_at(text, F.col("dimension")))


def session_fold(turns: DataFrame, most: int = 3) -> DataFrame:
    """(session, n_answers, used, gave_up, last_answer): a session's answers in the order of its turns."""
    list_ = F.array_sort(F.collect_list(F.struct("turn", "answer")))
    s = turns.groupBy("session").agg(list_.alias("list")).withColumn("words", F.transform("list", lambda x: F.lower(F.trim(x["answer"]))))
    gave = F.exists("words", lambda w: F.coalesce(w.isin(*GIVE_UP), F.lit(True)))
    n = F.size("list").cast("long")
    return s.select("session", n.alias("n_answers"), F.when(gave, F.lit(most).cast("long")).otherwise(F.least(n, F.lit(most).cast("long"))).alias("used"), gave.alias("gave_up"), F.trim(F.element_at("list", -1)["answer"]).alias("last_answer"))


LAYERS = ("checkpoint", "decision", "fact", "episode", "learning", "document")


def capsule(ranking: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, layer, layer_ord, place, id, content): the best records of each layer; decisions must be active."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, l in enumerate(LAYERS) for x in (l, i)]), F.col("type_name"))
    usable = ranking.where(F.col("type_name").isin(*LAYERS) & ((F.col("type_name") != "decision") | (F.col("decision_status") == "active")))
    w = Window.partitionBy("query_id", "type_name").orderBy("rank")
    return usable.withColumns({"place": F.row_number().over(w).cast("long"), "layer_ord": order.cast("long")}).where(F.col("place") <= most).select("query_id", F.col("type_name").alias("layer"), "layer_ord", "place", "id", "content")


def capsule_size(items: DataFrame) -> DataFrame:
    """(query_id, items, chars, tokens): contents joined by an empty line, four characters a token."""
    chars = F.sum(F.length("content")) + 2 * (F.count("*") - 1)
    return items.groupBy("query_id").agg(F.count("*").alias("items"), chars.cast("long").alias("chars")).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long"))
