"""Mixing sources to target weights by pivotal dependent rounding.

Method: every document starts with the copy rate of its source, target / size. The
whole part is copied outright; the fractional parts are paired, and mass moves
at random between the two of a pair, keeping the expected words, until one of
them is 0 or 1. What stays fractional of a block of documents, one at most, goes
to the next level of a reduction tree with ``FAN`` children a node, so that each
source's words meet its target up to the rounding of one small document.

Only DataFrame functions run here. A block is a bounded number of rows of one
source drawn by hash, so a source with a third of all documents is spread over as
many blocks as its size asks for. Random draws are hashes of the document, the
seed and the level: reruns agree.

Edge cases: a null text has size 0 and takes nothing; a null source is a source
of its own, last in order; a null doc_id is a row like any other; repeated rows
are rounded each by itself; an empty table gives an empty result; further columns
are ignored. Sources all of size 0 get target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Children of a node of the reduction tree: rows that one fold sees.
FAN = 64
STEP = "struct<doc_id:bigint,tie:bigint,part:bigint,rate:double,hold:bigint,draw:double,row:bigint>"
#: What identifies an item: tie is the hash of its text, so that rows without a doc_id are spread; row is the caller's key, if any.
KEY = ("doc_id", "tie", "row")


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{name}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size: a row a source) with part, weight and target.

    Water filling: sources in order of cap / weight fill up first; the rest share
    what is left by weight. One row a source takes part, so the ordering is small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("part", F.lit(len(weights))).cast("int") + 1)
    t = sizes.withColumn("part", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", w)
    t = t.withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.col("cap") / F.col("weight"))
    order = Window.orderBy("level", "part")
    t = t.withColumns({
        "full_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    t = t.withColumn("fill", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
    # The water level is the fill at the first source that isn't filled up by it.
    t = t.withColumn("water", F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "part", "fill"))).over(Window.partitionBy())["fill"])
    return t.select("source", "source_size", "part", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def _fold(items: Column) -> Column:
    """Pair the items one after another, from the largest: (left: the one that is still fractional, done: the others).

    A step moves words between the held item x and the next y with x.hold *
    x.rate + y.hold * y.rate constant, and each rate keeps its expectation.
    """
    x, y = (lambda s: s["left"]), (lambda i: i)

    def step(s: Column, i: Column) -> Column:
        a, b, p, q = x(s)["hold"], y(i)["hold"], x(s)["rate"], y(i)["rate"]
        up = F.least(1 - p, q * b / a)
        down = F.least(p, (1 - q) * b / a)
        rise = i["draw"] * (up + down) < down
        # Rates within rounding error of 0 or 1 are set to it, or neither of a pair would be settled.
        snap = lambda r: F.when(r < 1e-9, F.lit(0.0)).when(r > 1 - 1e-9, F.lit(1.0)).otherwise(r)
        p2 = snap(F.when(rise, p + up).otherwise(p - down))
        q2 = snap(F.when(rise, q - up * a / b).otherwise(q + down * a / b))
        new_x, new_y = s["left"].withField("rate", p2), i.withField("rate", q2)
        first_done = (p2 == 0) | (p2 == 1)
        return F.when(
            s["left"].isNull() | (s["left"]["rate"] == 0) | (s["left"]["rate"] == 1),
            F.struct(i.alias("left"), F.when(s["left"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["left"]))).alias("done")),
        ).otherwise(
            F.struct(F.when(first_done, new_y).otherwise(new_x).alias("left"), F.concat(s["done"], F.array(F.when(first_done, new_x).otherwise(new_y))).alias("done"))
        )

    start = F.struct(F.lit(None).cast(STEP).alias("left"), F.array().cast(f"array<{STEP}>").alias("done"))
    return F.aggregate(items, start, step)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, copies."""
    return _mix(docs, F.lit(None), weights, most, seed).drop("row")


def _mix(docs: DataFrame, row: Column, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 17) -> DataFrame:
    """``mix`` with a further column row: the given key of each row of ``docs``."""
    key = row.cast("long").alias("row")
    rows = docs.select(key, F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), F.col("`source`").cast("string").alias("source"), word_count().alias("size"))
    rows = cut(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sources.select("source", "source_size"), weights, most)
    plan = plan.join(sources.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan = cut(plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    top = plan.agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(top, 2), FAN / 2)))

    per = plan.select("source", "part", "n", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("rate"))
    items = rows.join(per, F.col("source_l").eqNullSafe(per.source)) if "source_l" in rows.columns else rows.withColumnRenamed("source", "source_l").join(per, F.col("source_l").eqNullSafe(per.source))
    # Documents without words, and sources whose rate is whole, are settled at once.
    live = items.where("size > 0 AND rate > 0").select(*KEY, "part", "rate", F.col("size").alias("hold"), "n")
    settled = items.where("NOT (size > 0 AND rate > 0)").select(*KEY, "part", F.lit(0.0).alias("rate"), F.col("size").alias("hold"))
    outs = [settled]
    for level in range(levels):
        h = F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "hold", "tie")
        draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id", "hold", "tie"), F.lit(1 << 52)) / float(1 << 52)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float((FAN / 2) ** (level + 1))))) if level + 1 < levels else F.lit(1)
        keyed = live.withColumn("block", F.pmod(h, blocks)).withColumn("draw", draw)
        one = F.struct("doc_id", "tie", "part", "rate", "hold", "draw", "row")
        grouped = keyed.groupBy("part", "block").agg(F.array_sort(F.collect_list(F.struct(-F.col("hold"), F.col("draw"), one.alias("one")))).alias("list"), F.max("n").alias("n"))
        folded = cut(grouped.select("n", _fold(F.transform("list", lambda e: e["one"])).alias("f")))
        outs.append(folded.select(F.explode("f.done").alias("d")).select(*[f"d.{k}" for k in KEY], "d.part", "d.rate", "d.hold"))
        left = folded.select("n", "f.left.*")
        if level + 1 == levels:
            # One document a source may still be fractional: the nearer of 0 and 1.
            outs.append(left.select(*KEY, "part", F.round("rate").alias("rate"), "hold"))
        else:
            outs.append(left.where("rate = 0 OR rate = 1").select(*KEY, "part", "rate", "hold"))
            live = left.where("rate > 0 AND rate < 1").select(*KEY, "part", "rate", "hold", "n")
    done = outs[0]
    for o in outs[1:]:
        done = done.union(o)
    sized = plan.select(F.col("part"), "source_size", "target", F.floor("rate").cast("long").alias("whole"))
    copies = F.col("whole") + F.col("d_rate").cast("long")
    out = done.withColumnRenamed("rate", "d_rate").join(sized, "part")
    return out.select("row", "doc_id", F.col("hold").alias("size"), "source_size", "target", (copies * F.col("hold")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` as the mix holds them: each row once for every copy, with size, copies, taken and target.

    Each row gets its own copies, with or without a doc_id and however often that
    repeats: rows are numbered in a cut of ``docs``, and matched by their numbers.
    """
    extra = [c for c in ("size", "copies", "taken", "target", "copy") if c in docs.columns]
    numbered = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    chosen = _mix(numbered, F.col("__row"), **parameters).where("copies > 0").select(F.col("row").alias("__row"), "size", "copies", "taken", "target")
    got = numbered.drop(*extra).join(chosen, "__row")
    # Columns as before: the key, the other columns of the documents, then the mix's.
    names = [c for c in docs.columns if c not in ("doc_id", *extra)]
    got = got.select("doc_id", "size", *[F.col(f"`{c}`") for c in names], "copies", "taken", "target")
    return got.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
