"""Each stage of the corpus pipeline on odd rows and against plain versions, and the whole of it on a small table."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cairn.llm import mixing, near_dedup, quality, toxicity

from test_corpus_operators import SCHEMA, brute_line_dedup, brute_targets, odd_rows, plain_edits, plain_fold, rows_of, shingles

SF = "/root/testdata/sf0.001"
STAGES = dict(pipeline.STAGES)


def plain_score(lexicon, text):
    """The score by looking at every word's beginning: the longest entry or exception there decides."""
    words = toxicity.fold(text)
    if not lexicon.fitted:
        return 0.0
    found, padded = [], " " + " ".join(words) + " "
    known = {**{e: 0.0 for e in lexicon.exceptions}, **lexicon.weights}
    by_start = defaultdict(list)
    for e in known:
        by_start[e[:4]].append(e)
    for at in range(len(padded)):
        if padded[at] == " ":
            hits = [e for e in by_start[padded[at : at + 4]] + by_start[padded[at : at + 3]] if padded.startswith(e, at)]
            if hits:
                found.append(known[max(hits, key=len)])
    x = [0.0] * 3
    if words:
        x = [np.log1p(100 * sum(found) / len(words)), np.log1p(sum(found)), np.log1p(sum(w > 0 for w in found))]
    return 1 / (1 + np.exp(-(lexicon.curve[0] + sum(a * b for a, b in zip(lexicon.curve[1:], x)))))


def test_scores_against_plain_matching(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lexicon = toxicity.learn(big, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    rows = big.select("doc_id", "text").union(odd_rows(spark).select("doc_id", "text"))
    got = Counter((r.doc_id, round(r.score, 6), r.predicted) for r in toxicity.score(rows, lexicon).collect())
    assert got == Counter((i, round(s := plain_score(lexicon, t), 6), int(s >= 0.7)) for i, t in rows_of(rows))
    assert lexicon.weights and toxicity.Lexicon().score(np.zeros((2, 3))).tolist() == [0, 0]


def keep_one(rows):
    """What near dedup keeps: per class of similar texts, linked over any number of steps, the first by doc_id."""
    known = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], str(r[1])))
    sets = [shingles(t) for _, t in known]
    label = list(range(len(known)))
    for a in range(len(known)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return known, label


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, name):
    """Nulls, repeated rows, long texts, columns with clashing names, and empty tables."""
    extra = ["removed", "kept_text", "copies", "target", "row", "component_id", "score", "list", "tie", "__row"]
    odd = odd_rows(spark).withColumns({c: F.lit(c) for c in extra})
    for table in (odd, odd.limit(0)):
        got = STAGES[name](spark, table, SF)
        kept = rows_of(got)
        assert set(kept) <= {(i, t) for i, t in rows_of(table)} or name == "substring_dedup"
        if name == "mixing":
            assert {"doc_id", "text", "source"} <= set(got.columns)
        else:
            assert got.columns == table.columns and got.select("score").distinct().count() <= 1
    got = rows_of(STAGES[name](spark, odd, SF))
    rows = rows_of(odd)
    if name in ("toxicity", "decontamination"):
        assert Counter(got) == Counter(rows)  # nothing here is toxic or leaked
    elif name == "near_dedup":
        # Rows 4 and 5 differ in case only, 9 and 10 by one word at the end; 7 (twice) and 8 hold little more than 6.
        assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 4, 6, 9, 11, 12] and None in {i for i, _ in got}
    elif name == "substring_dedup":
        small = odd.where("text IS NULL OR length(text) < 60000")
        assert Counter(rows_of(STAGES[name](spark, small, SF))) == Counter((i, brute_line_dedup(rows_of(small), 20)[(i, t)]) for i, t in rows_of(small))


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = rows_of(docs)
    lexicon = toxicity.learn(docs, labels)
    rows = [(i, t) for i, t in rows if plain_score(lexicon, t) < 0.7]
    known, label = keep_one(rows)
    first = {}
    for k, x in enumerate(label):
        first.setdefault(x, known[k])
    rows = list(first.values())
    left = brute_line_dedup(rows, 20)
    rows = [(i, left[(i, t)]) for i, t in rows]
    items = [f for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(f := plain_fold(r.text)) >= 8]

    def leaks(text):
        folded = plain_fold(text)
        grams = {folded[k : k + 8] for k in range(len(folded) - 7)}
        # The lemma's bound without diagonals rules most pairs out before the whole table is filled.
        for f in items:
            e = max(0, min(len(f) // 10, (len(f) - 8) // 8))
            if sum(f[k : k + 8] in grams for k in range(len(f) - 7)) >= len(f) - 7 - 8 * e and plain_edits(f, folded, e) <= e:
                return True
        return False

    rows = [(i, t) for i, t in rows if not leaks(t)]
    out = pipeline.run(spark, SF)
    got = out.collect()
    texts, taken, sizes = dict(rows), Counter(), Counter()
    source = {r.doc_id: r.source for r in docs.collect()}
    for i, t in rows:
        sizes[source[i]] += len((t or "").split())
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    for r in got:
        taken[r.source] += len(texts[r.doc_id].split())
        assert r.copies <= 3
    target = brute_targets(dict(sizes))
    longest = max(len((t or "").split()) for _, t in rows)
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)


def test_components_and_drop_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known, label = keep_one(rows_of(docs))
    first = {}
    for k, x in enumerate(label):
        first.setdefault(x, known[k])
    assert Counter(rows_of(near_dedup.drop_near_duplicates(docs))) == Counter(first.values())


def test_forest_paths_and_threshold():
    """Vectorised paths against a walk by recursion, and the threshold against all of them tried."""
    rng = np.random.default_rng(2)
    forest = quality.Forest(rng.normal(size=(300, 4)), trees=9, sub=32)
    x = rng.normal(size=(40, 4)) * 2

    def walk(row, at):
        return forest.depth[at] if forest.feature[at] < 0 else walk(row, forest.left[at] if row[forest.feature[at]] < forest.cut[at] else forest.right[at])

    assert np.allclose(forest.path(x), [np.mean([walk(r, t) for t in forest.roots]) for r in x])
    good, bad = rng.normal(1, 1, 80), rng.normal(0, 1, 60)
    best = quality.threshold(good, bad)
    gain = lambda c: (bad < c).mean() - (good < c).mean()
    assert gain(best) == pytest.approx(max(gain(c) for c in np.concatenate([good, bad])))


def test_mixing_many_equal_rows(spark):
    """Rows that nothing but their number tells apart are each rounded by themselves."""
    df = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    out = mixing.take_mix(df).groupBy("source").count().collect()
    target = brute_targets({"0": 900, "1": 900})
    assert {r["source"]: abs(r["count"] * 3 - target[r["source"]]) <= 3 for r in out} == {"0": True, "1": True}
    assert SCHEMA
