"""Substring dedup by line hashing: repeated passages go, their first occurrence stays.

Method: a text is cut into lines and these into sentences. A sentence is normalised
(lower case, words joined by one space, no outer punctuation) and digested; the unit
that is hashed is a passage: from each sentence on, and back from each sentence, the
fewest whole sentences in a row that have ``min_words`` words together, over line
ends as well. Digests of units are grouped globally, the occurrence with the smallest
(doc_id, place) is kept, and every other one is removed; what is removed is returned
as offsets in the original text.

Sentences of more than ``LONG`` words (text without punctuation) are cut further
after words chosen by their hash, so that copies are cut alike wherever they begin.
So a passage is found that starts inside a line, runs over several lines or is set
in short ones. What stays: repeated runs of fewer than ``min_words`` words, such as a
single short line that many documents share; the words at either end of a passage
that aren't a whole sentence of it; lines without words.

An occurrence that overlaps the kept one in the same text goes from where that ends.
The 16-byte digest stands for a unit. A unit that half the corpus repeats is an
ordinary aggregation key, combined in each task before it is shuffled, and the
ranks of its occurrences come back by a join that Spark can split.

Edge cases: null and empty texts have nothing to remove; a null doc_id ranks after
all others; of equal rows one is first (the hash of the text breaks ties, rows
equal in both share their fate and stay); an empty table gives an empty result;
further columns are kept, but for ones named kept_text or removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import erase, pick, stored, text_or_empty

MIN_WORDS = 20
#: Words of a sentence beyond which it is cut by content, and one in how many words then ends a piece.
LONG, PIECE = 40, 8
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
END = re.compile(r"[.!?…]+[\"'”’»)\]]*[^\S\n]+|[。！？]+|\n+")
WORD = re.compile(r"\S+")


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of the sentences with words, in order; the white space after one is its own."""
    at = 0
    for end in (*(m.end() for m in END.finditer(text)), len(text)):
        words = [w.strip(OUTER) or w for w in text[at:end].lower().split()]
        if len(words) > LONG:
            yield from _pieces(text, at, end)
        elif words:
            yield at, end, words
        at = end


def _pieces(text: str, at: int, end: int) -> Iterator[tuple[int, int, list[str]]]:
    words, ends, start = [], [], at
    for m in WORD.finditer(text, at, end):
        w = m[0].lower()
        words.append(w.strip(OUTER) or w)
        ends.append(m.end())
    first = 0
    for k, w in enumerate(words):
        if k == len(words) - 1 or xxhash.xxh64_intdigest(w) % PIECE == 0:
            stop = end if k == len(words) - 1 else ends[k] + 1
            yield start, stop, words[first : k + 1]
            first, start = k + 1, stop


def passages(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of a text's units."""
    parts = list(sentences(text))
    n = [len(w) for _, _, w in parts]
    digests = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for _, _, w in parts]
    seen = set()
    # Two pointers: the fewest sentences from each first one, then back from each last one.
    high = words = 0
    for low in range(len(parts)):
        while high < len(parts) and words < min_words:
            words += n[high]
            high += 1
        if words < min_words:
            break
        seen.add((low, high))
        words -= n[low]
    low = words = 0
    for high in range(len(parts)):
        words += n[high]
        while words - n[low] >= min_words:
            words -= n[low]
            low += 1
        if words >= min_words:
            seen.add((low, high + 1))
    for low, high in sorted(seen):
        yield parts[low][0], parts[high - 1][1], xxhash.xxh3_128_digest(b"".join(digests[low:high]))


def _units(docs: DataFrame, min_words: int, tie: Column) -> DataFrame:
    """(d1, d2: the digest; doc_id, tie, start, end) of every unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, digest = [], [], [], []
            for i, t in enumerate(b.column(2)):
                for s, e, d in passages(t.as_py(), min_words):
                    row.append(i)
                    start.append(s)
                    end.append(e)
                    digest.append(d)
            take = pa.array(row, pa.int64())
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["d1", "d2", "doc_id", "tie", "start", "end"])

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), tie.alias("tie"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "d1 long, d2 long, doc_id long, tie long, start int, end int")


def _first(units: DataFrame) -> DataFrame:
    """(d1, d2, first): the kept occurrence of every digest that occurs again."""
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie", "start", "end")
    return units.groupBy("d1", "d2").agg(F.min(at).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")


def _others(units: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, tie, start, end) of all other occurrences."""
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie", "start", "end")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    start = F.when(same, F.greatest("start", "first.end")).otherwise(F.col("start")).alias("start")
    return units.join(first, ["d1", "d2"]).where(~at.eqNullSafe(F.col("first"))).select("doc_id", "tie", start, "end").where("start < end")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with further columns ``kept_text`` and ``removed`` (array of start, end: maximal runs, code points of the original)."""
    spark = docs.sparkSession
    # Where no doc_id repeats it says by itself which text is meant, and no hash of the text goes with each unit.
    unique = docs.groupBy(F.col("`doc_id`").cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    tie = F.lit(0).cast("long") if unique else F.xxhash64(text_or_empty())
    units, units_path = stored(_units(docs, min_words, tie))
    # The first occurrences are a table of their own, so that Spark can split a digest that very many units have.
    first, first_path = stored(_first(units))
    marks, _ = stored(_others(units, first).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("list")))
    erase(spark, units_path, first_path)
    names = [c for c in docs.columns if c not in ("kept_text", "removed")]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("`doc_id`").cast("long").alias("id"), tie.alias("tie"), F.col("`text`").cast("string").alias("text"))
    found = marks.select(F.col("doc_id").alias("id2"), F.col("tie").alias("tie2"), "list")
    joined = whole.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2")), "left").select("row", "text", "list")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = [], []
            for text, spans in zip(b.column(1), b.column(2)):
                text, runs = text.as_py(), []
                for s in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(s[1], runs[-1][1]))
                    else:
                        runs.append(s)
                if runs:
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    text = "".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                kept.append(text)
                gone.append([{"start": s, "end": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(gone, kind)], names=["row", "kept_text", "removed"])

    schema = T.StructType([joined.schema["row"], *T.StructType.fromDDL("kept_text string, removed array<struct<start:int,end:int>>")])
    return joined.mapInArrow(run, schema).select("row.*", "kept_text", "removed")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents of ``docs`` without their repeated passages; a text of nothing but repeats becomes empty."""
    extra = [c for c in ("kept_text", "removed") if c in docs.columns]
    hidden = docs.withColumnsRenamed({c: f"__{c}" for c in extra})
    out = dedup_lines(hidden, min_words)
    columns = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.withColumns(columns).drop("kept_text", "removed").withColumnsRenamed({f"__{c}": c for c in extra}).select(*[F.col(f"`{c}`") for c in docs.columns])
