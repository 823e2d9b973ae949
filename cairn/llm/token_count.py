"""Token counts of whole texts without materialising ids.

Method: a document's pre-tokens are tallied, the distinct pre-tokens of the whole
corpus are gathered by one aggregation and each is encoded once, and the number of
its pieces is joined back to the documents' tallies and summed.

1. Texts of plain characters (``PLAIN``: ASCII and Latin letters, for which the
   tokenizer's normal form is lower case) are cut into pre-tokens inside Spark by the
   tokenizer's own pattern. All others are normalised by the library and tallied in
   Arrow batches; there the spelling of an added token is one token of its own, and
   what lies between is counted as a text of its own, as the library does it.
2. The distinct pre-tokens, with their frequency, become a written table with their
   piece counts.
3. That table is broadcast while it has at most ``BROADCAST`` rows. Beyond it the most
   frequent ones are, at most so many, and the long tail is tallied by (document,
   pre-token) and joined by a shuffle: no frequent pre-token is a shuffle key.

A tokenizer that doesn't split by such a pattern has no pre-tokens to count; its
texts are counted by the library one by one.

Edge cases: null and empty texts have no bytes and no tokens; null doc_ids and
repeated rows keep a row each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Distinct pre-tokens that are broadcast at most (about 60 bytes each).
BROADCAST = 100_000
#: Texts or pre-tokens that are encoded at once, and rows of a tally that are held at once.
ENCODED, HELD = 1_000, 50_000
#: Longer texts are tallied match by match, never as one list of pre-tokens.
LONG = 1 << 20
#: Characters whose normal form both sides agree on: white space, printable ASCII, Latin letters of one code point.
PLAIN = r"^[\t\n\r\x20-\x7E\x{C0}-\x{FF}]*$"
# The pattern that Spark's regular expressions read as the library does, and the normaliser it stands behind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


@cache
def counter_of(path: str) -> PieceCounter:
    """The counter of a file, read once by each worker however many tasks it runs."""
    return PieceCounter(path)


class PieceCounter:
    """Pre-token tallies of texts and piece counts of pre-tokens, by the tokenizer of a file."""

    def __init__(self, path: str):
        # A worker is one of several on its machine: threads of its own would only take memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        split = next((p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"), None)
        self.known = bool(split) and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"] and spec.get("post_processor") is None
        self.pattern = split["pattern"]["Regex"] if self.known else ""
        self.find = regex.compile(self.pattern, regex.V0)
        steps = spec.get("normalizer") or {}
        self.native = self.known and self.pattern == PATTERN and [s.get("type") for s in steps.get("normalizers", [])] == NORMALIZERS
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else (lambda s: s)
        self.special = regex.compile("|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True))) if self.added else None

    def tally(self, text: str) -> tuple[Counter, int]:
        """(pre-token -> times, added tokens) of a text."""
        parts = self.special.split(text) if self.special else [text]
        out: Counter = Counter()
        for part in parts:
            normal = self.normalize(part)
            out.update(self.find.findall(normal) if len(normal) <= LONG else (m[0] for m in self.find.finditer(normal)))
        return out, len(parts) - 1

    def pieces(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for k in range(0, len(words), ENCODED):
            out += [len(e) for e in self.tokenizer.encode_batch(words[k : k + ENCODED], add_special_tokens=False)]
        return out


def _tallies(source: DataFrame, counter: PieceCounter, path: str) -> DataFrame:
    """(row, doc_id, n_bytes, token, n): the pre-tokens of each text; without a token, n added tokens. Every text has a row."""
    keys = ["row", "doc_id", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter_of(path)
        for b in batches:
            at, token, n = [], [], []
            for i, text in enumerate(b.column(3)):
                words, added = own.tally(text.as_py() or "")
                at += [i] * (len(words) + 1)
                token += [None, *words]
                n += [added, *words.values()]
                if len(token) > HELD:
                    yield rows(b, at, token, n)
                    at, token, n = [], [], []
            yield rows(b, at, token, n)

    def rows(b: pa.RecordBatch, at: list, token: list, n: list) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(token, pa.string()), pa.array(n, pa.int64())], names=[*keys, "token", "n"])

    def wide(df: DataFrame) -> DataFrame:
        return df.select(*keys, "text").mapInArrow(run, "row long, doc_id long, n_bytes long, token string, n long")

    if not counter.native:
        return wide(source)
    plain: Column = F.coalesce(F.col("text").rlike(PLAIN), F.lit(True))
    for a in counter.added:
        plain = plain & ~F.coalesce(F.contains("text", F.lit(a)), F.lit(False))
    marked = source.withColumn("plain", plain)
    words = F.regexp_extract_all(F.lower("text"), F.lit(PATTERN), F.lit(0))
    near = marked.where("plain").select(*keys, F.explode_outer(words).alias("token")).withColumn("n", F.col("token").isNotNull().cast("long"))
    return near.unionByName(wide(marked.where("NOT plain")))


def _by_library(source: DataFrame, path: str, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.pieces([t.as_py() or "" for t in b.column(2)]), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return source.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, broadcast: int = BROADCAST) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    counter = counter_of(path)
    source = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string"),
    )
    if not counter.known:
        return _by_library(source, path, limit)
    tally = _tallies(source, counter, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.pieces(b.column(0).to_pylist()), pa.int64()), b.column(1)], names=["token", "pieces", "times"])

    distinct = tally.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("times"))
    pieces, _ = stored(distinct.mapInArrow(encode, "token string, pieces long, times long"))
    n = pieces.count()
    near = pieces
    if n > broadcast:
        # Strictly over the quantile: of equally frequent ones at its edge none is broadcast.
        near = pieces.where(F.col("times") > pieces.approxQuantile("times", [1 - broadcast / n], broadcast / n / 8)[0])
    known = tally.join(F.broadcast(near.select("token", "pieces")), "token", "left")
    total = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    if n <= broadcast:
        out = known.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), total)
    else:
        # One pass: a row a document for what is known, and one for each rare pre-token that it has.
        rare = F.when(F.col("pieces").isNull(), F.col("token")).alias("token")
        some, _ = stored(known.withColumn("n", F.col("n") * F.coalesce("pieces", F.lit(1))).groupBy("row", rare).agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes")))
        more = some.where("token IS NOT NULL").join(pieces.select("token", "pieces").hint("merge"), "token").select("row", "doc_id", "n_bytes", (F.col("n") * F.col("pieces")).alias("n"))
        both = some.where("token IS NULL").select("row", "doc_id", "n_bytes", "n").unionByName(more)
        out = both.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
