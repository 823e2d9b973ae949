"""Quality rules: base rules, then an isolation forest on their statistics.

Method: every text gives the counts of the base rules and ratios made of them. An
isolation forest cuts random sub-samples by random splits; rows that fall alone
after few cuts are anomalous. The forest is built from a sample of at most
``SAMPLE`` rows by hash, as the method does (a tree sees 256 rows); the path length below which a row is
rejected is calibrated on all labelled rows: the one with the largest difference
between the rejected shares of quality 0 and of quality 1. Labels flipped at random
shrink that difference alike at every threshold, so noise doesn't move its place.

Edge cases: null, empty and wordless texts fail the base rules (fewer than 20
words); null doc_ids and repeated rows keep a row each; without labels of both
kinds, or where their paths differ no more than by chance, the forest rejects nothing; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick
from .shingles import mix

SAMPLE = 8_192
TREES, SUBSAMPLE = 128, 256
#: Paths are numbers of so many places, a few ten thousand at most, so that those of all labelled rows can be counted.
PATH_PLACES = 3
#: Factor of the two-sample Kolmogorov-Smirnov bound at 5 %: labels that differ less don't set a threshold.
CHANCE = 1.36
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
#: The forest's features; ratios, so that a text's length alone is no anomaly.
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "distinct", "line_words", "longest_word", "top_word")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
PLACES = np.array([(2 * i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1 for i in range(WINDOW)], dtype=np.uint64)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    # Each distinct word has its number, so equal windows are equal rows and no hash decides alone.
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h += mix(codes[i : i + n] ^ PLACES[i])
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    rows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[at]
    _, inverse, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    hit = at[count[inverse.ravel()] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, len(SYMBOLS.findall(text)), 0, 0], [0.0] * len(FEATURES)
    spaces = raw.count(b" ") + raw.count(b"\n") + raw.count(b"\t") + raw.count(b"\r") + raw.count(b"\x0b") + raw.count(b"\x0c")
    chars = len(text) - spaces
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    tally = Counter(words)
    a = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(a, minlength=256)
    upper, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    punct = int(kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum())
    features = [
        chars / n, symbols / n, dups / len(lines), repeats / n, upper / chars, digits / chars, punct / chars,
        len(tally) / n ** 0.8, np.log1p(n / len(lines)), np.log1p(max(map(len, tally))), max(tally.values()) / n,
    ]
    return [n, chars, symbols, dups, repeats], [float(f) for f in features]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t.as_py()) for t in b.column(1)]
        counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, i]) for i in range(5)], pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"])


class Forest:
    """An isolation forest in arrays: node -> feature, cut, children; leaves hold their depth."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sub: int = SUBSAMPLE, seed: int = 5):
        rng = np.random.default_rng(seed)
        sub = min(sub, len(rows))
        self.limit = int(np.ceil(np.log2(max(sub, 2))))
        nodes: list[tuple[int, float, int, int, float]] = []
        self.roots = []
        for _ in range(trees):
            pick_ = rows[rng.choice(len(rows), sub, replace=False)]
            self.roots.append(self._grow(pick_, 0, rng, nodes))
        self.feature = np.array([n[0] for n in nodes], np.int64)
        self.cut = np.array([n[1] for n in nodes])
        self.left = np.array([n[2] for n in nodes], np.int64)
        self.right = np.array([n[3] for n in nodes], np.int64)
        self.depth = np.array([n[4] for n in nodes])

    @staticmethod
    def _rest(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator, nodes: list) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, at, at, depth + self._rest(len(rows))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        can = np.flatnonzero(high > low)
        if depth < self.limit and len(rows) > 1 and len(can):
            f = int(rng.choice(can))
            c = float(rng.uniform(low[f], high[f]))
            side = rows[:, f] < c
            if side.any() and not side.all():
                left = self._grow(rows[side], depth + 1, rng, nodes)
                right = self._grow(rows[~side], depth + 1, rng, nodes)
                nodes[at] = (f, c, left, right, 0.0)
        return at

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int64)
            for _ in range(self.limit):
                f = self.feature[at]
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] < self.cut[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            total += self.depth[at]
        return total / len(self.roots)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The path length under which rows go: it separates the paths of both labels best."""
    edges = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    return counted_threshold(edges, *(np.searchsorted(x, edges, "right") - np.searchsorted(x, edges) for x in (good, bad)))


def counted_threshold(edges: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The same of ascending paths and how many rows of either label have each."""
    n_good, n_bad = good.sum(), bad.sum()
    if not n_good or not n_bad:
        return float("-inf")
    caught, lost = ((np.cumsum(x) - x) / x.sum() for x in (bad, good))
    best = int(np.argmax(caught - lost))
    return float(edges[best]) if caught[best] - lost[best] > CHANCE * np.sqrt(1 / n_good + 1 / n_bad) else float("-inf")


def _sampled(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, by the hash of the key: the same rows however they are dealt."""
    n = df.count()
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(min(1.0, most / max(n, 1)) * (1 << 40)))


def base_failed():
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, path."""
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    stats = cut(source.mapInArrow(_measure, f"doc_id long, {COUNTS}, features array<double>").withColumn("base_failed", base_failed()))
    drawn = _sampled(stats.where("NOT base_failed"), "doc_id", sample, 3).select("doc_id", "features").orderBy("doc_id").collect()
    forest = Forest(np.array([r.features for r in drawn])) if len(drawn) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(6).to_pylist(), float).reshape(-1, len(FEATURES))
            path = np.round(forest.path(x), PATH_PLACES) if forest and len(x) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(path)], names=[*b.schema.names[:6], "path"])

    least = float("-inf")
    if forest:
        # Every labelled row counts: a row for each path and label comes to the driver.
        y = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        known = stats.where("NOT base_failed").join(y, "doc_id").select(*[c for c in stats.columns if c != "base_failed"], "quality")

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(6).to_pylist(), float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(7), pa.array(np.round(forest.path(x), PATH_PLACES) if len(x) else np.zeros(0))], names=["quality", "path"])

        told = known.mapInArrow(paths, "quality int, path double").groupBy("path").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).orderBy("path").collect()
        least = counted_threshold(*(np.array([r[i] for r in told], float) for i in range(3)))

    plain = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features")
    out = plain.mapInArrow(run, f"doc_id long, {COUNTS}, path double").withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("path") >= least)).alias("kept"), "path")
