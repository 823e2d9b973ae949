"""Toxicity scores: a weighted lexicon, matched by Aho-Corasick over folded text.

Method: texts are folded (lower case, look-alike letters and digits to Latin
letters, accents off) into words with one space between. The lexicon holds word
beginnings and whole words with the log-odds of their documents' labels; phrases
that begin like an entry but occur in clean documents only are exceptions. One
automaton finds entries and exceptions in one pass; the weights of the entries
found, longest at each word, are normalised by length, and a logistic curve turns
them into a score between 0 and 1.

Everything is learned from a sample of at most about ``SAMPLE`` labelled rows, drawn by
the hash of the doc_id among rows that are not held out (crc32 of the id's text
mod 3 is not 1). Counting runs in Spark; the driver gets at most ``ENTRIES``
entries and ``SAMPLE`` rows of three numbers. Scores see the text alone.

Edge cases: null, empty and wordless texts get the score of a text without
matches; a null doc_id is not held out; repeated rows keep a row each; an empty
table gives an empty result; without labels of both kinds the lexicon is empty and
all scores are 0; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: Most labelled rows to learn from, in expectation.
SAMPLE = 20_000
#: Most lexicon entries and most exceptions.
ENTRIES = 2_000
PREFIXES = range(4, 11)
#: An entry's toxic count is at least so many standard deviations over chance.
DEVIATIONS = 6.0
# Cyrillic and Greek letters that look like Latin ones, and digits that stand for letters.
ALIKE = str.maketrans("авекмнорстухіјѕԁɡαβεηικνορτυχ", "abekmhopctyxijsdgabenikvoptux")
DIGITS = str.maketrans("0134578", "oieastb")
WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    if not text:
        return []
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(ALIKE)) if not unicodedata.combining(c))
    return [w if w.isalpha() or w.isdigit() else w.translate(DIGITS) for w in WORD.findall(t)]


@dataclass
class Lexicon:
    """Entries (`` word`` begins so, `` word `` is whole) and exceptions, with the curve's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    fitted: bool = False

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for e, w in self.weights.items():
            a.add_word(e, (len(e), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), 0.0))
        if len(a):
            a.make_automaton()
            return a
        return None

    @staticmethod
    def features(words: list[str], automaton: ahocorasick.Automaton | None) -> tuple[float, float, float]:
        """Weight per hundred words, total weight (both as logarithms), share of distinct entries."""
        if not words or automaton is None:
            return 0.0, 0.0, 0.0
        best: dict[int, tuple[int, float]] = {}
        for end, (n, w) in automaton.iter(" " + " ".join(words) + " "):
            start = end - n
            # At a place the longest match decides; an exception, being longer, has the weight 0.
            if n >= best.get(start, (0, 0.0))[0]:
                best[start] = (n, w)
        total = sum(w for _, w in best.values())
        return float(np.log1p(100 * total / len(words))), float(np.log1p(total)), float(np.log1p(sum(w > 0 for _, w in best.values())))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.curve[0] + x @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))) if self.fitted else np.zeros(len(x))


def held_out(name: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, toxic and all, that hold each word beginning and each whole word."""
    toxic, all_ = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(all_)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([all_[k] for k in keys], pa.int64())], names=["entry", "toxic", "n"])
        toxic.clear()
        all_.clear()
        return out

    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist()):
            words = set(fold(text.as_py()))
            entries = {" " + w[:k] for w in words for k in PREFIXES if len(w) >= k} | {f" {w} " for w in words if len(w) <= 40}
            all_.update(entries)
            if label:
                toxic.update(entries)
            if len(all_) > 300_000:
                yield flush()
    yield flush()


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows that are not held out."""
    y = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = y.count()
    # The rows whose hash falls under sample / n: a bounded number, whatever the size of the table.
    drawn = cut(y.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < int(min(1.0, sample / max(n, 1)) * (1 << 40))))
    text = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    text = cut(text)
    total, bad = (int(v or 0) for v in text.agg(F.count("*"), F.sum("toxic")).first())
    if not bad or bad == total:
        return Lexicon()
    p = bad / total
    counts = cut(text.mapInArrow(_candidates, "entry string, toxic long, n long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("n >= 3"))
    over = (F.col("toxic") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (total - bad + 1.0))
    strong = counts.where((over >= DEVIATIONS) & (odds > 1.5)).select("entry", odds.alias("w"), F.col("n")).orderBy(F.desc("w"), "entry").limit(ENTRIES * 4).collect()
    # An entry that a beginning of itself does as well as is left out.
    weights: dict[str, float] = {}
    for r in sorted(strong, key=lambda r: (len(r.entry), r.entry)):
        shorter = [weights[r.entry[:k]] for k in range(2, len(r.entry)) if r.entry[:k] in weights]
        if not shorter or r.w > max(shorter) + 0.7:
            weights[r.entry] = float(r.w)
    weights = dict(sorted(weights.items(), key=lambda e: -e[1])[:ENTRIES])
    heads = sorted({e.rstrip() for e in weights})
    exceptions = []
    if heads:
        # Entries that begin a word have five characters or more, the space included.
        starts = F.substring("entry", 1, 5).isin(sorted({h[:5] for h in heads}))
        clean = counts.where(starts & F.endswith("entry", F.lit(" ")) & (F.col("toxic") == 0)).select("entry").orderBy(F.desc("n"), "entry").limit(ENTRIES).collect()
        exceptions = [r.entry for r in clean if any(r.entry.startswith(h) for h in heads) and r.entry not in weights]
    lexicon = Lexicon(weights, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            x = np.array([Lexicon.features(fold(t.as_py()), a) for t in b.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(3)], b.column(1)], names=["x0", "x1", "x2", "toxic"])

    rows = np.array([tuple(r) for r in text.mapInArrow(measure, "x0 double, x1 double, x2 double, toxic int").collect()], float)
    rows = rows[np.lexsort(rows.T)]
    lexicon.curve = _fit_curve(rows[:, :3], rows[:, 3])
    lexicon.fitted = True
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            x = np.array([Lexicon.features(fold(t.as_py()), a) for t in b.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lexicon.score(x))], names=["doc_id", "score"])

    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    out = source.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that are not predicted toxic, with their columns; each is judged where it stands, with no join."""
    lexicon = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for b in batches:
            at = b.schema.get_field_index("text")
            x = np.array([Lexicon.features(fold(t.as_py()), a) for t in b.column(at)]).reshape(-1, 3)
            yield b.filter(pa.array(lexicon.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
