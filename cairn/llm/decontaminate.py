"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Method: documents and benchmark items are folded (lower case, everything but
letters and digits to one space) and seen as characters. An item of length L may
be met with up to e = ``EDITS`` * L edits; by the q-gram lemma the place then
shares at least L - q + 1 - q * e q-grams with it, and they lie within e + 1
neighbouring diagonals. q-grams are looked up in a sorted table, counted in
overlapping bands of 2 * (e + 1) diagonals, and the bands that meet the bound are
verified by an alignment of characters on these diagonals and e more each way.

The filter sees a character as one byte: ASCII as it is, others mixed. Different
characters may share a byte, so it may count too many q-grams but never too few.

All documents are read once for each block of at most ``BLOCK`` item bytes, one
behind the other: the benchmark is the stated query set, which passes through the
driver block by block and must fit a worker's memory; no block's size depends on the documents.

Edge cases: null, empty and short texts match nothing; items shorter than q characters
when folded are never looked for; null item texts likewise; null doc_ids and
repeated rows keep a row each; items equal when folded are all reported; empty
tables give an empty result or no matches; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

Q = 8
EDITS = 0.1
BLOCK = 8 << 20
#: Bytes of folded text that one pass of the filter takes.
CHUNK = 2 << 20
TABLE_BITS = 22
MIXER = np.uint64(0x9E3779B97F4A7C15)
SPACES = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
NO_WORD = re.compile(r"[\W_]+")


def folded(text: str | None) -> np.ndarray:
    """Code points of the folded text (bytes if it is ASCII), one space between words, none outside."""
    if not text:
        return np.empty(0, np.uint8)
    low = text.lower()
    if not low.isascii():
        return np.frombuffer(NO_WORD.sub(" ", low).strip(" ").encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.frombuffer(low.encode().translate(SPACES), np.uint8)
    space = a == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[0] = not space[0]
    a = a[keep]
    return a[:-1] if len(a) and a[-1] == 32 else a


def narrow(a: np.ndarray) -> np.ndarray:
    """One byte a character: equal characters give equal bytes."""
    return a if a.dtype == np.uint8 else np.where(a < 128, a, 128 | (a ^ (a >> 7)) & 127).astype(np.uint8)


def grams(a: np.ndarray) -> np.ndarray:
    """All windows of 8 bytes as 64-bit words."""
    n = len(a) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    buf, out = a.tobytes(), np.empty(n, np.uint64)
    for o in range(min(Q, n)):
        part = np.frombuffer(buf, "<u8", count=(n - o + Q - 1) // Q, offset=o)
        out[o::Q] = part
    return out


def budget(length: int, edits: float = EDITS) -> int:
    """Edits allowed for an item: so few that the lemma still asks for a shared q-gram."""
    return max(0, min(int(length * edits), (length - Q) // Q))


def distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Least edits that turn ``item`` into some stretch of ``text`` on the diagonals low to high (place in the text less place in the item), or most + 1.

    Row by row over the item; a row holds the cells of the band alone.
    """
    width, n = high - low + 1, len(text)
    diagonal, steps = np.arange(low, high + 1), np.arange(width)
    pad = np.full(width + len(item), -1, np.int64)
    first, last = max(0, low), min(n, low + len(pad))
    if first < last:
        pad[first - low : last - low] = text[first:last]
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, most + 1)
    for i, c in enumerate(item.tolist(), 1):
        new = row + (pad[i - 1 : i - 1 + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        # Cells before the text's beginning or behind its end don't exist.
        if low + i < 0:
            new[: -low - i] = most + 1
        if high + i > n:
            new[max(0, n - low - i + 1) :] = most + 1
        row = np.minimum(new, most + 1)
        if row.min() > most:
            return most + 1
    return int(row.min())


class Filter:
    """The q-gram table of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        self.ids = [i for i, _ in items]
        self.texts = [folded(t) for _, t in items]
        self.most = np.array([budget(len(t), edits) for t in self.texts], np.int64)
        self.need = np.array([len(t) - Q + 1 - Q * e for t, e in zip(self.texts, self.most)], np.int64)
        codes = [grams(narrow(t)) for t in self.texts]
        gram = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        pos = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.pos = gram[order], item[order], pos[order]
        self.bits = np.zeros(1 << TABLE_BITS, bool)
        self.bits[self._slot(self.gram)] = True
        self.longest = max((len(t) for t in self.texts), default=0)

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * MIXER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def bands(self, a: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, low diagonal, high diagonal) of the bands of ``a`` that meet the bound."""
        g = grams(a)
        at = np.flatnonzero(self.bits[self._slot(g)])
        low = np.searchsorted(self.gram, g[at], "left")
        n = np.searchsorted(self.gram, g[at], "right") - low
        if not n.sum():
            return []
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item = self.item[entry]
        half = (np.repeat(at, n) - self.pos[entry] + self.longest) // (self.most[item] + 1)
        key, count = np.unique((item << 40) | half, return_counts=True)
        # Each half band with the next: a match's diagonals span e + 1, so one such pair holds them all.
        pair = count.copy()
        next_ = np.flatnonzero(key[1:] == key[:-1] + 1)
        pair[next_] += count[next_ + 1]
        found = []
        for k in key[pair >= self.need[key >> 40]]:
            i, h = int(k >> 40), int(k & ((1 << 40) - 1))
            w = int(self.most[i]) + 1
            found.append((i, h * w - self.longest, (h + 2) * w - 1 - self.longest))
        return found

    def matches(self, docs: list[np.ndarray]) -> list[dict[int, int]]:
        """For each folded document: item -> least edits."""
        out: list[dict[int, int]] = [{} for _ in docs]
        at = 0
        while at < len(docs):
            first, size = at, 0
            while at < len(docs) and (at == first or size + len(docs[at]) <= CHUNK):
                size += len(docs[at]) + Q
                at += 1
            self._chunk(docs, first, at, out)
        return out

    def _chunk(self, docs: list[np.ndarray], first: int, end: int, out: list[dict[int, int]]) -> None:
        if end == first + 1 and len(docs[first]) > 2 * CHUNK:
            # A very long text goes piece by piece; pieces overlap by more than any match is long.
            a, step = docs[first], CHUNK
            for s in range(0, len(a), step):
                piece = [{}]
                self._chunk([a[s : s + step + 2 * self.longest]], 0, 1, piece)
                for i, d in piece[0].items():
                    out[first][i] = min(d, out[first].get(i, d))
            return
        gap = np.zeros(Q, np.uint8)
        starts = np.cumsum([0] + [len(d) + Q for d in docs[first:end]])
        whole = np.concatenate([x for d in docs[first:end] for x in (narrow(d), gap)]) if end > first else gap
        for i, lo, hi in self.bands(whole):
            item, most = self.texts[i], int(self.most[i])
            lo, hi = lo - most, hi + most
            for k in range(max(0, np.searchsorted(starts, lo, "right") - 1), min(end - first, np.searchsorted(starts, hi + len(item), "left"))):
                if out[first + k].get(i) == 0:
                    continue
                s, doc = int(starts[k]), docs[first + k]
                if len(doc) >= len(item) - most and (d := distance(item, doc, lo - s, hi - s, most)) <= most:
                    out[first + k][i] = min(d, out[first + k].get(i, d))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, a bounded number of bytes at a time."""
    block, size = [], 0
    for r in pick(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id").toLocalIterator():
        block.append((int(r[0]), str(r[1])))
        size += len(block[-1][1]) * 4
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def _usable(items: list[tuple[int, str]]) -> list[tuple[int, str]]:
    return [x for x in items if len(folded(x[1])) >= Q]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """One row a document: doc_id, contaminated, n_items, items (ids, sorted), least_edits (null without a match)."""
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    kind = "array<struct<item:long,edits:int>>"
    out = source.withColumn("hits", F.array().cast(kind))
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=_usable(items)) -> Iterator[pa.RecordBatch]:
            table = Filter(items, edits)
            type_ = pa.list_(pa.struct([("item", pa.int64()), ("edits", pa.int32())]))
            for b in batches:
                found = table.matches([folded(t.as_py()) for t in b.column(1)])
                hits = [(old or []) + [{"item": table.ids[i], "edits": d} for i, d in m.items()] for old, m in zip(b.column(2).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, type_)], names=["doc_id", "text", "hits"])

        out = out.mapInArrow(run, f"doc_id long, text string, hits {kind}")
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(items).alias("n_items"), items.alias("items"), F.array_min(F.transform("hits", lambda h: h["edits"])).alias("least_edits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents of ``docs`` that hold no benchmark item, with their columns."""
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=_usable(items)) -> Iterator[pa.RecordBatch]:
            table = Filter(items, edits)
            for b in batches:
                found = table.matches([folded(t.as_py()) for t in b.column(b.schema.get_field_index("text"))])
                yield b.filter(pa.array([not m for m in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
