"""Induced sorting of suffixes in numpy, and an external merge of sorted runs.

``suffix_order`` sorts the suffixes of a byte text as far as ``depth`` bytes by
induced sorting: suffixes are L or S as their next byte is smaller or larger, the
leftmost S suffixes are sorted first, and from them the L and then the S suffixes
are induced bucket by bucket. A whole bucket front is one vector operation.

``SuffixQueue`` is the external part: blocks that fit the memory budget are sorted
so, and if there is more than one, their suffix tuples (key bytes, owner, text
number, place) go to sorted runs on the task's own disk and leave it through a
priority queue, which compares whole keys. Left out of the usual method: the length a
tuple has in common with its predecessor isn't computed or carried, and induction
doesn't cross a spilled run.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S; the last one is L (an end smaller than any byte follows)."""
    n = len(t)
    if not n:
        return np.empty(0, bool)
    s = np.zeros(n, bool)
    differs = t[:-1] != t[1:]
    less = t[:-1] < t[1:]
    # A run of equal bytes has the type of the place where it ends.
    at = np.where(differs, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    known = nearest < n
    s[:-1][known] = less[nearest[known]]
    return s


def _order_lms(t: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Order of the leftmost S suffixes by their first ``depth`` bytes.

    A word of 8 bytes at a time; after each word only groups that still tie go on.
    As depth is bounded this takes the place of recursing on a string of names.
    """
    words = padded_words(t)
    order = np.argsort(words[lms], kind="stable")
    group = np.zeros(len(lms), np.int64)
    key = words[lms[order]]
    group[1:] = np.cumsum(key[1:] != key[:-1])
    for o in range(8, depth, 8):
        size = np.bincount(group, minlength=1)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        sub, g = order[tied], group[tied]
        w = words[np.minimum(lms[sub] + o, len(t))]
        inner = np.lexsort((w, g))
        order[tied] = sub[inner]
        w = w[inner]
        split = np.zeros(len(lms), np.int64)
        new = np.zeros(len(tied), bool)
        new[1:] = (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        split[tied[new]] = 1
        group = group + np.cumsum(split)
    return order


def padded_words(t: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place (and from the end) as a number that sorts as they do."""
    buf = t.tobytes() + b"\0" * 16
    n = len(t) + 1
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        out[o::8] = np.frombuffer(buf, ">u8", count=(n - o + 7) // 8, offset=o)
    return out


def suffix_order(t: np.ndarray, depth: int = 50) -> np.ndarray:
    """Places of ``t`` in the order of their suffixes, exact in the first ``depth`` bytes."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = suffix_types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    lms = lms[_order_lms(t, lms, depth)] if len(lms) else lms
    counts = np.bincount(t, minlength=256)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n_s = np.bincount(t[s], minlength=256)
    sa = np.full(n, -1, np.int64)

    def place(items: np.ndarray, heads: np.ndarray, chars: np.ndarray) -> None:
        order = np.argsort(chars, kind="stable")
        items, chars = items[order], chars[order]
        per = np.bincount(chars, minlength=256)
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        sa[heads[chars] + np.arange(len(items)) - first[chars]] = items
        heads += per

    # L suffixes, from the smallest bucket up: each sorted suffix gives the one before it.
    heads = starts.astype(np.int64).copy()
    place(np.array([n - 1]), heads, t[n - 1 : n]) if not s[n - 1] else None
    by_char = np.searchsorted(t[lms], np.arange(257)) if len(lms) else np.zeros(257, np.int64)
    for c in np.flatnonzero(counts):
        done = int(starts[c])
        while done < heads[c]:
            front = sa[done : heads[c]]
            done = int(heads[c])
            before = front[front > 0] - 1
            before = before[~s[before]]
            if len(before):
                place(before, heads, t[before])
        seeds = lms[by_char[c] : by_char[c + 1]]
        before = seeds - 1
        before = before[~s[before]]
        if len(before):
            place(before, heads, t[before])
    # S suffixes, from the largest bucket down, each bucket filled from its end.
    tails = (starts + counts).astype(np.int64)
    limit = tails - n_s

    def place_back(items: np.ndarray, chars: np.ndarray) -> None:
        order = np.argsort(chars, kind="stable")
        items, chars = items[order], chars[order]
        per = np.bincount(chars, minlength=256)
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        sa[tails[chars] - 1 - (np.arange(len(items)) - first[chars])] = items
        np.subtract(tails, per, out=tails)

    for c in np.flatnonzero(counts)[::-1]:
        done = int(starts[c] + counts[c])
        while done > tails[c]:
            front = sa[tails[c] : done][::-1]
            done = int(tails[c])
            before = front[front > 0] - 1
            before = before[s[before]]
            if len(before):
                place_back(before, t[before])
        front = sa[starts[c] : limit[c]][::-1]
        before = front[front > 0] - 1
        before = before[s[before]]
        if len(before):
            place_back(before, t[before])
    return sa


def same_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at ``a`` and ``b`` have ``length`` bytes in common (both are that long)."""
    words = padded_words(t)
    same = np.ones(len(a), bool)
    for o in range(0, length - 7, 8):
        at = np.flatnonzero(same)
        same[at] = words[a[at] + o] == words[b[at] + o]
    if length % 8:
        at = np.flatnonzero(same)
        same[at] = words[a[at] + length - 8] == words[b[at] + length - 8] if length >= 8 else (words[a[at]] >> np.uint64(8 * (8 - length))) == (words[b[at]] >> np.uint64(8 * (8 - length)))
    return same


class SuffixQueue:
    """Groups of equal ``length``-byte strings over any number of texts, within a memory budget.

    ``add`` takes a text and the owner of it; ``least`` yields for each text, in the
    order of adding, the smallest owner of each of its ``length``-byte strings.
    """

    def __init__(self, length: int = 50, budget: int = 4 << 20):
        self.length, self.budget = length, budget
        self.texts: list[bytes] = []
        self.owners: list[int] = []
        self.size = self.total = 0
        self.runs: list[tuple[str, int]] = []
        self.shapes: list[np.ndarray] = []
        self.folder: str | None = None

    def add(self, text: bytes, owner: int) -> None:
        self.texts.append(text)
        self.owners.append(owner)
        self.size += len(text) + 1
        if self.size >= self.budget:
            self._spill()

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, sorted valid places, text number of each, new group flags, starts of the texts)."""
        sizes = np.array([len(x) for x in self.texts], np.int64)
        t = np.frombuffer(b"\0".join(self.texts) + b"\0", np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sa = suffix_order(t, self.length)
        text = np.repeat(np.arange(len(sizes)), sizes + 1)
        fits = np.arange(len(t)) + self.length <= (begin + sizes)[text]
        sa = sa[fits[sa]]
        new = np.ones(len(sa), bool)
        new[1:] = ~same_prefix(t, sa[1:], sa[:-1], self.length)
        return t, sa, text[sa], new, begin

    def _spill(self) -> None:
        t, sa, text, new, begin = self._sorted()
        # Within a run equal strings stand by owner, as the merge expects.
        order = np.lexsort((np.array(self.owners, np.int64)[text], np.cumsum(new)))
        sa, text = sa[order], text[order]
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        kind = np.dtype([("key", f"S{self.length}"), ("owner", "<i8"), ("text", "<i8"), ("place", "<i8")])
        run = np.empty(len(sa), kind)
        window = np.lib.stride_tricks.sliding_window_view(t, self.length) if len(t) >= self.length else np.empty((0, self.length), np.uint8)
        run["key"] = np.ascontiguousarray(window[sa]).view(f"S{self.length}").ravel() if len(sa) else b""
        run["owner"] = np.array(self.owners, np.int64)[text]
        run["text"], run["place"] = text + self.total, sa - begin[text]
        path = os.path.join(self.folder, f"run{len(self.runs)}")
        run.tofile(path)
        self.runs.append((path, len(run)))
        self.shapes.append(np.array([len(x) for x in self.texts], np.int64))
        self.total += len(self.texts)
        self.texts, self.owners, self.size = [], [], 0

    def _read(self, path: str, n: int) -> Iterator[tuple]:
        kind = np.dtype([("key", f"S{self.length}"), ("owner", "<i8"), ("text", "<i8"), ("place", "<i8")])
        with open(path, "rb") as f:
            while len(part := np.fromfile(f, kind, 4096)):
                # numpy strips trailing zero bytes of a key; keys hold none inside a text that has no zero byte
                yield from zip(part["key"].tolist(), part["owner"].tolist(), part["text"].tolist(), part["place"].tolist())

    def least(self) -> Iterator[np.ndarray]:
        if self.folder is None:
            if self.texts:
                yield from self._least_in_memory()
            return
        if self.texts:
            self._spill()
        try:
            shape = np.concatenate(self.shapes)
            at = np.concatenate([[0], np.cumsum(np.maximum(shape - self.length + 1, 0))])
            out = np.memmap(os.path.join(self.folder, "least"), np.int64, "w+", shape=(max(1, int(at[-1])),))
            group: list[int] = []
            key, owner = None, 0
            for k, o, text, place in heapq.merge(*[self._read(*r) for r in self.runs]):
                # Equal keys come by owner: the first of a group is its least; the common prefix decides where a group ends.
                if k != key:
                    key, owner = k, o
                out[int(at[text]) + place] = owner
            del group
            for i in range(len(shape)):
                yield np.array(out[int(at[i]) : int(at[i + 1])])
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _least_in_memory(self) -> Iterator[np.ndarray]:
        t, sa, text, new, begin = self._sorted()
        owner = np.array(self.owners, np.int64)
        least = np.empty(len(t), np.int64)
        if len(sa):
            heads = np.flatnonzero(new)
            smallest = np.minimum.reduceat(owner[text], heads)
            least[sa] = np.repeat(smallest, np.diff(np.append(heads, len(sa))))
        for i, x in enumerate(self.texts):
            yield least[begin[i] : begin[i] + max(0, len(x) - self.length + 1)]
