"""Suffix-array dedup: bytes covered by a string of an earlier document go.

Every byte is removed that lies in a ``LENGTH``-byte string which also starts in a
document with a smaller doc_id; strings are judged on the input.

Method: suffixes are sorted by external induced sorting (``induced.py``). One
suffix array of the corpus would be one shard; equal strings need only meet, so
the suffixes are dealt into shards by the smallest hash among their 24-byte
grams, which equal strings share. Neighbouring suffixes with one such hash stay
together as one stretch of text, so a shard's texts are short pieces.

1. A pass over the texts gives the hashes of each document's stretches. Those that
   occur in one document only are of no account. The others set the bits of a
   filter of at most ``FILTER_BITS`` bits, whatever the size of the corpus. It only
   spares work: stretches that it lets through wrongly are sorted for nothing, and
   once it is full all are, with the same result.
2. Stretches that pass are reduced to distinct ones with their least owner in each
   task before the shuffle, so a passage in a third of all documents is a few rows
   a task. They are dealt to shards, and each shard is sorted. A shard larger than the
   memory budget goes to disk in sorted runs of suffix tuples, merged by a
   priority queue. For each string of a stretch that gives the least owner.
3. The least owners are joined back to the stretches' occurrences, by a join that
   Spark splits where it is skewed, and become spans of each document.

Edge cases: null and empty texts have no bytes and keep the digest of nothing; a
null doc_id is compared with none: its text stays and removes nothing; rows that
repeat a doc_id don't remove each other's text; an empty table gives an empty
result; further columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import erase, pick, stored, text_or_empty
from .induced import SuffixQueue
from .shingles import mix

LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
#: Most suffixes of one stretch.
STRETCH = 64
FILTER_BITS = 1 << 29
#: Bytes of text that one bucket of hashes stands for, and most buckets.
BUCKET, MOST_BUCKETS = 32 << 20, 1 << 20
#: Hashes that a task holds before it sends them on.
HELD_HASHES = 1_500_000
#: Bytes of text hashed at once (few, so that they stay in the processor's cache), and bytes of a shard sorted at once.
CHUNK, SHARD = 256 << 10, 3 << 20
#: Distinct stretches that a task holds before it sends them on.
HELD = 400_000


def _grams(buf: bytes, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        out[o::8] = np.frombuffer(buf, "<u8", count=(n - o + 7) // 8, offset=o)
    return out


def _least(h: np.ndarray) -> np.ndarray:
    """Smallest of each WIDTH neighbours, from minima of 2, 4, 8 and 16."""
    width = 1
    while width * 2 <= WIDTH:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (WIDTH - width)], h[WIDTH - width :])


def stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first suffix, suffixes, hash) of all stretches, chunk by chunk of text."""
    first, n = 0, len(texts)
    while first < n:
        end, size = first, 0
        while end < n and (end == first or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        if end == first + 1 and len(texts[first]) > 2 * CHUNK:
            # A very long text: pieces overlap by a string less one byte, so each suffix is in one piece.
            for s in range(0, len(texts[first]), CHUNK):
                for i, at, k, h in _stretches([texts[first][s : s + CHUNK + LENGTH - 1]]):
                    yield i + first, at + s, k, h
        else:
            for i, at, k, h in _stretches(texts[first:end]):
                yield i + first, at, k, h
        first = end


def _stretches(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    sizes = np.array([len(t) for t in texts], np.int64)
    total = int(sizes.sum())
    n = total - LENGTH + 1
    if n <= 0:
        return
    buf = b"".join(texts) + b"\0" * 16
    g = _grams(buf, total)
    k = total - GRAM + 1
    h = g[:k] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for o in range(8, GRAM, 8):
        h = (h + g[o : o + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(31)
    h = mix(h)
    least = _least(h)
    # Only suffixes of LENGTH bytes inside their own text count: stretches end where those of a text begin or end.
    ends = np.cumsum(sizes)
    begins = ends - sizes
    count = np.maximum(sizes - LENGTH + 1, 0)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    for edge in (begins, begins + count):
        new[edge[edge < n]] = True
    at = np.flatnonzero(new)
    k = np.diff(np.append(at, n))
    if (k > STRETCH).any():
        # Only a text that repeats itself has such a stretch; it is cut from where it begins, so that copies are cut alike.
        parts = -(-k // STRETCH)
        inner = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(at + k, parts)
        at = np.repeat(at, parts) + inner * STRETCH
        k = np.minimum(STRETCH, end - at)
    owner = np.searchsorted(ends, at, "right")
    place = at - begins[owner]
    ok = place < count[owner]
    # Minima are small numbers; mixed once more they are spread evenly over the buckets.
    yield owner[ok], place[ok], k[ok], mix(least[at[ok]])


def _slots(h: np.ndarray, buckets: int, bits: int) -> list[np.ndarray]:
    """Two places of each hash in its bucket's slice of the filter."""
    slice_ = bits // buckets
    first = _bucket(h, buckets) * slice_
    return [first + (mix(h + np.uint64(k)) & np.uint64(slice_ - 1)).astype(np.int64) for k in (1, 2)]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def _packed(h: np.ndarray) -> bytes:
    """Sorted hashes, byte plane by byte plane: the upper planes hardly change and compress."""
    return h.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _filter(source: DataFrame, bits_limit: int) -> tuple[bytes, int, int]:
    """The filter of hashes that more than one document has, its buckets and its bits.

    A task sends its distinct hashes on as sorted blocks, one a bucket; buckets are
    ranges of hashes, as many as the texts' bytes ask for.
    """
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(64, 1 << (int(size) // BUCKET).bit_length()))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, n = [], [], 0

        def flush() -> pa.RecordBatch:
            h, d = np.concatenate(held), np.concatenate(ids)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
            h = h[at]
            edge = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            rows = [(k, _packed(part[~many]), _packed(part[many])) for k in np.flatnonzero(np.diff(edge)).tolist() for part, many in [(h[edge[k] : edge[k + 1]], several[edge[k] : edge[k + 1]])]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "one", "many"])

        for b in batches:
            own = np.asarray(b.column(0))
            for i, _, _, h in stretches(_bytes(b.column(2))):
                held.append(h)
                ids.append(own[i])
                n += len(h)
                if n >= HELD_HASHES:
                    yield flush()
                    held, ids, n = [], [], 0
        if n:
            yield flush()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of several documents in one block, or in several blocks. One document in two blocks only costs needless sorting."""
        bucket, one, many = None, [], []

        def shared() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(one), return_counts=True)
            h = np.union1d(h[n > 1], np.concatenate(many))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([h.tobytes()], pa.binary())], names=["bucket", "hashes"])

        for b in batches:
            for k, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bucket is not None and k != bucket:
                    yield shared()
                    one, many = [], []
                bucket = k
                x, y = _unpacked(x), _unpacked(y)
                one += [x, y]
                many.append(y)
        if bucket is not None:
            yield shared()

    blocks = source.mapInArrow(hashes, "bucket int, one binary, many binary").repartition("bucket").sortWithinPartitions("bucket")
    shared, path = stored(blocks.mapInArrow(together, "bucket int, hashes binary"))
    n = (shared.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 8
    bits = max(8 * buckets, min(bits_limit, 1 << max(1, 12 * n).bit_length()))
    slice_ = bits // buckets

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                set_ = np.zeros(slice_, bool)
                for s in _slots(np.frombuffer(x, np.uint64), buckets, bits):
                    set_[s - k * slice_] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(set_, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    out = bytearray(bits // 8)
    for r in shared.mapInArrow(slices, "bucket int, bits binary").toLocalIterator():
        out[r["bucket"] * slice_ // 8 : (r["bucket"] + 1) * slice_ // 8] = r["bits"]
    erase(source.sparkSession, path)
    return bytes(out), buckets, bits


def spans(docs: DataFrame, bits_limit: int = FILTER_BITS, shard: int = SHARD) -> DataFrame:
    """(doc_id, tie, list): for each document with something to remove, its covered byte ranges, unmerged."""
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), text_or_empty().alias("text")).where(f"doc_id IS NOT NULL AND octet_length(text) >= {LENGTH}")
    filled, buckets, bits = _filter(source, bits_limit)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def passing(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        table = np.frombuffer(shared.value, np.uint8)
        for i, at, k, h in stretches(texts):
            ok = np.ones(len(h), bool)
            for s in _slots(h, buckets, bits):
                ok &= (table[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
            yield i[ok], at[ok], k[ok], h[ok]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that pass, each once for as many documents as the task can hold together."""
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            h, low, high = zip(*seen.values()) if seen else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(seen.keys(), pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["h", "piece", "low", "high"])
            seen.clear()
            return out

        for b in batches:
            ids, texts = np.asarray(b.column(0)).tolist(), _bytes(b.column(2))
            for i, at, k, h in passing(texts):
                for x, s, e, key in zip(i.tolist(), at.tolist(), (at + k + (LENGTH - 1)).tolist(), h.view(np.int64).tolist()):
                    piece, d = texts[x][s:e], ids[x]
                    was = seen.get(piece)
                    if was is None:
                        seen[piece] = [key, d, d]
                    elif d < was[1]:
                        was[1] = d
                    elif d > was[2]:
                        was[2] = d
                if len(seen) > HELD:
                    yield flush()
        if seen:
            yield flush()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ties, texts = np.asarray(b.column(0)), np.asarray(b.column(1)), _bytes(b.column(2))
            for i, at, k, h in passing(texts):
                digest = np.array([xxhash.xxh3_64_intdigest(texts[x][s : s + c + LENGTH - 1]) for x, s, c in zip(i.tolist(), at.tolist(), k.tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ids[i]), pa.array(ties[i]), pa.array(at)], names=["h", "digest", "doc_id", "tie", "at"])

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by hash; whole hashes are sorted together until the budget is reached."""
        queue, keys, last = SuffixQueue(LENGTH, shard), [], None

        def flush() -> Iterator[pa.RecordBatch]:
            h, digest, runs = [], [], []
            for (key, dig, low, high), least in zip(keys, queue.least()):
                if low == high and not (least < low).any():
                    continue
                edge = np.flatnonzero(np.diff(least)) + 1
                off = [0, *edge.tolist()]
                h.append(key)
                digest.append(dig)
                runs.append([{"off": o, "n": e - o, "first": int(least[o])} for o, e in zip(off, [*off[1:], len(least)])])
                if len(h) >= 20_000:
                    yield batch(h, digest, runs)
                    h, digest, runs = [], [], []
            if h:
                yield batch(h, digest, runs)

        def batch(h: list, digest: list, runs: list) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("off", pa.int32()), ("n", pa.int32()), ("first", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.int64()), pa.array(runs, kind)], names=["h", "digest", "runs"])

        held, now = 0, None

        def take(key: int, piece: bytes, low: int, high: int) -> None:
            queue.add(piece, low)
            digest = xxhash.xxh3_64_intdigest(piece)
            keys.append((key, digest - (1 << 64) if digest >> 63 else digest, low, high))

        for b in batches:
            for key, piece, low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                # Equal stretches of different tasks follow each other and become one.
                if now and now[0] == key and now[1] == piece:
                    now = (key, piece, min(low, now[2]), max(high, now[3]))
                    continue
                if now:
                    take(*now)
                now = (key, piece, low, high)
                if key != last and held >= shard * 3 // 4:
                    yield from flush()
                    queue, keys, held = SuffixQueue(LENGTH, shard), [], 0
                last = key
                held += len(piece) + 1
        if now:
            take(*now)
        yield from flush()

    dealt = source.mapInArrow(pieces, "h long, piece binary, low long, high long").repartition("h").sortWithinPartitions("h", "piece")
    # Each table's shuffle files go when it is written, so no two phases' files lie on the disks together.
    least, path = stored(dealt.mapInArrow(sort_shards, "h long, digest long, runs array<struct<off:int,n:int,first:long>>"))
    at = source.mapInArrow(places, "h long, digest long, doc_id long, tie long, at long")
    runs = at.join(least, ["h", "digest"]).select("doc_id", "tie", "at", F.explode("runs").alias("r")).where("r.first < doc_id")
    span = F.struct((F.col("at") + F.col("r.off")).alias("start"), (F.col("at") + F.col("r.off") + F.col("r.n") - 1 + LENGTH).alias("end"))
    found, _ = stored(runs.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_list(span)).alias("list")))
    erase(docs.sparkSession, path)
    return found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges of sorted ones that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in ranges:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def dedup_substrings(docs: DataFrame, bits_limit: int = FILTER_BITS, shard: int = SHARD) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start, end), kept (bytes left)."""
    found = spans(docs, bits_limit, shard).select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "list")
    source = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tie"))
    joined = source.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("tie") == F.col("__tie")), "left").select("doc_id", "text", "list")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, removed, kept, digest = [], [], [], [], []
            for text, list_ in zip(_bytes(b.column(1)), b.column(2).to_pylist()):
                ranges = merged([(r["start"], r["end"]) for r in list_ or ()])
                left = text
                if ranges:
                    edges = [0, *[x for r in ranges for x in r], len(text)]
                    left = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                size.append(len(text))
                gone.append(len(text) - len(left))
                removed.append([{"start": s, "end": e} for s, e in ranges])
                kept.append(left)
                digest.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(digest, pa.string()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"],
            )

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>, kept binary")
