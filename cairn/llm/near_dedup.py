"""MinHash near-duplicate detection over 5-word shingles.

Method: one-permutation hashing with optimal densification, banded buckets and
star-shaped candidate edges; links are confirmed on the full shingle sets.

1. Each text becomes a sorted set of 64-bit shingle hashes. The hash range is cut
   into ``BINS`` bins; a bin's minimum is its signature entry, and an empty bin
   borrows from the first filled bin of its own fixed random order.
2. Texts with equal sets are one class, a node with a number of its own, so a group
   of copies costs one node whatever its size.
3. ``BANDS`` bands of ``ROWS`` entries give bucket keys. A pair at similarity 0.75
   meets in at least one of 40 five-row bands with probability 0.99998.
4. In each bucket one member is the hub and every other member gets one edge to
   it. The hub is the member that meets most others over all its buckets: in a
   group of edited copies that is the original. Edges are screened by their
   signatures, confirmed on full sets, and merged into components.
5. Buckets whose members then still lie in several components are searched inside
   tasks: pairs of different components that share a bucket are screened by signature
   and compared on their sets (whole up to ``SAMPLE`` shingles, else by bottom samples
   that only rule out). Buckets that have components in common go together as one
   bundle, so a member is sent once for all its buckets; a bundle of more than ``BLOCK``
   members is dealt out by pairs of blocks, and one of more than ``MOST`` blocks bucket
   by bucket, each pair in the first band it shares. What leaves a task joins
   components, and is confirmed on full sets. So no link between bucket mates is
   lost, and groups that a star connects never emit their pairs.

Nothing is collected but counts; a hot bucket is an ordinary skewed join key. Tables
between steps lie in the shared checkpoint folder and are erased once their
successors are written, but for two narrow ones that the result is read from.

Edge cases: null or empty texts and texts without words have an empty set and link
with nothing; null doc_ids keep their row with a null component and ``kept`` false;
rows that repeat a doc_id belong together, whatever their texts; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, cut, erase, keep_ids, pick, stored, text_or_empty
from .shingles import Words, mix, shingle_set

BINS, ROWS = 200, 5
BANDS = BINS // ROWS
#: Signatures of sets this small are too coarse to screen by; such pairs go straight to the exact test.
SCREEN_FROM = 8
#: Least share of equal signature entries that passes: six standard deviations under 0.75.
SCREEN = 0.56
#: Members of a bundle or bucket that one task compares with each other, and blocks of a bundle beyond which it goes by buckets.
BLOCK, MOST = 2048, 8
#: Smaller bundles are dealt out too, by blocks of SMALL members and up to so many of them, since a search takes the square of its members.
SMALL, SPREAD = 384, 12
#: Sets up to this size go whole into the search of a bucket, larger ones by so many of their smallest hashes.
SAMPLE = 512
#: Percent by which a sampled estimate may lie under the true similarity: six standard deviations.
SLACK = 12


def bin_orders(bins: int) -> np.ndarray:
    """Row i: the fixed random order in which bin i looks for a filled bin, itself first."""
    keys = mix((np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(bins, dtype=np.uint64) + np.uint64(1))
    keys[np.arange(bins), np.arange(bins)] = 0
    return np.argsort(keys, axis=1, kind="stable").astype(np.int32)


def signature(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a sorted non-empty set, every bin filled."""
    bins = len(orders)
    edges = np.array([(i << 64) // bins for i in range(bins)], dtype=np.uint64)
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    filled = at < ends
    out = hashes[np.minimum(at, len(hashes) - 1)]
    if not filled.all():
        out = out[orders[np.arange(bins), filled[orders].argmax(axis=1)]]
    return out


def set_digest(s: np.ndarray) -> bytes:
    """20 bytes that stand for a set of hashes."""
    return mix(s * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(s + np.uint64(7))).tobytes() + len(s).to_bytes(4, "little")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, orders = Words(), bin_orders(BINS)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        n, digest, bands, sketch = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), memo)
            n.append(len(s))
            if len(s):
                sig = signature(s, orders)
                rows = mix(sig.reshape(BANDS, ROWS))
                key = salt.copy()
                for i in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
                digest.append(set_digest(s))
                bands.append(key.view(np.int64))
                sketch.append((sig & np.uint64(255)).astype(np.uint8).tobytes())
            else:
                digest.append(None)
                bands.append(None)
                sketch.append(None)
        flat = [b for b in bands if b is not None]
        offsets = np.concatenate([[0], np.cumsum([0 if b is None else BANDS for b in bands])]).astype(np.int32)
        values = pa.array(np.concatenate(flat) if flat else np.array([], np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(sketch, pa.binary())],
            names=["doc_id", "n", "digest", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Words()
    for batch in batches:
        sets = [shingle_set(t.as_py(), memo) for t in batch.column(1)]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.array([], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["low", "digest", "hashes"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
        ok = (a == b).sum(axis=1) >= SCREEN * BINS
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])


def _linked(node: np.ndarray, own: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, bands: np.ndarray, band: int | None, hashes: list[np.ndarray], mixed: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs of a group that lie in different components and are similar; of those that connect the same components, one.

    ``band`` is that of the group's bucket; None for a bundle, of whose pairs those that share any band count.

    Whole sets are compared as they are. A sample of a larger set only rules pairs
    out, so its pairs are all returned, and none of them merges components here.
    """
    flat = np.concatenate(hashes)
    values, ids = np.unique(flat.view(np.uint64), return_inverse=True)
    size = np.array([len(h) for h in hashes])
    offset = np.concatenate([[0], np.cumsum(size)[:-1]])
    whole = n <= SAMPLE
    last = np.where(whole, len(values), ids[offset + size - 1])
    label, flag, out = label.copy(), np.zeros(len(values), np.int32), []
    for k in range(len(node) - 1):
        rest = slice(k + 1, None)
        ok = (label[rest] != label[k]) & (np.minimum(n[rest], n[k]) * 100 >= np.maximum(n[rest], n[k]) * percent)
        if mixed:
            ok &= own[rest] != own[k]
        at = np.flatnonzero(ok) + k + 1
        if band is None and len(at):
            at = at[(bands[at] == bands[k]).any(axis=1)]
        elif band and len(at):
            # Two that met in an earlier band were compared there.
            at = at[~(bands[at, :band] == bands[k, :band]).any(axis=1)]
        if len(at):
            same = (sketch[at] == sketch[k]).sum(axis=1) >= SCREEN * BINS
            at = at[same | (np.minimum(n[at], n[k]) < SCREEN_FROM)]
        if not len(at):
            continue
        mine = ids[offset[k] : offset[k] + size[k]]
        starts = np.concatenate([[0], np.cumsum(size[at])[:-1]])
        theirs = ids[np.repeat(offset[at] - starts, size[at]) + np.arange(int(size[at].sum()))]
        flag[mine] = 1
        both = np.add.reduceat(flag[theirs], starts)
        flag[mine] = 0
        # Up to the smaller of the two largest sampled values both samples are complete.
        top = np.minimum(last[at], last[k])
        union = np.searchsorted(mine, top, side="right") + np.add.reduceat((theirs <= np.repeat(top, size[at])).astype(np.int64), starts) - both
        exact = whole[at] & whole[k]
        hit = both * 100 >= union * np.where(exact, percent, percent - SLACK)
        for x, sure in zip(at[hit].tolist(), exact[hit].tolist()):
            if label[x] != label[k]:
                out.append((min(int(node[x]), int(node[k])), max(int(node[x]), int(node[k]))))
                if sure:
                    label[label == label[x]] = label[k]
    return out


def _across(percent: int):
    """Searches each group of rows with one (bundled, key, i, j); rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(group).combine_chunks()
            if t.num_rows < 2:
                return
            own, node, label, n = (t.column(c).to_numpy() for c in (4, 5, 6, 7))
            sketch = np.frombuffer(b"".join(t.column(8).to_pylist()), np.uint8).reshape(-1, BINS)
            bands = t.column(9).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sets = t.column(10).combine_chunks()
            cuts = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
            flat = sets.flatten().to_numpy()
            band = None if t.column(0)[0].as_py() else int(np.argmax(bands[0] == t.column(1)[0].as_py()))
            found = _linked(node, own, label, n, sketch, bands, band, [flat[s:e] for s, e in zip(cuts, cuts[1:])], t.column(2)[0] != t.column(3)[0], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2, 3)])
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if held and tuple(key[s]) != last:
                    yield from search(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = tuple(key[s])
        if held:
            yield from search(held)

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links (sets with
    ``100 * intersection >= percent * union``), and ``kept`` says whether it is the
    document's own.
    """
    spark = docs.sparkSession
    source = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sig, sig_path = stored(source.mapInArrow(_signatures, "doc_id long, n long, digest binary, bands array<long>, sketch binary"))
    live = sig.where("n > 0 AND doc_id IS NOT NULL")
    # All but the doc_id follow from the digest, so any row's values are the class's.
    reps, reps_path = stored(live.groupBy("digest").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]).withColumn("node", F.monotonically_increasing_id()))
    owned, _ = stored(sig.select("doc_id", "n", "digest"))
    erase(spark, sig_path)
    links, paths = _links(source, reps, percent)
    # Texts that share a doc_id belong together.
    ids = owned.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest")
    several = ids.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    named = ids.join(several, "doc_id").select("doc_id", "digest").join(reps.select("digest", "node"), "digest").select("doc_id", "node")
    same = named.join(named.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    edges, edge_path = stored(links.union(same))
    label = components(edges)
    lows = reps.select("node", "low", "digest")
    member = label.join(lows, "node")
    least = member.groupBy("component").agg(F.min("low").alias("least"))
    labels, _ = stored(member.join(least, "component").select("digest", "least").unionByName(lows.join(label, "node", "left_anti").select("digest", F.col("low").alias("least"))))
    erase(spark, reps_path, edge_path, *paths)
    out = owned.join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _links(source: DataFrame, reps: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Confirmed links (a, b) of nodes that span every component, and the paths that they are read from."""
    spark = source.sparkSession
    rows = reps.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met, met_path = stored(rows.join(shared, "bucket").select("bucket", "node", "n", "size"))
    nodes = met.select("node").distinct()
    n_nodes = nodes.count()
    if not n_nodes:
        return spark.createDataFrame([], "a long, b long"), [met_path]
    density = met.groupBy("node").agg(F.sum("size").alias("density"))
    hubs = met.join(density, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct(F.col("density"), -F.col("node"))).alias("hub")).select("bucket", F.col("hub.node").alias("h"), F.col("hub.n").alias("hn"))
    close = F.least("n", "hn") * 100 >= F.greatest("n", "hn") * percent
    stars = met.join(hubs, "bucket").where((F.col("node") != F.col("h")) & close)
    stars = stars.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b")).distinct()
    profiles, profile_path = stored(keep_ids(reps.select("node", "low", "digest", "bands", "sketch"), nodes, "node", n_nodes))
    sketches = profiles.select("node", "sketch")
    stars, star_path = stored(stars.join(sketches.toDF("a", "ska"), "a").join(sketches.toDF("b", "skb"), "b").mapInArrow(_screen, "a long, b long"))
    texts = keep_ids(source.withColumnRenamed("doc_id", "low"), profiles.select("low").distinct(), "low", n_nodes)
    hashed = texts.mapInArrow(_sets, "low long, digest binary, hashes array<long>")
    wanted = profiles.select("low", "digest", "node")
    hashed = hashed.join(F.broadcast(wanted) if n_nodes * 5 <= BROADCAST_IDS else wanted.hint("merge"), ["low", "digest"])
    sets, set_path = stored(hashed.groupBy("node").agg(F.first("hashes").alias("hashes")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        met_ = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        sized = met_.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("both"), (F.size("ha") + F.size("hb")).alias("sum"))
        return sized.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")

    links, link_path = stored(confirmed(stars))
    erase(spark, star_path)
    joined = components(links)
    label = nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    # A bucket that lies in one component is settled; the others are searched for links between components.
    at = met.join(label, "node")
    open_ = at.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("bucket", "c1")
    left, left_path = stored(at.join(open_, "bucket"))
    erase(spark, met_path)
    bundle = components(left.select(F.col("component").alias("a"), F.col("c1").alias("b")).distinct()).toDF("component", "bundle")
    members = left.select("node", "n", "component").distinct().join(bundle, "component")
    of = members.groupBy("bundle").agg(F.count("*").alias("members")).withColumn("big", F.col("members") > BLOCK * MOST)
    blocks = F.greatest(F.least(F.ceil(F.col("members") / F.lit(float(SMALL))), F.lit(SPREAD)), F.ceil(F.col("members") / F.lit(float(BLOCK)))).cast("int")
    together = members.join(of.where("NOT big").withColumn("blocks", blocks), "bundle").select(F.lit(True).alias("bundled"), F.col("bundle").alias("key"), "blocks", "node", "component", "n")
    big = bundle.join(of.where("big"), "bundle").select("component")
    apart = left.join(big, "component", "left_semi").select(F.lit(False).alias("bundled"), F.col("bucket").alias("key"), F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("int").alias("blocks"), "node", "component", "n")
    profile = profiles.select("node", "sketch", "bands").join(sets.select("node", F.slice("hashes", 1, SAMPLE).alias("hashes")), "node")
    work = together.union(apart).join(profile, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # In a group of several blocks every pair of blocks is a task's work of its own.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    what = ["own", "node", "component", "n", "sketch", "bands", "hashes"]
    work = work.select("bundled", "key", other, *what).select("bundled", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *what)
    within = work.repartition("bundled", "key", "i", "j").sortWithinPartitions("bundled", "key", "i", "j").mapInArrow(_across(percent), "a long, b long").distinct()
    more, more_path = stored(within)
    erase(spark, left_path, profile_path)
    return links.union(confirmed(more)), [link_path, more_path, set_path]


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id, as one row.

    A document is a doc_id with a text (its digest): rows that repeat both are one, and
    one of them stays; texts that share a doc_id are judged each by itself, in the
    order of their digests. Rows without a doc_id stay, since nothing identifies them.
    """
    key = [F.col("doc_id").cast("long").alias("__d"), F.xxhash64(text_or_empty()).alias("__t")]
    times = cut(pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(*key).groupBy("__d", "__t").agg(F.count("*").alias("times")))
    n_docs, n_ids, most = times.agg(F.count("*"), F.countDistinct("__d"), F.max("times")).first()
    keyed = docs.withColumns(dict(zip(("__d", "__t"), key)))
    if n_docs == n_ids:
        gone = near_duplicates(docs, percent).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("__d")).distinct()
        on = ["__d"]
    else:
        # Some ids hold several texts: each document gets a number of its own, in the order of the ids.
        nodes = cut(times.orderBy("__d", "__t").select("__d", "__t", F.monotonically_increasing_id().alias("node")))
        texts = cut(keyed.join(F.broadcast(nodes) if n_docs <= BROADCAST_IDS else nodes.hint("merge"), ["__d", "__t"]).select(F.col("node").alias("doc_id"), "text"))
        lost = near_duplicates(texts, percent).where("NOT kept").select(F.col("doc_id").alias("node")).distinct()
        gone, on = cut(nodes.join(lost, "node").select("__d", "__t")), ["__d", "__t"]
    n = gone.count()
    left = keyed.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone.hint("merge"), on, "left_anti")
    if (most or 0) > 1:
        again = times.where("times > 1").select("__d", "__t", F.lit(True).alias("__again"))
        marked = left.join(again, ["__d", "__t"], "left")
        left = marked.where("__again IS NULL").unionByName(marked.where("__again").dropDuplicates(["__d", "__t"]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
