"""URL filter rules by a sort-merge range join.

Method: a host is turned round (``a.example.org`` -> ``org.example.a.``), so that a
rule's host and all its subdomains are the keys with one prefix, an interval. Urls
and rules are cut into ranges of keys, sorted, and swept once; a stack holds the
rules whose interval covers the current key, nested from broad to narrow, and the
longest of them whose path fits decides.

A url's sort key ends in its path and page_id, so a host with a third of all pages
is cut into as many ranges as its share asks for; a rule goes to every range that
its interval meets. Range ends come from a bounded sample of keys (``SAMPLE``);
they decide only where work is done.

Edge cases: null urls and urls without ``://`` have an empty host and path and no
rule; null page_ids and repeated rows keep a row each; an empty table gives an
empty result; further columns are ignored. Of rules equally long the first in
order of spelling wins.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

SAMPLE = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: str = "url") -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def turned(host: str) -> str:
    """Labels from the last to the first, each closed by a byte that sorts before any other."""
    return "".join(x + "\x01" for x in reversed(host.split(".")))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict (``default`` where no rule fits)."""
    spark = pages.sparkSession
    rules = sorted({Rule(*r) for r in rules}, key=lambda r: (turned(r.host), r.path, r.verdict))
    # A host's rules by path, and the lengths that their paths have, longest first: a url is looked up once a length, however many rules there are.
    hosts: dict[str, dict[str, int]] = {}
    for at, r in enumerate(rules):
        hosts.setdefault(turned(r.host), {}).setdefault(r.path, at)
    lengths = {key: sorted({len(p) for p in paths}, reverse=True) for key, paths in hosts.items()}
    source = pick(pages, "page_id", "url").select(F.col("page_id").cast("long"), host_of().alias("host"), path_of().alias("path"))
    keyed = source.withColumn("key", F.concat(F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "\x01"), F.lit("\x01"))), F.lit("\x00"), "path", F.lit("\x00"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) * 3)
    # Drawn by hash at a rate that gives about SAMPLE keys, so no task sends more than its share.
    rate = min(1.0, SAMPLE / max(1, keyed.count()))
    picked = [r[0] for r in keyed.select("key").where(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int(rate * (1 << 40))).collect()]
    picked.sort(key=lambda k: k.encode())
    ends = sorted({picked[len(picked) * i // n] for i in range(1, n)}, key=lambda k: k.encode()) if picked else []
    cuts = [e.encode() for e in ends]

    # Rules, copied to each range that their interval [key, key + 0xff) meets.
    by_range: dict[int, list[str]] = {}
    for key in hosts:
        low = key.encode()
        for part in range(bisect.bisect_right(cuts, low), bisect.bisect_left(cuts, low + b"\xff") + 1):
            by_range.setdefault(part, []).append(key)

    def longest(host: str, path: str) -> int | None:
        """The rule of a host with the longest path that the url's begins with."""
        return next((at for n in lengths[host] if n <= len(path) and (at := hosts[host].get(path[:n])) is not None), None)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = pa.array([bisect.bisect_right(cuts, k.as_py().encode()) for k in b.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, part], names=["page_id", "host", "path", "key", "part"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, nxt, stack = None, [], 0, []
        for b in batches:
            found, verdicts = [], []
            for key, path, own in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                if own != part:
                    part, waiting, nxt, stack = own, by_range.get(own, []), 0, []
                while nxt < len(waiting) and waiting[nxt].encode() <= key.encode():
                    while stack and not waiting[nxt].startswith(stack[-1]):
                        stack.pop()
                    stack.append(waiting[nxt])
                    nxt += 1
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                fits = [rules[at] for host in stack if (at := longest(host, path)) is not None]
                best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
                found.append(best and best.host + best.path)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.string()), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    sorted_ = keyed.mapInArrow(ranged, "page_id long, host string, path string, key string, part int").repartition(n, "part").sortWithinPartitions("part", F.encode("key", "UTF-8"))
    return sorted_.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
