"""Shards of near equal size by minimax contiguous partition (operator 10), with DataFrame functions only.

Equal texts form an atomic group. Groups are ordered by the digest of their text; the smallest capacity for which
cutting greedily along that order needs no more shards than asked for is found by binary search, and the shards are
cut there. A group of at least a fair share gets a shard of its own first; the rest is dealt to the remaining shards.

The search sees sums of stretches of the order, not groups: at first up to 65,536 of them (4 hex digits of the
digest), then only stretches in which some cut may fall are split further (by two digits each), until every cut is
known to the group. What the driver holds is bounded by that, whatever the number of groups. Since the order is that of
digests, a shard is a range of digests, and documents are dealt by comparing with the cuts, without a join.

Slots count documents inside a shard by stretch; a stretch with many documents is split by a hash of the id, so that
no task sorts a shard or a large group.

Defined cases: a null text is empty; fewer groups than shards leave shards empty; repeated rows get slots of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

SHARDS = 16
_PREFIX = 4
_STEP = 2
_PARTS = 4096


class Stretch(NamedTuple):
    """Neighbouring groups: first digits of their digests, bytes, number of groups."""

    prefix: str
    size: int
    groups: int


def _sums(groups: DataFrame, digits: int | Column) -> DataFrame:
    prefix = F.col("digest").substr(F.lit(1), digits if isinstance(digits, Column) else F.lit(digits))
    return groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("groups"))


def _collected(sums: DataFrame) -> list[Stretch]:
    return [Stretch(r["prefix"], r["size"], r["groups"]) for r in sums.collect()]


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indices of the first item of each further shard, or None if the items do not fit. `ends`: running sums."""
    cuts, at = [], 0
    for k in range(shards):
        base = ends[at - 1] if at else 0
        stop = bisect_right(ends, base + capacity, at)
        if stop == len(ends):
            return cuts
        if stop == at or k == shards - 1:
            return None
        cuts.append(stop)
        at = stop
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _undecided(items: list[Stretch], shards: int, largest: int) -> list[str]:
    """Stretches of several groups in which a cut may fall."""
    sizes = [x.size for x in items]
    ends = list(accumulate(sizes))
    least, most = max(largest, -(-ends[-1] // shards)), smallest_capacity(sizes, shards)
    low = high = 0
    out: dict[str, None] = {}
    for _ in range(shards - 1):
        first = bisect_right(ends, low + least)
        low = ends[first - 1] if first else 0
        high = min(high + most, ends[-1])
        for x in items[first : bisect_right(ends, high) + 1]:
            if x.groups > 1:
                out[x.prefix] = None
    return list(out)


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digests (or first digits) at which the second and later shards begin."""
    largest = groups.agg(F.max("size")).head()[0]
    if largest is None or shards < 2:
        return []
    items = sorted(_collected(_sums(groups, _PREFIX)))
    while True:
        split = _undecided(items, shards, largest)
        if not split:
            break
        by_length: dict[int, list[str]] = {}
        for prefix in split:
            by_length.setdefault(len(prefix), []).append(prefix)
        finer = []
        for length, prefixes in by_length.items():
            inside = groups.where(F.col("digest").substr(1, length).isin(prefixes))
            finer += _collected(_sums(inside, length + _STEP))
        gone = set(split)
        items = sorted([x for x in items if x.prefix not in gone] + finer)
    sizes = [x.size for x in items]
    cuts = greedy_cuts(list(accumulate(sizes)), smallest_capacity(sizes, shards), shards)
    return [items[k].prefix for k in cuts]


def large_groups(groups: DataFrame, shards: int) -> list[str]:
    """Digests of groups of at least a fair share of what is left, largest first; fewer than `shards`."""
    alone: list[str] = []
    while len(alone) < shards - 1:
        rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
        total = rest.agg(F.sum("size")).head()[0] or 0
        fair = total / (shards - len(alone))
        found = rest.where((F.col("size") >= F.lit(fair)) & (F.col("size") < F.lit(total)))
        found = found.orderBy(F.desc("size"), "digest").limit(shards - 1 - len(alone)).collect()
        if not found:
            break
        alone += [r["digest"] for r in found]
    return alone


def shard_of(alone: list[str], cuts: list[str]) -> Column:
    digest = F.col("digest")
    by_range = F.lit(len(alone))
    for cut in cuts:
        by_range = by_range + (digest >= cut).cast("int")
    out = by_range
    for k, one in enumerate(alone):
        out = F.when(digest == one, F.lit(k)).otherwise(out)
    return out.cast("int")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text).alias("digest"),
    )
    rows = stored(rows, "shard_rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.sort("digest"), "shard_groups")
    alone = large_groups(groups, shards)
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    rows = rows.withColumn("shard", shard_of(alone, minimax_cuts(rest, shards - len(alone))))

    block = F.conv(F.substring("digest", 1, _PREFIX), 16, 10).cast("int")
    counts = groups.groupBy(block.alias("block")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).head()[0] or 0
    crowd = -(-total // _PARTS)
    crowded = counts.where(F.col("n") > max(1, crowd)).select("block").collect()  # fewer than _PARTS
    part = F.when(F.col("block").isin([r["block"] for r in crowded]), F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
    rows = rows.withColumn("block", block).withColumn("part", F.coalesce(part, F.lit(0)).cast("int"))
    chunk = ["shard", "block", "part"]
    sizes = rows.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy(*chunk).orderBy("doc_id", "digest"))
    return (
        rows.withColumn("_at", inside)
        .join(starts, chunk)
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"))
    )
