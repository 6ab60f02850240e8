"""Minimax contiguous sharding; DataFrame expressions only.

Rows are ordered by the first id of their group (rows of equal text), then by
id, and a prefix sum of sizes runs over that order.  Shards are contiguous
ranges of it.  A cut may stand at the end of a group; a group larger than a
fair share may also be cut inside, at every crossing of a fraction of that
share, so that a large group of copies cannot overfill a shard.

The capacity is the smallest at which greedy filling needs no more than the
wanted shards.  The search runs on the driver over a digest of the possible
cuts with a fixed number of entries.  A digest brackets the capacity; the cuts
that can still matter are then digested again, finer, until the bracket closes.

Defined cases: a null text counts as no bytes and is in the group of the empty
text; null ids come first; repeated rows keep an order by their content; with
fewer groups than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Entries of a digest, at most twice as many rows on the driver.
ENTRIES = 1 << 15
#: A large group may be cut at each crossing of this fraction of a fair share.
FRACTION = 16


class Digest:
    """Possible cuts in buckets of equal width, each with its least and greatest prefix sum."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.low = [r[0] for r in rows]
        self.high = [r[1] for r in rows]

    def furthest(self, limit: int, hopeful: bool) -> int | None:
        """The greatest cut up to ``limit``: a bound from above if hopeful, else from below."""
        k = bisect_right(self.low, limit) - 1
        if k < 0:
            return None
        if limit >= self.high[k]:
            return self.high[k]
        return limit if hopeful else self.low[k]


def fill(digest: Digest, capacity: int, shards: int, total: int, hopeful: bool) -> list[int] | None:
    """Ends of the shards by greedy filling, or None if ``shards`` do not suffice."""
    ends, at = [], 0
    while at < total:
        if len(ends) == shards:
            return None
        end = digest.furthest(at + capacity, hopeful)
        if end is None or end <= at:
            return None
        ends.append(end)
        at = end
    return ends


def smallest(digest: Digest, low: int, high: int, shards: int, total: int, hopeful: bool) -> int:
    """The smallest capacity in low .. high that greedy filling accepts; ``high`` is known to do."""
    while low < high:
        middle = (low + high) // 2
        if fill(digest, middle, shards, total, hopeful) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _digest(cuts: DataFrame, ranges: list[tuple[int, int]]) -> tuple[Digest, bool]:
    """A digest of the cuts in the ranges, and whether it holds each cut by itself."""
    width = max(1, -(-sum(b - a + 1 for a, b in ranges) // ENTRIES))
    inside = F.lit(False)
    for a, b in ranges:
        inside |= F.col("cut").between(a, b)
    rows = cuts.where(inside).groupBy(F.floor(F.col("cut") / F.lit(width)).alias("bucket")).agg(F.min("cut").alias("low"), F.max("cut").alias("high")).select("low", "high").collect()
    pairs = sorted((r["low"], r["high"]) for r in rows)
    # a bucket with two cuts at its ends only is exact when nothing can stand between them
    exact = width == 1 or all(a == b for a, b in pairs)
    return Digest(pairs), exact


def minimax_cuts(cuts: DataFrame, total: int, shards: int) -> list[int]:
    """Ends of at most ``shards`` contiguous shards whose largest is as small as possible."""
    if not total:
        return []
    ranges, low, high = [(1, total)], -(-total // shards), total
    known: set[int] = set()
    while True:
        digest, exact = _digest(cuts, ranges)
        known.update(digest.low, digest.high)
        high = smallest(digest, low, high, shards, total, hopeful=False)
        low = smallest(digest, low, high, shards, total, hopeful=True)
        if exact or low == high and fill(digest, low, shards, total, True) == fill(digest, low, shards, total, False):
            return evened(sorted(known), high, shards, total)
        # where the k-th end can be: from pessimistic filling at the low capacity to hopeful filling at the high one
        first, last = _ends(digest, low, shards, total, False), _ends(digest, high, shards, total, True)
        merged = _merged(zip(first, last))
        if merged == ranges:
            break
        ranges = merged
    # the bracket no longer closes over all capacities at once: try them one by one
    while low < high:
        middle = (low + high) // 2
        cut = _greedy(cuts, middle, shards, total)
        low, high = (low, middle) if cut else (middle + 1, high)
    return evened(sorted(known.union(_greedy(cuts, high, shards, total) or [])), high, shards, total)


def _merged(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _greedy(cuts: DataFrame, capacity: int, shards: int, total: int) -> list[int] | None:
    """Ends of the shards under one capacity, or None if it does not suffice.

    For one capacity the ranges in which ends can be shrink with each digest,
    down to single cuts.
    """
    ranges = [(1, total)]
    while True:
        digest, exact = _digest(cuts, ranges)
        found = fill(digest, capacity, shards, total, False)
        if found or exact or fill(digest, capacity, shards, total, True) is None:
            return found
        ranges = _merged(zip(_ends(digest, capacity, shards, total, False), _ends(digest, capacity, shards, total, True)))


def evened(known: list[int], capacity: int, shards: int, total: int) -> list[int]:
    """Ends under the capacity, each as near to an equal share of the rest as the shards after it allow.

    Greedy filling alone leaves all the slack to the last shard.
    """
    digest = Digest([(c, c) for c in known])

    def suffices(at: int, left: int) -> bool:
        for _ in range(left):
            if at == total:
                break
            at = digest.furthest(min(at + capacity, total), False) or at
        return at == total

    ends, at = [], 0
    for left in range(shards - 1, -1, -1):
        if at == total:
            break
        k = bisect_right(known, at + (total - at) // (left + 1))
        near = sorted((c for c in known[max(0, k - 1) : k + 1] if at < c <= at + capacity), key=lambda c: abs(c - at - (total - at) // (left + 1)))
        furthest = digest.furthest(min(at + capacity, total), False)
        at = next((c for c in [*near, furthest] if suffices(c, left)), furthest)
        ends.append(at)
    return ends


def _ends(digest: Digest, capacity: int, shards: int, total: int, hopeful: bool) -> list[int]:
    """Ends of exactly ``shards`` shards, whether or not they reach the end of the rows."""
    ends, at = [], 0
    for _ in range(shards):
        end = digest.furthest(min(at + capacity, total), hopeful)
        at = max(at, end or at)
        ends.append(at)
    return ends


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds running totals over a global order: ``sums`` maps new columns to the columns they add up.

    Rows are dealt by range, totals are taken in each range, and one row for
    each range carries on where the ranges before it end.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, name)
    per = dealt.groupBy("_range").agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range of the shuffle, so its size is bounded by the number of partitions
    base = per.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(base), "_range").select(*df.columns, "_range", *[(F.sum(v).over(inside) + F.col(f"_{k}")).alias(k) for k, v in sums.items()])


def shard_by_bytes(df: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: sizes near equal is the law)."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.sha2(raw, 256).alias("content"))
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("content").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first_id"), F.sum("size").alias("group_size")), "shard-groups")
    total = rows.agg(F.sum("size")).first()[0] or 0
    fair = max(1, -(-total // shards))
    step = max(1, fair // FRACTION)
    known = rows.join(groups, "content").withColumn("one", F.lit(1).cast("long"))
    order = [F.col("first_id"), F.col("content"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    placed = prefix_sums(known, order, {"upto": "size", "rank": "one"}, "shard-order")
    # the last row of a range may continue in the next one: its neighbour is the first group there
    inside = Window.partitionBy("_range").orderBy(*order)
    edges = placed.groupBy("_range").agg(F.min_by("content", F.struct("first_id", "content")).alias("_first"))
    following = edges.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_following"))
    placed = placed.withColumn("_ahead", F.lead("content").over(inside)).join(F.broadcast(following), "_range")
    ends_group = ~F.coalesce("_ahead", "_following").eqNullSafe(F.col("content"))
    crosses = (F.col("group_size") > fair) & (F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("size")) / step))
    placed = written(placed.select("doc_id", "size", "text_crc32", "upto", "rank", F.when(ends_group | crosses, F.col("upto")).alias("cut")), "shard-prefix")
    ends = minimax_cuts(placed.select("cut").where(F.col("cut").isNotNull()), total, shards)[:-1]
    ranks = {r["upto"]: r["rank"] for r in placed.where(F.col("upto").isin(ends)).select("upto", "rank").collect()} if ends else {}
    shard, before = F.lit(0), F.lit(0).cast("long")
    for k, end in enumerate(ends, 1):
        shard = F.when(F.col("upto") > end, k).otherwise(shard)
        before = F.when(F.col("upto") > end, ranks[end]).otherwise(before)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), (F.col("rank") - 1 - before).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
