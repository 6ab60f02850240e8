"""Closures over links, calendars, snapshots and retries, in rounds of joins.

Each round is one join of the frontier with the edges; what has been seen is a
table.  A round's result is checkpointed, so the plan does not grow with the
rounds and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shared import settled


def reachable(edges: DataFrame, start: DataFrame, root: str = "", excluded: list[str] | None = None, rounds: int = 100) -> DataFrame:
    """(url, depth) of all addresses under ``root`` that links reach from ``start`` (url), within ``rounds`` steps.

    Excluded prefixes are not entered; every address counts once, at its least depth.
    """
    inside = F.col("dst").startswith(root)
    for prefix in excluded or []:
        inside &= ~F.col("dst").startswith(prefix)
    steps = settled(edges.where(inside).select("src", "dst").distinct())
    seen = frontier = settled(start.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, rounds + 1):
        fresh = steps.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = settled(fresh.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    return seen


def calendar(years: DataFrame, months: DataFrame, records: DataFrame) -> DataFrame:
    """Records below the months below the years of a journal: three dependent tables (journal, year, month, rid)."""
    return years.join(months, ["journal", "year"]).join(records, ["journal", "year", "month"]).select("journal", "year", "month", "rid")


def from_month(records: DataFrame, first: tuple[int, int] | None) -> DataFrame:
    """Resume filter: records from a year and month on."""
    return records if first is None else records.where(F.col("year") * 12 + F.col("month") >= first[0] * 12 + first[1])


def snapshots(listings: DataFrame) -> DataFrame:
    """(url, timestamp, original) of archive listings (url, json): rows with status 200, in order.

    The first row names the columns, in any order; a row of another length is an error; ``[]`` gives nothing.
    """
    table = F.from_json("json", "array<array<string>>")
    rows = listings.withColumn("t", table).where(F.size("t") > 1).withColumn("head", F.element_at("t", 1))
    each = rows.select("url", "head", F.explode(F.slice("t", 2, 1 << 30)).alias("r"))
    cell = lambda name: F.try_element_at("r", F.nullif(F.array_position("head", F.lit(name)).cast("int"), F.lit(0)))
    sound = F.size("r") == F.size("head")
    stamp = F.when(sound, cell("timestamp")).otherwise(F.raise_error(F.concat(F.lit("ragged listing of "), F.col("url"))).cast("string"))
    return each.withColumn("timestamp", stamp).where(~sound | (cell("statuscode") == "200")).select("url", "timestamp", cell("original").alias("original")).orderBy("url", "timestamp")


def first_snapshot(found: DataFrame) -> DataFrame:
    return found.groupBy("url").agg(F.min_by(F.struct("timestamp", "original"), "timestamp").alias("s")).select("url", "s.*")


def indirect_picture(pages: DataFrame, tree: Column) -> DataFrame:
    """Pages that stand for a picture: exactly one ``img``; its address is the one to follow."""
    from palimpsest.operators import html

    found = html.elements(tree, "img")
    return pages.withColumn("follow", F.when(F.size(found) == 1, html.attr(F.element_at(found, 1), "src")))


def sources(urls: DataFrame) -> DataFrame:
    """Order in which copies are tried: each layer online, the inner before the outer, then the same from the archive."""
    from palimpsest.functions import redirects

    inner = F.reverse(redirects.columns.layers(F.col("url")))
    tries = F.concat(F.transform(inner, lambda u: F.struct(F.lit("online").alias("source"), u.alias("address"))), F.transform(inner, lambda u: F.struct(F.lit("archive").alias("source"), u.alias("address"))))
    return urls.select("url", F.posexplode(tries).alias("place", "t")).select("url", "place", "t.*")


def to_do(work: DataFrame, outputs: DataFrame, key: str, reload: bool = False) -> DataFrame:
    """Incremental run: items without an output, or all of them."""
    return work if reload else work.join(outputs.select(key), key, "left_anti")


def retries(failed: DataFrame, negative: DataFrame, skipped: DataFrame, budget: int) -> DataFrame:
    """Failed links to try again: not in the negative cache, no skipped host, at most ``budget`` for each host, oldest first."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#:]*)", 1))
    rows = failed.withColumn("host", host).join(negative.select("url"), "url", "left_anti").join(skipped.select("host"), "host", "left_anti")
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("host").orderBy("pos"))).where(F.col("_k") <= budget).drop("_k")


def failure_budget(total: Column) -> Column:
    """A hundredth of all, at least 20 and at most 50."""
    return F.least(F.greatest(F.floor(total / 100), F.lit(20)), F.lit(50)).cast("long")


def exception_kind(message: Column) -> Column:
    """Kind of a network failure: gone, refused, timeout, tls or other."""
    low = F.lower(message)
    return F.when(low.rlike("unknownhost|name or service not known|no such host"), "gone").when(low.rlike("refused|unreachable"), "refused").when(low.rlike("timed? ?out"), "timeout").when(low.rlike("ssl|tls|certificate"), "tls").otherwise("other")


def paced(requests: DataFrame, gap_ms: int, every: int, pause_ms: int, key: str = "site") -> DataFrame:
    """Earliest start of each request (site, pos, ms): a least gap, and a pause after every so many.

    start_k = k * gap + (k // every) * pause + the latest lead any earlier arrival had over that schedule.
    """
    order = Window.partitionBy(key).orderBy("pos")
    k = F.row_number().over(order) - 1
    slot = k * gap_ms + F.floor(k / every) * pause_ms
    rows = requests.withColumn("_slot", slot)
    lead = F.max(F.col("ms") - F.col("_slot")).over(order)
    return rows.withColumn("start_ms", (F.col("_slot") + lead).cast("long")).drop("_slot")
