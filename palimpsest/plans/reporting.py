"""Reports: month groups and navigation, comment threads, activity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.streaming.activity import instant


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer by month: the stand-in for a journal's pages by month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    month = F.struct(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return orders.select("o_custkey", "o_orderkey", month["y"].alias("y"), month["m"].alias("m"))


def month_tapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per journal and month: the pages in order, joined, and the first of them."""
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    return _months(spark, sf_dir).groupBy("o_custkey", "y", "m").agg(F.array_join(keys, "|").alias("tape"), F.min("o_orderkey").alias("first_rid"))


def month_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next month that a journal has, its part number, and how far along it is."""
    own = Window.partitionBy("o_custkey")
    order = own.orderBy("ym")
    ym = (F.col("y") * 12 + F.col("m")).cast("long")
    months = _months(spark, sf_dir).select("o_custkey", ym.alias("ym")).distinct()
    count = F.count("*").over(own)
    part = F.row_number().over(order).cast("long")
    return months.select("o_custkey", "ym", F.lag("ym").over(order).alias("prev"), F.lead("ym").over(order).alias("next"), part.alias("part"), F.floor(part * 100 / count).cast("long").alias("percent"))


def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by year-month within an inclusive range."""
    ym = text.year_month(F.col("o_orderdate"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(ym.between(1993 * 12 + 3, 1996 * 12 + 8))
    return orders.groupBy(ym.alias("ym")).agg(F.count("*").alias("n_pages"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type in the events of each user: a new group starts whenever the type changes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    starts = F.coalesce(F.lag("event_type").over(order) != F.col("event_type"), F.lit(True)).cast("long")
    runs = events.withColumn("starts", starts).withColumn("run", F.sum("starts").over(order))
    return runs.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def activity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: events of its user in the 5 minutes up to it, and seconds since the oldest of them."""
    micros = F.unix_micros(instant("ts"))
    window = Window.partitionBy("user_id").orderBy(F.col("us")).rangeBetween(-300_000_000, 0)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("us", micros)
    return events.select("event_id", F.count("*").over(window).alias("n"), F.floor((F.col("us") - F.min("us").over(window)) / 1_000_000).cast("long").alias("seconds"))


def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since the user's event before, and how long a limit of one in 1200 ms would have waited."""
    ms = F.unix_millis(instant("ts"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = ms - F.lag(ms).over(order)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", gap.alias("gap_ms"), F.greatest(F.lit(1200) - gap, F.lit(0)).cast("long").alias("wait_ms"))


def cooloff_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cool-off of 180 seconds after an error, extended by each error within it."""
    errors = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error'").withColumn("us", F.unix_micros(instant("ts")))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    opens = F.coalesce(F.col("us") - F.lag("us").over(order) > 180_000_000, F.lit(True)).cast("long")
    spans = errors.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order))
    return spans.groupBy("user_id", "span").agg(F.count("*").alias("n_errors"), F.min("us").alias("begins"), (F.max("us") + 180_000_000).alias("ends"))


def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over a threshold, slowest first."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("value >= 100").select("event_id", "value").orderBy(F.desc("value"), "event_id")


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed getters on JSON: a text or a whole number is accepted as text, other kinds give null."""
    found = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    raw = F.when(F.schema_of_variant(found).isin("STRING", "BIGINT"), F.try_variant_get(found, "$", "string"))
    stamp = text.archive_stamp(F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", raw.alias("k_text"), raw.try_cast("long").alias("k"), stamp.alias("stamp"))


def first_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, as the first snapshot of an address."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def failure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of a user's events, at most 50 and then at least 20."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    return events.select("user_id", F.greatest(F.least(F.floor(F.col("n") / 100), F.lit(50)), F.lit(20)).cast("long").alias("budget"))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def comment_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with its parent, the turn before; a turn without one is a violation unless it is the first."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.when(F.lag("turn").over(order) == F.col("turn") - 1, F.lag("role").over(order))
    return _comments(spark, sf_dir).select("conv_id", "turn", before.alias("parent_role"), (before.isNull() & (F.col("turn") > 0)).alias("violation"))


def comment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per thread: comments, those without text, and whether all agree on one role."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return _comments(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(blank).alias("not_loaded"), (F.countDistinct("role") <= 1).alias("agree"), F.max("turn").alias("depth"))


def comment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first order of each thread, and the offset of 30 pixels for each level below the first."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    place = F.row_number().over(order).cast("long")
    return _comments(spark, sf_dir).select("conv_id", "turn", place.alias("place"), F.concat((30 * F.col("turn")).cast("string"), F.lit("px")).alias("indent"))


_M = "(SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders)"
_YM = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT)"
SQL = {
    "month_tapes": f"SELECT o_custkey, y, m, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS tape, min(o_orderkey) AS first_rid FROM {_M} GROUP BY ALL",
    "month_navigation": f"SELECT o_custkey, ym, lag(ym) OVER w AS prev, lead(ym) OVER w AS next, row_number() OVER w AS part, row_number() OVER w * 100 // count(*) OVER (PARTITION BY o_custkey) AS percent FROM (SELECT DISTINCT o_custkey, {_YM} AS ym FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY ym)",
    "year_range": f"SELECT {_YM} AS ym, count(*) AS n_pages FROM orders WHERE {_YM} BETWEEN {1993 * 12 + 3} AND {1996 * 12 + 8} GROUP BY ALL",
    "event_runs": "SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS s FROM events)) GROUP BY ALL",
    "activity_window": "SELECT event_id, count(*) OVER w AS n, (us - min(us) OVER w) // 1000000 AS seconds FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)",
    "request_gaps": "SELECT event_id, g AS gap_ms, CASE WHEN g < 1200 THEN 1200 - g ELSE 0 END AS wait_ms FROM (SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)",
    "cooloff_intervals": "SELECT user_id, CAST(span AS BIGINT) AS span, count(*) AS n_errors, min(us) AS begins, max(us) + 180000000 AS ends FROM (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 180000000 THEN 0 ELSE 1 END AS o FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'error'))) GROUP BY user_id, span",
    "slow_requests": "SELECT event_id, value FROM events WHERE value >= 100",
    "event_properties": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN json_extract_string(props, '$.k') END AS k_text, CASE WHEN json_type(props, '$.k') IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events",
    "first_snapshots": "SELECT user_id, event_type, first(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY ALL",
    "failure_budget": "SELECT user_id, CAST(greatest(least(count(*) // 100, 50), 20) AS BIGINT) AS budget FROM events GROUP BY user_id",
    "comment_parents": "SELECT c.conv_id, c.turn, p.role AS parent_role, p.role IS NULL AND c.turn > 0 AS violation FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1",
    "comment_totals": "SELECT conv_id, count(*) AS n, count(*) FILTER (coalesce(trim(text), '') = '') AS not_loaded, count(DISTINCT role) <= 1 AS agree, max(turn) AS depth FROM conversations GROUP BY conv_id",
    "comment_offsets": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, (30 * turn) || 'px' AS indent FROM conversations",
}
QUERIES = {f.__name__: f for f in (month_tapes, month_navigation, year_range, event_runs, activity_window, request_gaps, cooloff_intervals, slow_requests, event_properties, first_snapshots, failure_budget, comment_parents, comment_totals, comment_offsets)}
