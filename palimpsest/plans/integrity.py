"""Integrity passes: link targets, spellings, joins of maps, sets of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import redirects, urls
from palimpsest.operators import maps
from palimpsest.plans.links import LINKS_SQL, link_facts


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link facts with the host and path that a link means on its page, and both in lower case as the key."""
    meant = redirects.columns.resolve(F.col("page_url"), F.col("href"))
    facts = link_facts(spark, sf_dir).withColumn("path", F.concat(urls.host_lowercase(meant), urls.path_of(meant)))
    return facts.where("path <> ''").withColumn("path_key", F.lower("path"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts and paths of stored pages, in lower case."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.lower(F.concat(urls.host(F.col("url")), urls.path_of(F.col("url")))).alias("path_key")).distinct()


def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose target is not stored under any spelling."""
    return _targets(spark, sf_dir).join(_stored(spark, sf_dir), "path_key", "left_anti").select("page_id", "pos", "href")


def unreferenced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored paths that no link names."""
    return _stored(spark, sf_dir).join(_targets(spark, sf_dir), "path_key", "left_anti")


def spelling_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with several spellings: how many, and the first in order."""
    spelled = _targets(spark, sf_dir).select("path_key", "path").distinct()
    return spelled.groupBy("path_key").agg(F.count("*").alias("n_spellings"), F.min("path").alias("first_spelling")).where("n_spellings > 1")


def case_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change set: links that are spelled otherwise than the first spelling of their target."""
    # one pass over the pages: the first spelling of a target, next to each link to it
    own = Window.partitionBy("path_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    change = _targets(spark, sf_dir).withColumn("first_spelling", F.min("path").over(own)).where("path <> first_spelling")
    return change.select("page_id", "pos", F.col("path").alias("old"), F.col("first_spelling").alias("new"))


def link_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page: links scanned, those with a capital, those with an anchor or query, distinct ones."""
    return _targets(spark, sf_dir).groupBy("page_id").agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("path") != F.col("path_key")).alias("capital"),
        F.count_if(F.col("href") != F.col("path")).alias("qualified"),
        F.countDistinct("path_key").alias("n_distinct"),
    )


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each page the first link to each target."""
    return _targets(spark, sf_dir).groupBy("page_id", "path_key").agg(F.min("pos").alias("pos"), F.min_by("href", "pos").alias("href")).select("page_id", "pos", "href")


def single_child_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories that hold one target only, and that target."""
    paths = _targets(spark, sf_dir).select("path_key", F.regexp_extract("path_key", "^(.*/)[^/]+$", 1).alias("directory")).where("directory <> ''").distinct()
    return paths.groupBy("directory").agg(F.count("*").alias("n"), F.min("path_key").alias("only_child")).where("n = 1").drop("n")


def file_and_directory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are a target and a directory of other targets."""
    paths = _targets(spark, sf_dir).select("path_key").distinct()
    folders = paths.select(F.regexp_extract("path_key", "^(.*)/[^/]+$", 1).alias("path_key"))
    return paths.intersect(folders)


def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directories above the targets, with their depth."""
    parts = F.filter(F.split("path_key", "/"), lambda x: x != "")
    up_to = F.sequence(F.lit(1), F.size(parts) - 1)
    deep = _targets(spark, sf_dir).select("path_key").distinct().where(F.size(parts) > 1).select(F.explode(F.transform(up_to, lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("directory"))
    return deep.distinct().withColumn("depth", urls.path_depth(F.col("directory")))


def protocol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each address, its protocol flipped, looked up in the map of stored addresses: as it is first, else flipped back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.flip_protocol(F.col("url")).alias("wanted"), "url")
    known = pages.select(F.col("url").alias("url")).distinct().withColumn("relpath", F.col("url"))
    found = maps.lookup(pages.select(F.col("wanted").alias("url")).distinct(), known)
    return pages.join(found.withColumnRenamed("url", "wanted"), "wanted").select("page_id", F.col("relpath").alias("found"), "exact")


def repository_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two repositories, nations and regions by key: which rows conflict, are equal, or are missing on one side."""
    left = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("relpath"), F.sha2("n_name", 256).alias("l"))
    right = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("relpath"), F.sha2("r_name", 256).alias("r"))
    state = F.when(F.col("l").isNull(), "new").when(F.col("r").isNull(), "kept").when(F.col("l") == F.col("r"), "equal").otherwise("conflict")
    return left.join(right, "relpath", "full").select(F.col("relpath").cast("long").alias("relpath"), state.alias("state"))


def remaining_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled minus done: customers without an order."""
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").join(done, "c_custkey", "left_anti")


# all links of the driver's pages begin with a slash, or are absolute
_T = rf"""(SELECT *, lower(path) AS path_key FROM (SELECT *, CASE WHEN starts_with(href, '/') THEN lower(regexp_extract(page_url, '^https?://([^/?#:]+)', 1)) || regexp_extract(href, '^([^?#]*)', 1)
  ELSE lower(regexp_extract(href, '^https?://([^/?#:]+)', 1)) || regexp_extract(href, '^https?://[^/?#]*([^?#]*)', 1) END AS path FROM {LINKS_SQL}) WHERE path <> '')"""
_S = "(SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1) || regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS path_key FROM pages)"
_C = f"(SELECT path_key, count(DISTINCT path) AS n_spellings, min(path) AS first_spelling FROM {_T} GROUP BY path_key HAVING count(DISTINCT path) > 1)"

SQL = {
    "missing_links": f"SELECT page_id, pos, href FROM {_T} WHERE path_key NOT IN (SELECT path_key FROM {_S})",
    "unreferenced_pages": f"SELECT path_key FROM {_S} WHERE path_key NOT IN (SELECT path_key FROM {_T})",
    "spelling_collisions": f"SELECT * FROM {_C}",
    "case_rewrites": f"SELECT page_id, pos, path AS old, first_spelling AS new FROM {_T} JOIN {_C} USING (path_key) WHERE path <> first_spelling",
    "link_counters": f"SELECT page_id, count(*) AS scanned, count(*) FILTER (path <> path_key) AS capital, count(*) FILTER (href <> path) AS qualified, count(DISTINCT path_key) AS n_distinct FROM {_T} GROUP BY page_id",
    "first_occurrences": f"SELECT page_id, min(pos) AS pos, arg_min(href, pos) AS href FROM {_T} GROUP BY page_id, path_key",
    "single_child_directories": f"SELECT directory, min(path_key) AS only_child FROM (SELECT DISTINCT path_key, regexp_extract(path_key, '^(.*/)[^/]+$', 1) AS directory FROM {_T}) WHERE directory <> '' GROUP BY directory HAVING count(*) = 1",
    "file_and_directory_names": f"SELECT path_key FROM {_T} INTERSECT SELECT regexp_extract(path_key, '^(.*)/[^/]+$', 1) FROM {_T}",
    "directory_tree": f"WITH RECURSIVE up(d) AS (SELECT DISTINCT regexp_extract(rtrim(path_key, '/'), '^(.*)/[^/]+$', 1) FROM {_T} UNION SELECT regexp_extract(d, '^(.*)/[^/]+$', 1) FROM up WHERE d <> '') SELECT d AS directory, CAST(length(d) - length(replace(d, '/', '')) + 1 AS BIGINT) AS depth FROM up WHERE d <> ''",
    "protocol_lookup": "SELECT page_id, CASE WHEN w IN (SELECT url FROM pages) THEN w ELSE url END AS found, w IN (SELECT url FROM pages) AS exact FROM (SELECT page_id, url, CASE WHEN starts_with(url, 'https://') THEN 'http' || url[6:] WHEN starts_with(url, 'http://') THEN 'https' || url[5:] ELSE url END AS w FROM pages)",
    "repository_merge": "SELECT CAST(coalesce(n_nationkey, r_regionkey) AS BIGINT) AS relpath, CASE WHEN n_name IS NULL THEN 'new' WHEN r_name IS NULL THEN 'kept' WHEN n_name = r_name THEN 'equal' ELSE 'conflict' END AS state FROM nation FULL JOIN region ON n_nationkey = r_regionkey",
    "remaining_items": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
QUERIES = {f.__name__: f for f in (missing_links, unreferenced_pages, spelling_collisions, case_rewrites, link_counters, first_occurrences, single_child_directories, file_and_directory_names, directory_tree, protocol_lookup, repository_merge, remaining_items)}
