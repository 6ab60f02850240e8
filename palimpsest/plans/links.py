"""Queries over the link fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import html

def link_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ``a.href``: page_id, page_url, pos, href; empty targets and pure fragments are left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("url", "page_url")
    return html.link_facts(pages, ["page_id", "page_url"]).where("tag = 'a'").select("page_id", "page_url", "pos", "href")


def link_reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each link target is referenced."""
    return link_facts(spark, sf_dir).groupBy("href").agg(F.count("*").alias("n_refs"))


#: DuckDB's form of ``link_facts``; the driver's pages have no other spelling of attributes than this.
LINKS_SQL = """(SELECT page_id, page_url, CAST(pos - 1 AS INTEGER) AS pos, href FROM (
  SELECT page_id, url AS page_url, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages))
  WHERE href <> '' AND NOT starts_with(href, '#'))"""

QUERIES = {"link_reference_counts": link_reference_counts}
SQL = {"link_reference_counts": f"SELECT href, count(*) AS n_refs FROM {LINKS_SQL} GROUP BY href"}
