"""Queries that apply the URL, path and text functions to stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text, urls

#: A block list as an operator of the archive would write it.
BLOCKED = ["*.example.org/es*", "www.*", "m.*", "*.example.com"]
STAMP = "20240102030405"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", urls.host(u).alias("host"), urls.host_lowercase(u).alias("host_lowercase"), urls.on_site(urls.host_lowercase(u), "example.org").alias("on_site"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.strip_default_port(u).alias("no_port"),
        urls.strip_trailing_slash(u).alias("no_slash"),
        urls.strip_anchor(u).alias("no_anchor"),
        urls.anchor(u).alias("anchor"),
        urls.with_anchor(urls.strip_anchor(u), F.lit("top")).alias("to_top"),
        urls.strip_parameters(u).alias("no_parameters"),
        urls.strip_protocol(u).alias("no_protocol"),
        urls.flip_protocol(u).alias("flipped"),
        urls.query_parameter(u, "utm_source").alias("utm_source"),
        urls.repair_slashes(F.replace(u, F.lit("://"), F.lit(":/"))).alias("repaired"),
    )


def url_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.has_percent_encoding(u).alias("encoded"),
        urls.decode(u).alias("decoded"),
        urls.variant_score(u).alias("score"),
        urls.path_of(u).alias("path"),
        urls.path_depth(urls.path_of(u)).alias("depth"),
        urls.media_extension(urls.path_of(u)).alias("extension"),
        u.rlike("^(?i)https?://").alias("absolute"),
        urls.path_of(u).rlike("/[0-9]+([.]html)?$").alias("is_record"),
    )


def blocked_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(urls.matches_any(F.col("url"), BLOCKED)).select("page_id", "url")


def archive_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = urls.archive_url(F.col("url"), F.lit(STAMP), "id_")
    two = urls.archive_url(one, F.lit(STAMP))
    return _pages(spark, sf_dir).select("page_id", one.alias("snapshot"), urls.is_archive_url(two).alias("is_archive"), urls.archived_part(two).alias("original"))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best spelling of each page address: own port, anchor and last slash cut, least score, https where any spelling has it."""
    u = urls.strip_trailing_slash(urls.strip_anchor(urls.strip_default_port(F.col("url"))))
    pages = _pages(spark, sf_dir).select(u.alias("u"))
    host = F.regexp_extract(urls.strip_protocol(F.col("u")), "^([^/?#]*)", 1)
    key = F.concat(F.lower(host), F.substr(urls.strip_protocol(F.col("u")), F.length(host) + 1))
    best = F.min_by("u", F.struct(urls.variant_score(F.col("u")), F.col("u")))
    secure = F.bool_or(F.lower("u").startswith("https://"))
    groups = pages.groupBy(key.alias("url_key")).agg(best.alias("best"), secure.alias("secure"), F.count("*").alias("n_variants"))
    return groups.select("url_key", F.when(F.col("secure"), F.regexp_replace("best", "^(?i)http://", "https://")).otherwise(F.col("best")).alias("url"), "n_variants")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.between(F.col("html"), "<title>", "</title>")
    return _pages(spark, sf_dir).select("page_id", text.despace(title).alias("title"), text.trim_nbsp(title).alias("trimmed"), text.occurrences(F.col("html"), "<p>").alias("n_paragraphs"), text.plural(text.occurrences(F.col("html"), "<li>"), "item", "items").alias("items"))


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each tag opens on each page."""
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))
    return _pages(spark, sf_dir).select("page_id", tags.alias("t")).groupBy("page_id", F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


def mangled_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("_"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit("_"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.mangle_user(name).alias("host_name"))


def navigation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = text.expand(F.lit('<a href="{$url}">{$id}</a>{$none}'), {"url": F.col("url"), "id": F.col("page_id").cast("string"), "none": F.lit(None).cast("string")})
    return _pages(spark, sf_dir).select("page_id", bar.alias("bar"))


_NO_ANCHOR = "regexp_extract(url, '^([^#]*)', 1)"
_SCORE = "CAST((CASE WHEN starts_with(url, 'https:') THEN -10 ELSE 0 END) + (CASE WHEN contains(url, '%25') THEN 10 ELSE 0 END) + (CASE WHEN contains(url, '%20') THEN 5 ELSE 0 END) + length(url) // 100 AS BIGINT)"
_PATH = "regexp_extract(regexp_replace(url, '(?i)^[a-z]+://[^/?#]*', ''), '^([^?#]*)', 1)"
_HOST = r"regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '(?i)^[a-z][a-z0-9+.-]*://', ''), '^//', ''), '^([^/?#]*)', 1), ':[0-9]*$', ''), '\.$', '')"
_SNAP = f"'https://web.archive.org/web/{STAMP}id_/' || url"
_TITLE = "CASE WHEN contains(html, '<title>') AND contains(split_part(html, '<title>', 2), '</title>') THEN split_part(split_part(html, '<title>', 2), '</title>', 1) END"

SQL = {
    "url_hosts": f"SELECT page_id, CASE WHEN contains(h, '.') THEN h END AS host, CASE WHEN contains(h, '.') THEN lower(h) END AS host_lowercase, CASE WHEN contains(h, '.') THEN lower(h) = 'example.org' OR ends_with(lower(h), '.example.org') END AS on_site FROM (SELECT page_id, {_HOST} AS h FROM pages)",
    "url_parts": f"""SELECT page_id,
      regexp_replace(regexp_replace(url, '(?i)^(http://[^/?#:]+):80([/?#]|$)', '\\1\\2'), '(?i)^(https://[^/?#:]+):443([/?#]|$)', '\\1\\2') AS no_port,
      rtrim(url, '/') AS no_slash, {_NO_ANCHOR} AS no_anchor,
      CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS anchor, {_NO_ANCHOR} || '#top' AS to_top,
      split_part(url, '?', 1) AS no_parameters, regexp_replace(url, '(?i)^https?://', '') AS no_protocol,
      CASE WHEN starts_with(url, 'http://') THEN 'https://' || url[8:] WHEN starts_with(url, 'https://') THEN 'http://' || url[9:] ELSE url END AS flipped,
      regexp_extract({_NO_ANCHOR}, '[?&]utm_source=([^&]*)', 1) AS utm_source,
      regexp_replace(replace(url, '://', ':/'), '^(https?):/+', '\\1://') AS repaired FROM pages""",
    "url_checks": f"""SELECT page_id, regexp_matches(url, '%[0-9A-Fa-f]{{2}}') AS encoded, url_decode(url) AS decoded, {_SCORE} AS score, p AS path,
      CAST(len(list_filter(string_split(p, '/'), lambda x: x <> '')) AS BIGINT) AS depth,
      CASE WHEN x <> '' AND (length(x) <= 4 OR x IN ('shtml', 'xhtml')) THEN x END AS extension,
      regexp_matches(url, '^(?i)https?://') AS absolute, regexp_matches(p, '/[0-9]+([.]html)?$') AS is_record
      FROM (SELECT *, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS x FROM (SELECT *, {_PATH} AS p FROM pages))""",
    "blocked_urls": "SELECT page_id, url FROM (SELECT *, regexp_replace(url, '(?i)^https?://', '') AS r FROM pages) WHERE regexp_matches(r, '^([^/]+\\.)?example\\.org/es') OR starts_with(r, 'www.') OR starts_with(r, 'm.') OR regexp_matches(r, '^([^/]+\\.)?example\\.com$')",
    "archive_urls": f"SELECT page_id, {_SNAP} AS snapshot, true AS is_archive, url AS original FROM pages",
    "canonical_urls": f"""SELECT k AS url_key, CASE WHEN secure THEN regexp_replace(best, '^http://', 'https://') ELSE best END AS url, n_variants FROM (
      SELECT lower(h) || r[length(h) + 1:] AS k, first(url ORDER BY {_SCORE}, url) AS best, bool_or(starts_with(url, 'https://')) AS secure, count(*) AS n_variants
      FROM (SELECT url, r, regexp_extract(r, '^([^/?]*)', 1) AS h FROM (SELECT url, regexp_replace(url, '^https?://', '') AS r FROM (
        SELECT rtrim(regexp_replace(regexp_replace(split_part(url, '#', 1), '^(http://[^/?:]+):80([/?]|$)', '\\1\\2'), '^(https://[^/?:]+):443([/?]|$)', '\\1\\2'), '/') AS url FROM pages))) GROUP BY ALL)""",
    "page_titles": f"""SELECT page_id, trim(regexp_replace(t, '[ \\t\\n\\r\u00a0]+', ' ', 'g')) AS title, regexp_replace(regexp_replace(t, '^[ \\t\\n\\r\u00a0]+', ''), '[ \\t\\n\\r\u00a0]+$', '') AS trimmed, n_paragraphs, n || CASE WHEN n = 1 THEN ' item' ELSE ' items' END AS items
      FROM (SELECT page_id, {_TITLE} AS t, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS n_paragraphs, (length(html) - length(replace(html, '<li>', ''))) // 4 AS n FROM pages)""",
    "page_tags": "SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS t FROM pages) GROUP BY ALL",
    "mangled_users": "SELECT c_custkey, '_' || replace(replace(c_name, '#', '_'), '_', '-') || '_' AS host_name FROM customer",
    "navigation_bars": """SELECT page_id, '<a href="' || url || '">' || page_id || '</a>{$none}' AS bar FROM pages""",
}
QUERIES = {f.__name__: f for f in (url_hosts, url_parts, url_checks, blocked_urls, archive_urls, canonical_urls, page_titles, page_tags, mangled_users, navigation_bars)}
