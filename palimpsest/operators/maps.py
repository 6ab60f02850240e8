"""Links, stored files and the map between them: lookups, repairs, merges.

Tables: ``links`` (page, pos, href), ``files`` (relpath, is_dir), ``map`` (url,
relpath).  All matches are equi-joins on a path in lower case; anchors are cut
before a lookup and put back after it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import codec, mime, paths, redirects


def bare(href: Column) -> Column:
    return F.regexp_extract(href, "^([^#]*)", 1)


def anchor_of(href: Column) -> Column:
    return F.regexp_extract(href, "(#.*)$", 1)


def targets(links: DataFrame) -> DataFrame:
    """Relative links of pages with ``target``, the path from the root that they mean, and its key."""
    folder = F.regexp_extract("page", "^(.*/)?[^/]*$", 1)
    local = links.where(~F.col("href").rlike("(?i)^([a-z][a-z0-9+.-]*:|//)"))
    meant = redirects.columns.resolve_dots(F.concat(folder, codec.columns.decode_mixed(bare(F.col("href")))))
    return local.withColumn("target", meant).withColumn("key", F.lower("target"))


def spelled(files: DataFrame) -> DataFrame:
    """Key to the stored spelling; two stored spellings of one key are an error."""
    found = files.groupBy(F.lower("relpath").alias("key")).agg(F.min("relpath").alias("actual"), F.countDistinct("relpath").alias("_n"), F.max("is_dir").alias("is_dir"))
    return found.select("key", F.when(F.col("_n") == 1, F.col("actual")).otherwise(F.raise_error(F.concat(F.lit("spellings collide: "), F.col("key"))).cast("string")).alias("actual"), "is_dir")


def missing(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose target is stored under no spelling."""
    return targets(links).join(files.select(F.lower("relpath").alias("key")), "key", "left_anti").select("page", "pos", "href")


def case_changes(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links spelled otherwise than the stored file, with the link as it should be."""
    hit = targets(links).join(spelled(files), "key").where("target <> actual")
    fixed = F.concat(redirects.columns.relative_link(F.col("page"), F.col("actual")), anchor_of(F.col("href")))
    return hit.select("page", "pos", F.col("href").alias("old"), fixed.alias("new"))


def first_spelling_that_exists(links: DataFrame, files: DataFrame) -> DataFrame:
    """For each link the likeliest of its spellings that is stored, and the rank of that spelling."""
    each = links.select("page", "pos", "href", F.posexplode(paths.columns.spellings(bare(F.col("href")))).alias("rank", "spelling"))
    hit = each.withColumn("key", F.lower("spelling")).join(spelled(files), "key")
    return hit.groupBy("page", "pos", "href").agg(F.min_by(F.struct("rank", "actual"), "rank").alias("b")).select("page", "pos", "href", "b.rank", "b.actual")


def directory_targets(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links to a directory with its only file; ``problem`` where it holds none or several."""
    inside = files.where("not is_dir").select(F.lower(F.regexp_extract("relpath", "^(.*)/[^/]+$", 1)).alias("key"), "relpath")
    only = inside.groupBy("key").agg(F.count("*").alias("n"), F.min("relpath").alias("child"))
    hit = targets(links).join(spelled(files).where("is_dir"), "key").join(only, "key", "left")
    n = F.coalesce("n", F.lit(0))
    return hit.select("page", "pos", "href", F.when(n == 1, F.col("child")).alias("child"), F.when(n == 0, "empty").when(n > 1, "several files").alias("problem"))


def checked_map(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Map rows with the stored spelling of their file; ``state`` is ok, case or missing."""
    hit = entries.withColumn("key", F.lower("relpath")).join(spelled(files), "key", "left")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("relpath"), "case").otherwise("ok")
    return hit.select("url", F.coalesce("actual", "relpath").alias("relpath"), state.alias("state"))


def lookup(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """relpath of each url: its own row first, else that of the other protocol."""
    url = F.col("url")
    flipped = F.when(url.startswith("http://"), F.concat(F.lit("https"), F.substr(url, F.lit(5)))).when(url.startswith("https://"), F.concat(F.lit("http"), F.substr(url, F.lit(6))))
    own = entries.select("url", F.col("relpath").alias("_own"))
    other = entries.select(F.col("url").alias("_flipped"), F.col("relpath").alias("_other"))
    return urls.withColumn("_flipped", flipped).join(own, "url", "left").join(other, "_flipped", "left").select("url", F.coalesce("_own", "_other").alias("relpath"), F.col("_own").isNotNull().alias("exact"))


def best_urls(entries: DataFrame) -> DataFrame:
    """One URL for each file: a direct one before a decodable proxy before an opaque one, then the shortest."""
    url = F.col("url")
    opaque = url.rlike("^https?://imgprx[.]livejournal[.]net/")
    rank = F.when(~opaque, 0).when(redirects.columns.unwrap(url) != url, 1).otherwise(2)
    return entries.withColumn("rank", rank).groupBy(F.lower("relpath").alias("key")).agg(F.min_by("url", F.struct("rank", F.length("url"), "url")).alias("url"), F.min("rank").alias("rank"))


def failed_by_file(links: DataFrame) -> DataFrame:
    """Failed links (relpath, url, tag) by file: all URLs, whether a picture asked, and whether it can go."""
    return links.groupBy(F.lower("relpath").alias("key")).agg(F.sort_array(F.collect_set("url")).alias("urls"), F.bool_or(F.col("tag") == "img").alias("image"), F.bool_and(F.col("tag") == "img").alias("delete"))


def without_files(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Map rows whose file is not among those that failed or go."""
    return entries.join(gone.select(F.lower("relpath").alias("_gone")), F.lower(entries["relpath"]) == F.col("_gone"), "left_anti")


def renamed_map(entries: DataFrame, renames: DataFrame) -> DataFrame:
    """Map after renames (old, new); a renamed file without a row gets one with the URL that its path tells."""
    moved = entries.join(renames, F.lower("relpath") == F.lower("old"), "left").select("url", F.coalesce("new", "relpath").alias("relpath"))
    lone = renames.join(entries.select(F.lower("relpath").alias("_known")), F.lower("old") == F.col("_known"), "left_anti")
    told = lone.select(paths.columns.original_url(F.col("old")).alias("url"), F.col("new").alias("relpath")).where("url is not null")
    return moved.unionByName(told)


def renamed_links(links: DataFrame, renames: DataFrame) -> DataFrame:
    """Change set of links after renames: the first spelling of a link that was renamed counts."""
    each = links.select("page", "pos", "href", F.posexplode(paths.columns.spellings(bare(F.col("href")))).alias("rank", "spelling"))
    hit = each.join(renames.withColumn("_key", F.lower("old")), F.lower("spelling") == F.col("_key"))
    best = hit.groupBy("page", "pos", "href").agg(F.min_by("new", "rank").alias("new"))
    return best.select("page", "pos", F.col("href").alias("old"), F.concat("new", anchor_of(F.col("href"))).alias("new"))


def unused_renames(renames: DataFrame, links: DataFrame) -> DataFrame:
    """Renames that no link needed."""
    spellings = links.select(F.explode(paths.columns.spellings(bare(F.col("href")))).alias("s"))
    return renames.join(spellings.select(F.lower("s").alias("_s")), F.lower(renames["old"]) == F.col("_s"), "left_anti")


def merge_repositories(here: DataFrame, there: DataFrame) -> DataFrame:
    """State of each relpath of two repositories (relpath, content): equal, conflict, new (to copy) or kept."""
    digest = lambda df, c: df.select("relpath", F.sha2("content", 256).alias(c))
    both = digest(here, "h").join(digest(there, "t"), "relpath", "full")
    return both.select("relpath", F.when(F.col("h").isNull(), "new").when(F.col("t").isNull(), "kept").when(F.col("h") == F.col("t"), "equal").otherwise("conflict").alias("state"))


def file_directory_clashes(files: DataFrame) -> DataFrame:
    """Names that are a file and a directory."""
    key = F.lower("relpath").alias("key")
    return files.where("is_dir").select(key).intersect(files.where("not is_dir").select(key))


def remaining(scheduled: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return scheduled.join(done.select(key), key, "left_anti")


def not_stored(records: DataFrame, pages: DataFrame, reposts: DataFrame) -> DataFrame:
    """Records (rid) that are on disk neither as a page nor as a repost."""
    return records.join(pages.select("rid").unionByName(reposts.select("rid")), "rid", "left_anti")


def local_posts(links: DataFrame, pages: DataFrame, reposts: DataFrame) -> DataFrame:
    """Post links of profile pages (page, rid) with their local file: a page before a repost."""
    stored = pages.select("rid", "relpath", F.lit(0).alias("_r")).unionByName(reposts.select("rid", "relpath", F.lit(1).alias("_r")))
    first = stored.groupBy("rid").agg(F.min_by("relpath", "_r").alias("relpath"))
    return links.join(first, "rid", "left")


def downloaded(links: DataFrame, entries: DataFrame, names: DataFrame) -> DataFrame:
    """Links (name, url) with whether one of four keys is known: name or URL, as it is or unwrapped."""
    url = F.col("url")
    keys = F.array("url", redirects.columns.unwrap(url), "name", redirects.columns.unwrap(F.col("name")))
    known = entries.select(F.col("url").alias("_k")).unionByName(names.select(F.col("name").alias("_k"))).distinct()
    hit = links.withColumn("_k", F.explode(F.array_distinct(keys))).join(known.withColumn("_hit", F.lit(1)), "_k", "left")
    return hit.groupBy("name", "url").agg(F.coalesce(F.max("_hit"), F.lit(0)).cast("boolean").alias("downloaded"))


def album_collisions(albums: DataFrame) -> DataFrame:
    """Files of albums (album, name) whose names collide by case, with the new names all but the first get."""
    place = F.row_number().over(Window.partitionBy("album", F.lower("name")).orderBy("name"))
    stem, ext = F.regexp_extract("name", "^(.*?)([.][^.]*)?$", 1), F.regexp_extract("name", "([.][^.]*)$", 1)
    rows = albums.withColumn("_k", place)
    return rows.where("_k > 1").select("album", "name", F.concat(stem, F.lit("_"), F.col("_k").cast("string"), ext).alias("new_name"))


def spellings_that_collide(names: DataFrame, column: str = "relpath") -> DataFrame:
    """All spellings that share a lower-case form with another one."""
    groups = names.groupBy(F.lower(column).alias("key")).agg(F.collect_set(column).alias("s")).where(F.size("s") > 1)
    return groups.select("key", F.explode("s").alias("spelling"))


def first_of_pictures(links: DataFrame) -> DataFrame:
    """CDN de-duplication: of addresses with one host and path the first with ``x=400`` stays, else the first."""
    key = F.regexp_extract("url", "^(?:https?://)?([^?#]*)", 1)
    wanted = F.when(F.col("url").rlike("[?&]x=400(&|$)"), 0).otherwise(1)
    return links.groupBy(key.alias("key")).agg(F.min_by("url", F.struct(wanted, "pos")).alias("url"))


def external_links(links: DataFrame, sites: list[str]) -> DataFrame:
    """Distinct addresses outside the sites, protocol cut, host in lower case."""
    cut = F.regexp_replace("href", "(?i)^https?://", "")
    host = F.lower(F.regexp_extract(cut, "^([^/?#:]*)", 1))
    own = F.lit(False)
    for site in sites:
        own |= (host == site) | host.endswith(f".{site}")
    rest = F.substr(cut, F.length(host) + 1)
    return links.where(F.col("href").rlike("(?i)^https?://") & ~own).select(F.concat(host, rest).alias("address")).distinct()


def page_links(links: DataFrame, user: str, mangled: str, site: str, pages: DataFrame, reposts: DataFrame) -> DataFrame:
    """Links (page, pos, href) to a user's numbered posts, with the stored file: a page before a repost.

    The address may have either protocol or none, and name the user by path or by host, in any case.
    ``pages`` and ``reposts`` have relpath, below their own folders.
    """
    bases = "|".join(re.escape(base.lower()) for name in dict.fromkeys((user, mangled)) for base in (f"users.{site}/{name}/", f"{name}.{site}/"))
    name = F.regexp_extract(F.lower("href"), f"^(?:https?://)?(?:{bases})([0-9]+\\.html)$", 1)
    stored = [df.select(F.regexp_extract("relpath", "([^/]+)$", 1).alias("name"), F.concat(F.lit(f"../../{folder}/"), F.col("relpath")).alias("local"), F.lit(rank).alias("rank")) for rank, (folder, df) in enumerate((("pages", pages), ("reposts", reposts)))]
    first = stored[0].unionByName(stored[1]).groupBy("name").agg(F.min_by("local", F.struct("rank", "local")).alias("new"))
    return links.withColumn("name", name).where("name <> ''").join(first, "name").select("page", "pos", F.col("href").alias("old"), "new")


def content_types(detected: DataFrame, told: DataFrame) -> DataFrame:
    """Extension of each file by its contents (relpath, ext): what a table tells (relpath, mime) comes before what was found."""
    own = told.select(F.lower("relpath").alias("key"), mime.columns.extension_of(F.col("mime")).alias("_told"))
    return detected.withColumn("key", F.lower("relpath")).join(own, "key", "left").select("key", F.coalesce(F.nullif("_told", F.lit("")), "ext").alias("ext"))


def scheduled_deletes(gone: DataFrame, files: DataFrame) -> DataFrame:
    """Stored spelling of each file that goes; one that is not stored is an error."""
    hit = gone.select(F.lower("relpath").alias("key")).distinct().join(spelled(files), "key", "left")
    return hit.select("key", F.coalesce("actual", F.raise_error(F.concat(F.lit("no such file: "), F.col("key"))).cast("string")).alias("actual"))
