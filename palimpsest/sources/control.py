"""Control files: maps of triplets, page maps, line lists, pattern lists, properties, pairs of style texts.

Each reader takes paths that Spark reads (whole files, so a record is never
cut) and gives rows; what the format forbids raises an error that names it.
Control files are small next to the pages they describe; a file is one row
until it is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "----"
_BOM = "﻿"


def whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of files; line ends are ``\\n``, a byte order mark is removed."""
    found = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return found.select("path", F.regexp_replace(F.regexp_replace("value", f"^{_BOM}", ""), "\\r\\n", "\n").alias("text"))


def file_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\\n\\z", ""), "\\n")


def _records(files: DataFrame, size: int) -> DataFrame:
    """(path, pos, r): the lines of each file in records of ``size``, and a last shorter one."""
    lines = _lines(F.col("text"))
    return files.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), (F.size(lines) - 1).cast("int"), F.lit(size)), lambda k: F.slice(lines, k + 1, size))).alias("pos", "r"))


def _blank(record: Column) -> Column:
    return F.forall(record, lambda x: F.trim(x) == "")


def _or_error(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.concat(F.lit(f"{message} in "), F.col("path"))).cast("string"))


def triplets(files: DataFrame, blanks: bool = True, trim: bool = True) -> DataFrame:
    """(path, pos, key, value) of key, value, ``----`` records.

    Blank triplets are skipped, or an error without ``blanks``; anything but
    blanks after the last triplet is an error.
    """
    clean = F.trim if trim else (lambda c: c)
    r = F.col("r")
    rows = _records(files, 3).withColumn("_blank", _blank(r)).withColumn("_full", F.size("r") == 3)
    skipped = (F.col("_blank") & ~F.col("_full")) | (F.col("_blank") if blanks else F.lit(False))
    sound = F.col("_full") & (clean(F.try_element_at(r, F.lit(3))) == SEPARATOR)
    return rows.where(~skipped).select("path", "pos", _or_error(sound, clean(F.try_element_at(r, F.lit(1))), "no record").alias("key"), clean(F.try_element_at(r, F.lit(2))).alias("value"))


def page_map(files: DataFrame) -> DataFrame:
    """(path, url, file, kind) of records of four lines; one URL with two files is an error, but for ``index.html``."""
    r = F.col("r")
    at = lambda k: F.trim(F.try_element_at(r, F.lit(k)))
    rows = _records(files, 4).where(~_blank(r)).select("path", _or_error((F.size(r) == 4) & (at(4) == SEPARATOR), at(1), "no record").alias("url"), at(2).alias("file"), at(3).alias("kind"))
    named = F.when(~F.col("file").rlike("(^|/)index[.]html$"), F.col("file"))
    one = rows.groupBy("path", "url").agg(F.min("file").alias("file"), F.min("kind").alias("kind"), F.countDistinct(named).alias("_n"))
    return one.select("path", "url", _or_error(F.col("_n") <= 1, F.col("file"), "two files for one address").alias("file"), "kind")


def line_list(files: DataFrame) -> DataFrame:
    """(path, pos, line): trimmed lines without blank ones and those that begin with ``#``."""
    rows = files.select("path", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", F.trim("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def patterns(lines: DataFrame) -> DataFrame:
    """A regular expression for each URL pattern: ``*.`` in front means any subdomain, a final ``*`` any rest."""
    bare = F.regexp_replace(F.regexp_replace("line", "(?i)^https?://", ""), r"^\*\.|\*$", "")
    quoted = F.concat(F.lit("\\Q"), F.regexp_replace(bare, r"\*$", ""), F.lit("\\E"))
    return lines.withColumn("regex", F.concat(F.lit("(?i)^"), F.when(F.col("line").rlike(r"^(https?://)?\*\."), "([^/]+\\.)?").otherwise(""), quoted, F.when(F.col("line").endswith("*"), "").otherwise("$")))


def properties(files: DataFrame) -> DataFrame:
    """(path, key, value) of ``key=value`` lines; the last of a key counts."""
    rows = line_list(files).withColumn("key", F.trim(F.regexp_extract("line", "^([^=]*)", 1))).withColumn("value", F.trim(F.regexp_replace("line", "^[^=]*=?", "")))
    return rows.groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def normal_style(text: Column) -> Column:
    """Key of a style text: no mark, ``\\n`` line ends, no blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"^{_BOM}|\\r", ""), "(?m)[ \\t]+$", ""), "\\s+$", "")


def bad_to_good(files: DataFrame) -> DataFrame:
    """(name, bad, good) of ``x.bad`` and ``x.good`` files; a missing half or two equal bad texts are errors."""
    named = files.select(F.regexp_extract("path", "([^/]+)[.](bad|good)$", 1).alias("name"), F.regexp_extract("path", "[.](bad|good)$", 1).alias("side"), "text").where("side <> ''")
    pairs = named.groupBy("name").agg(F.max(F.when(F.col("side") == "bad", normal_style(F.col("text")))).alias("bad"), F.max(F.when(F.col("side") == "good", F.col("text"))).alias("good"))
    twins = pairs.groupBy("bad").agg(F.count("*").alias("_n"))
    out = pairs.join(twins, "bad", "left")
    fine = F.col("bad").isNotNull() & F.col("good").isNotNull() & (F.col("_n") == 1)
    return out.select(F.when(fine, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no pair, or a repeated one: "), F.col("name"))).cast("string")).alias("name"), "bad", "good")


def first_that_has(chain: list[DataFrame], key: str) -> DataFrame:
    """Overrides: for each key the row of the first table of the chain that has it."""
    out = chain[0]
    for later in chain[1:]:
        out = out.unionByName(later.join(out, key, "left_anti"))
    return out


def unique_values(entries: DataFrame, lower: bool = True) -> DataFrame:
    """Index from value to key; a value of two keys is an error."""
    value = F.lower("value") if lower else F.col("value")
    found = entries.groupBy(value.alias("value")).agg(F.min("key").alias("key"), F.count("*").alias("_n"))
    return found.select(F.when(F.col("_n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("repeated value "), F.col("value"))).cast("string")).alias("value"), "key")


def keys_by_value(entries: DataFrame, lower: bool = True) -> DataFrame:
    """Index from value to all its keys, sorted."""
    return entries.groupBy((F.lower("value") if lower else F.col("value")).alias("value")).agg(F.sort_array(F.collect_list("key")).alias("keys"))


def compose(entries: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The text of a map file, one row: triplets in the order of ``order``, keys by default.

    A control file is written as a whole; pages and links never go through it.
    """
    item = F.concat("key", F.lit("\n"), "value", F.lit(f"\n{SEPARATOR}\n"))
    ranked = F.sort_array(F.collect_list(F.struct(*(order or ["key"]), item.alias("item"))))
    return entries.agg(F.array_join(F.transform(ranked, lambda x: x["item"]), "").alias("text"))


def appended(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """A map with more rows; a key that it has is an error."""
    hits = fresh.join(entries.select(F.col("key").alias("key"), F.lit(True).alias("_hit")), "key", "left")
    new = hits.select(F.when(F.col("_hit").isNull(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("key exists: "), F.col("key"))).cast("string")).alias("key"), "value")
    return entries.select("key", "value").unionByName(new)
