"""Month tapes: pages of one month and one style after another, their parts and navigation.

Pages: journal, year, month, rid, head (HTML of the head), body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIVIDER = '<hr class="divider">'


def style_key(head: Column) -> Column:
    """What pages of one style share: the head without title, meta, navigation links, noscript, comments and blanks."""
    out = head
    for pattern in ("<!--.*?-->", "<title\\b.*?</title>", "<noscript\\b.*?</noscript>", "<meta\\b[^>]*>", "<link\\b[^>]*rel=\"?(next|prev|canonical|alternate|shortlink)\\b[^>]*>"):
        out = F.regexp_replace(out, f"(?is){pattern}", "")
    return F.trim(F.regexp_replace(out, "\\s+", " "))


def tapes(pages: DataFrame) -> DataFrame:
    """One row for each journal, month and style: first rid, pages in order, the joined bodies, part and file name.

    A tape holds one month; its pages are joined in order of rid after a
    partial collection in each task.
    """
    keyed = pages.withColumn("style", F.md5(style_key(F.col("head"))))
    listed = keyed.groupBy("journal", "year", "month", "style").agg(F.sort_array(F.collect_list(F.struct("rid", "body"))).alias("p"))
    rows = listed.select("journal", "year", "month", F.element_at("p", 1)["rid"].alias("first_rid"), F.size("p").cast("long").alias("n_pages"), F.array_join(F.transform("p", lambda x: x["body"]), DIVIDER).alias("body"))
    month = Window.partitionBy("journal", "year", "month")
    part, parts = F.row_number().over(month.orderBy("first_rid")), F.count("*").over(month)
    stem = F.format_string("%04d-%02d", "year", "month")
    return rows.withColumn("part", part).withColumn("file", F.concat(stem, F.when(parts > 1, F.concat(F.lit("-"), part.cast("string"))).otherwise(""), F.lit(".html")))


def navigation(files: DataFrame) -> DataFrame:
    """Previous and next file by year, month and part; none where a journal has one file only."""
    order = Window.partitionBy("journal").orderBy("year", "month", "part")
    several = F.count("*").over(Window.partitionBy("journal")) > 1
    return files.select("journal", "file", F.when(several, F.lag("file").over(order)).alias("prev"), F.when(several, F.lead("file").over(order)).alias("next"))


def year_navigation(files: DataFrame) -> DataFrame:
    """Previous and next year that a journal has."""
    order = Window.partitionBy("journal").orderBy("year")
    years = files.select("journal", "year").distinct()
    return years.select("journal", "year", F.lag("year").over(order).alias("prev"), F.lead("year").over(order).alias("next"))


def year_index(files: DataFrame) -> DataFrame:
    """HTML list of the files of each year."""
    item = F.concat(F.lit('<a href="'), "file", F.lit('">'), "file", F.lit("</a><br>"))
    listed = F.sort_array(F.collect_list(F.struct("month", "part", item.alias("html"))))
    return files.groupBy("journal", "year").agg(F.array_join(F.transform(listed, lambda x: x["html"]), "\n").alias("html"))


def flat_index(pages: DataFrame) -> DataFrame:
    """HTML list of the pages of each journal, by number."""
    listed = F.sort_array(F.collect_list("rid"))
    link = lambda r: F.concat(F.lit('<a href="'), r.cast("string"), F.lit('.html">'), r.cast("string"), F.lit("</a>"))
    return pages.groupBy("journal").agg(F.array_join(F.transform(listed, link), "<br>\n").alias("html"))


_BAR = '<div id="navigation-bar">'


def with_bar(html: Column, prev: Column, index: Column, next_: Column) -> Column:
    """A bar of links at the start of the body, in place of an older one."""
    link = lambda href, name: F.when(href.isNull(), name).otherwise(F.concat(F.lit('<a href="'), href, F.lit(f'">{name}</a>')))
    bar = F.concat(F.lit(_BAR), link(prev, "prev"), F.lit(" | "), link(index, "index"), F.lit(" | "), link(next_, "next"), F.lit("</div>"))
    clean = F.regexp_replace(html, f"(?s){_BAR}.*?</div>", "")
    opened = F.regexp_extract(clean, "(?is)^(.*?<body\\b[^>]*>)", 1)
    return F.concat(opened, bar, F.substr(clean, F.length(opened) + 1))


def month_runs(items: DataFrame) -> DataFrame:
    """Consecutive runs of one month in order of ``pos``: a month that comes back is a new run.  Undated items join the run before."""
    order = Window.partitionBy("source").orderBy("pos")
    month = F.last(F.date_format("date", "yyyy-MM"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = items.withColumn("month", month)
    rows = rows.withColumn("_starts", (~F.lag("month").over(order).eqNullSafe(F.col("month"))).cast("int"))
    rows = rows.withColumn("run", F.sum("_starts").over(order))
    return rows.groupBy("source", "run").agg(F.first("month").alias("month"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def triples(items: DataFrame) -> DataFrame:
    """Question, answer and date from neighbouring items (source, pos, kind, text); another order is an error."""
    order = Window.partitionBy("source").orderBy("pos")
    rows = items.withColumn("_k", F.row_number().over(order) - 1).withColumn("n", F.floor(F.col("_k") / 3))
    wanted = F.element_at(F.array(F.lit("q"), F.lit("a"), F.lit("date")), (F.col("_k") % 3 + 1).cast("int"))
    text = F.when(F.col("kind") == wanted, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("out of order at "), F.col("pos").cast("string"))).cast("string"))
    return rows.withColumn("text", text).groupBy("source", "n").agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(c) for k, c in (("q", "question"), ("a", "answer"), ("date", "date"))])


def consensus(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The one non-null value of each group; an error where values differ."""
    found = df.groupBy(*keys).agg(F.countDistinct(value).alias("_n"), F.max(value).alias(value))
    kind = df.schema[value].dataType
    return found.select(*keys, F.when(F.col("_n") <= 1, F.col(value)).otherwise(F.raise_error(F.lit(f"values of {value} differ")).cast(kind)).alias(value))
