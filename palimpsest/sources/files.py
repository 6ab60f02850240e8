"""Trees of files: scans by extension, directories, journals, comment files, and guarded writes.

A listing is a table of paths (and bytes where asked for); everything derived
from it is an expression, so no file is opened on the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of pages.
PAGES = ("html", "htm", "shtml", "shtm")


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^.*?" + "".join(c if c.isalnum() or c in "/-_" else f"[{c}]" for c in root.rstrip("/").split("://")[-1].lstrip("/")) + "/", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1))


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, content: bool = False) -> DataFrame:
    """relpath and length (and content) of the files below a folder, by extension in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select(relative(F.col("path"), root).alias("relpath"), "length", *(["content"] if content else []))
    return files.where(extension(F.col("relpath")).isin(*extensions)) if extensions else files


def scan_pages(spark: SparkSession, root: str, only_html: bool = False) -> DataFrame:
    return scan(spark, root, ("html",) if only_html else PAGES)


def directories(files: DataFrame) -> DataFrame:
    """All directories above the files of a listing."""
    parts = F.split("relpath", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return files.where(F.size(parts) > 1).select(F.explode(above).alias("relpath")).distinct()


def files_and_directories(files: DataFrame) -> DataFrame:
    return files.select("relpath", F.lit(False).alias("is_dir")).unionByName(directories(files).withColumn("is_dir", F.lit(True)))


def journals(listing: DataFrame) -> DataFrame:
    """Names of journals among the entries of a folder: no dots, dashes or ``@``, and no administrative ones."""
    name = F.regexp_extract("relpath", "^([^/]+)/", 1)
    return listing.select(name.alias("journal")).where((F.col("journal") != "") & ~F.col("journal").rlike("[.@-]") & ~F.col("journal").isin("logs", "backup", "tmp")).distinct()


def comment_files(listing: DataFrame) -> DataFrame:
    """user, yyyy, mm, rid, tid of paths ``user/yyyy/mm/rid_tid.html``, in order; users with ``@`` are skipped, other paths are errors."""
    shape = r"^([^/]+)/(\d{4})/(\d{2})/(\d+)_(\d+)\.html$"
    part = lambda k: F.regexp_extract("relpath", shape, k)
    user = F.when(F.col("relpath").rlike(shape), part(1)).otherwise(F.raise_error(F.concat(F.lit("no comment file: "), F.col("relpath"))).cast("string"))
    out = listing.select(user.alias("user"), *[part(k).cast("int").alias(c) for k, c in ((2, "yyyy"), (3, "mm"))], part(4).cast("long").alias("rid"), part(5).cast("long").alias("tid"), "relpath")
    return out.where(~F.col("user").startswith("@")).orderBy("user", "yyyy", "mm", "rid", "tid")


def month_files(listing: DataFrame) -> DataFrame:
    """year, month and relpath of paths ``.../yyyy/mm/name``; a month out of range is an error."""
    shape = r"(?:^|/)(\d{4})/(\d{2})/[^/]+$"
    month = F.regexp_extract("relpath", shape, 2).try_cast("int")
    checked = F.when(month.between(1, 12), month).otherwise(F.raise_error(F.concat(F.lit("no month: "), F.col("relpath"))).cast("int"))
    return listing.where(F.col("relpath").rlike(shape)).select(F.regexp_extract("relpath", shape, 1).cast("int").alias("year"), checked.alias("month"), "relpath").orderBy("year", "month", "relpath")


def numeric_order(listing: DataFrame) -> DataFrame:
    """Files with a number as name, in its order; two extensions for one number are an error, other names are dropped."""
    rid = F.regexp_extract("relpath", r"(?:^|/)(\d+)\.[^./]+$", 1)
    rows = listing.withColumn("rid", F.when(rid != "", rid).cast("long")).where("rid is not null")
    from pyspark.sql import Window

    twice = F.count("*").over(Window.partitionBy(F.regexp_extract("relpath", r"^(.*?)[^/]*$", 1), "rid")) > 1
    return rows.withColumn("relpath", F.when(~twice, F.col("relpath")).otherwise(F.raise_error(F.concat(F.lit("ambiguous: "), F.col("relpath"))).cast("string"))).orderBy("rid")


def by_name(listing: DataFrame) -> DataFrame:
    """The first relative path, in order, of each file name: an index by name."""
    return listing.groupBy(F.regexp_extract("relpath", "([^/]+)$", 1).alias("name")).agg(F.min("relpath").alias("relpath"))


def manual_pages(listing: DataFrame) -> DataFrame:
    """rid and page of manual overrides: ``<rid>.html`` is page 1, ``<rid>-page-N.html`` page N."""
    shape = r"(?:^|/)(\d+)(?:-page-(\d+))?\.html$"
    page = F.regexp_extract("relpath", shape, 2)
    return listing.where(F.col("relpath").rlike(shape)).select(F.regexp_extract("relpath", shape, 1).cast("long").alias("rid"), F.when(page == "", 1).otherwise(page.try_cast("int")).alias("page"), "relpath")


def empty_directories(before: DataFrame, files: DataFrame) -> DataFrame:
    """Directories of a listing (relpath) that hold no file at any depth, longest path first: the order to delete them in."""
    return before.select("relpath").join(directories(files), "relpath", "left_anti").orderBy(F.length("relpath").desc(), "relpath")


# ------------------------------------------------------------------------- sinks


def store_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (relpath, content) below a folder: relpath, stored path and state of each.

    A file is written under a name of its own and then renamed.  Equal bytes
    are reused; other bytes under the same name go to a name with their digest,
    so a task that runs again finds its own work done.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")

        def same(path: str, content: bytes) -> bool | None:
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                return None
            if info.type == fs.FileType.Directory or info.size != len(content):
                return False
            with system.open_input_stream(path) as source:
                return source.read() == content

        for batch in batches:
            out = []
            for relpath, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, state = relpath, "new"
                known = same(f"{top}/{place}", content)
                if known is False:
                    stem, dot, ext = relpath.rpartition(".")
                    place = f"{stem if dot else relpath}_{hashlib.md5(content).hexdigest()}{dot}{ext if dot else ''}"
                    known, state = same(f"{top}/{place}", content), "renamed"
                if known:
                    out.append((relpath, place, "reused"))
                    continue
                system.create_dir(f"{top}/{place}".rpartition("/")[0], recursive=True)
                draft = f"{top}/{place}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(draft) as sink:
                    sink.write(content)
                system.move(draft, f"{top}/{place}")
                out.append((relpath, place, state))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["relpath", "stored", "state"])

    # one task for a name in lower case: two rows of one name do not race
    return files.select("relpath", "content").repartition(F.lower("relpath")).mapInArrow(run, "relpath string, stored string, state string")
