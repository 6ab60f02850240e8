"""Comment threads: JSON rows, checks, trees, merges and depth-first order.

A thread table has one row for each comment: page_id, thread, parent, level,
type, loaded, uname, ctime, subject, article, leafclass.  The tree is kept as
an adjacency list; depth-first order comes from paths that are built level by
level with joins, and the number of levels bounds the number of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTS = ("type", "thread", "parent", "thread_url", "uname", "dname", "ctime", "userpic", "subject", "article", "leafclass")
#: Shown where a comment names no author or picture.
NO_NAME = "Anonymous"
NO_PICTURE = "https://l-stat.livejournal.net/img/userpics/userpic-anonymous.png?v=15821"
LEAVES = ("deleted", "screened", "suspended", "spammed")


def json_text(json: Column, path: str) -> Column:
    """A JSON text or whole number as text; null if missing, an error for any other kind."""
    found = F.try_variant_get(json, path, "variant")
    kind = F.schema_of_variant(found)
    value = F.variant_get(found, "$", "string")
    return F.when(found.isNull() | F.is_variant_null(found), None).when(kind.isin("STRING", "BIGINT"), value).otherwise(F.raise_error(F.concat(F.lit(f"wrong kind of value at {path}: "), kind)))


def json_flag(json: Column, path: str) -> Column:
    """0 and 1 as a boolean; an error for other values."""
    text = json_text(json, path)
    return F.when(text.isNull(), None).when(text == "0", False).when(text == "1", True).otherwise(F.raise_error(F.concat(F.lit(f"no flag at {path}: "), text)))


def from_json(pages: DataFrame, json_col: str = "json", shift: Column | None = None) -> DataFrame:
    """Comments of ``{"comments": [...]}``, one row each; ``shift`` re-bases the levels of an expansion."""
    listed = F.variant_get(F.parse_json(json_col), "$.comments", "array<variant>")
    rows = pages.select("page_id", *([shift.alias("_shift")] if shift is not None else []), F.posexplode(listed).alias("pos", "c"))
    c = F.col("c")
    out = rows.select("page_id", "pos", *[json_text(c, f"$.{k}").alias(k) for k in TEXTS], json_text(c, "$.level").cast("int").alias("level"), *[json_flag(c, f"$.{k}").alias(k) for k in ("loaded", "shown", "collapsed")], *(["_shift"] if shift is not None else []))
    # parent "0" is none, and the address of a thread names it
    named = F.regexp_extract("thread_url", "[?]thread=([0-9]+)#t([0-9]+)$", 1)
    out = out.withColumn("parent", F.when(F.col("parent") != "0", F.col("parent"))).withColumn("thread", F.coalesce("thread", F.when(named != "", named)))
    return out.withColumn("level", F.col("level") + F.col("_shift")).drop("_shift") if shift is not None else out


def embedded_json(source: Column) -> Column:
    """The JSON between ``Site.page = {`` and ``};`` of a script; null without one, an error with two."""
    found = F.regexp_extract_all(source, F.lit(r"(?s)Site\.page = (\{.*?\});"), F.lit(1))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).when(F.size(found) > 1, F.raise_error(F.lit("several comment blocks")).cast("string"))


def is_more() -> Column:
    return F.coalesce(F.col("type") == "more", F.lit(False))


def is_placeholder() -> Column:
    return F.col("thread").isNull() & F.col("uname").isNull() & F.col("ctime").isNull() & F.col("loaded").isNull()


def leaf(kind: str) -> Column:
    return F.coalesce(F.col("leafclass") == kind, F.lit(False))


def problem() -> Column:
    """What is wrong with a row by itself; null if nothing is."""
    hidden = leaf("deleted") | leaf("screened") | leaf("spammed")
    return (
        F.when(F.col("type").isNotNull() & ~is_more(), "unknown type")
        .when(is_more() & F.col("parent").isNull(), "more without parent")
        .when(~is_more() & F.col("thread").isNull(), "no thread")
        .when(F.coalesce(F.col("level"), F.lit(0)) <= 0, "no level")
        .when((F.col("level") == 1) & F.col("parent").isNotNull(), "top level with parent")
        .when((F.col("level") == 1) & ~is_more() & ~F.coalesce(F.col("loaded"), F.lit(False)) & ~hidden, "top level not loaded")
    )


def should_load(expand: Column | None = None) -> Column:
    """Whether a comment has to be fetched: marked for expansion, or neither deleted nor loaded."""
    own = ~leaf("deleted") & ~F.coalesce(F.col("loaded"), F.lit(False))
    return own if expand is None else expand | own


def tree(comments: DataFrame) -> DataFrame:
    """Comments with their parent's level and a violation: missing parent, level off, duplicate thread; null if sound.

    ``more`` rows and placeholders are no nodes; ``expand`` says that a ``more`` row stands below.
    """
    more = comments.where(is_more()).select("page_id", F.col("parent").alias("thread")).distinct().withColumn("expand", F.lit(True))
    own = comments.where(~is_more() & ~is_placeholder())
    counts = own.groupBy("page_id", "thread").agg(F.count("*").alias("_n"), F.min("level").alias("parent_level"))
    above = counts.select("page_id", F.col("thread").alias("parent"), "parent_level")
    out = own.join(counts.drop("parent_level"), ["page_id", "thread"], "left").join(above, ["page_id", "parent"], "left").join(more, ["page_id", "thread"], "left")
    wrong = (
        F.when(F.col("_n") > 1, "duplicate thread")
        .when((F.col("level") > 1) & F.col("parent_level").isNull(), "missing parent")
        .when((F.col("level") > 1) & (F.col("level") != F.col("parent_level") + 1), "level off")
    )
    return out.withColumn("violation", wrong).withColumn("expand", F.coalesce("expand", F.lit(False))).drop("_n")


def in_order(comments: DataFrame, levels: int = 64) -> DataFrame:
    """Depth-first order: ``place`` of each comment on its page, siblings in order of ``pos``.

    A path of positions is handed down one level at a time; comments deeper
    than ``levels`` are an error.
    """
    own = comments.where(~is_more() & ~is_placeholder()).select("page_id", "thread", "parent", "level", "pos")
    deepest = own.agg(F.max("level")).first()[0] or 0
    if deepest > levels:
        raise ValueError(f"{deepest} levels")
    step = F.lpad(F.col("pos").cast("string"), 10, "0")
    known = out = own.where("level = 1").withColumn("path", step)
    for level in range(2, deepest + 1):
        above = known.select("page_id", F.col("thread").alias("parent"), F.col("path").alias("_above"))
        known = own.where(F.col("level") == level).join(above, ["page_id", "parent"]).withColumn("path", F.concat("_above", F.lit("/"), step)).select(*out.columns)
        out = out.unionByName(known)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("page_id").orderBy("path"))
    return out.select("page_id", "thread", "level", place.cast("long").alias("place"), F.concat((30 * (F.col("level") - 1)).cast("string"), F.lit("px")).alias("indent"))


def first_to_load(comments: DataFrame) -> DataFrame:
    """On each page the first comment in depth-first order that has to be fetched: the next request."""
    wanted = tree(comments).where(should_load(F.col("expand"))).select("page_id", "thread")
    return in_order(comments).join(wanted, ["page_id", "thread"]).groupBy("page_id").agg(F.min_by("thread", "place").alias("thread"))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def merge(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Known comments after an expansion: matched rows take what they lack, new rows join below a known parent.

    ``conflict`` names a field in which two loaded rows differ; ``violation`` a new row without a known parent.
    """
    fields = ["parent", "uname", "ctime", "subject", "article", "leafclass"]
    keys = ["page_id", "thread"]
    old = known.where(~is_more() & ~is_placeholder()).select(*keys, "level", "loaded", *fields)
    new = fresh.where(~is_more() & ~is_placeholder()).select(*keys, F.col("level").alias("n_level"), F.col("loaded").alias("n_loaded"), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = old.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), keys, "full")
    was, now = F.coalesce("loaded", F.lit(False)), F.coalesce("n_loaded", F.lit(False))
    # the side that is loaded has the say; blank fields are filled from the other one
    pick = lambda c: F.when(now & ~was & ~_blank(F.col(f"n_{c}")), F.col(f"n_{c}")).when(_blank(F.col(c)), F.col(f"n_{c}")).otherwise(F.col(c))
    differs = lambda c: was & now & ~_blank(F.col(c)) & ~_blank(F.col(f"n_{c}")) & (F.col(c) != F.col(f"n_{c}"))
    conflict = F.coalesce(*[F.when(differs(c), c) for c in ("parent", "uname", "ctime", "subject", "article")], F.when(F.col("level") != F.col("n_level"), "level"))
    merged = both.select(*keys, F.coalesce("level", "n_level").alias("level"), (was | now).alias("loaded"), *[pick(c).alias(c) for c in fields], conflict.alias("conflict"), F.col("_old").isNull().alias("added"))
    above = merged.select("page_id", F.col("thread").alias("parent"), F.lit(True).alias("_known"))
    orphan = F.when(F.col("added") & (F.col("level") == 1), "unexpected top level").when(F.col("added") & F.col("_known").isNull(), "missing parent")
    return merged.join(above, ["page_id", "parent"], "left").withColumn("violation", orphan).drop("_known")


def rendered(comments: DataFrame) -> DataFrame:
    """One line of HTML for each comment by state, anonymity and subject, indented by its level."""
    name = F.coalesce("uname", F.lit(NO_NAME))
    state = F.coalesce(*[F.when(leaf(k), k) for k in LEAVES], F.when(~F.coalesce(F.col("loaded"), F.lit(False)), "not loaded"))
    head = F.concat(F.lit("<b>"), name, F.lit("</b>"), F.when(F.col("subject").isNull(), "").otherwise(F.concat(F.lit(" <i>"), F.col("subject"), F.lit("</i>"))))
    body = F.when(state.isNotNull(), F.concat(F.lit("("), state, F.lit(")"))).otherwise(F.concat(head, F.lit(": "), F.coalesce("article", F.lit(""))))
    indent = (30 * (F.col("level") - 1)).cast("string")
    return comments.where(~is_more() & ~is_placeholder()).select("page_id", "thread", F.concat(F.lit('<div style="margin-left: '), indent, F.lit('px">'), body, F.lit("</div>")).alias("html"))


def expanded(comments: DataFrame, responses: DataFrame, rounds: int = 1000) -> DataFrame:
    """Threads after all their expansions: page_id, thread, parent, level, loaded, uname, article, state.

    ``responses``: page_id, ``request`` (the thread that was asked for) and the columns of a thread table.
    In each round every page that still has a comment to load takes the response to its first one; a page
    whose request has no response stays as it is (``state`` is ``incomplete``).  A comment that was asked
    for is not asked for again.  Rounds are bounded by the longest chain of requests of one page.
    """
    from palimpsest.shared import settled

    columns = ["page_id", "pos", "thread", "parent", "level", "type", "loaded", "uname", "ctime", "subject", "article", "leafclass"]
    known = settled(comments.select(*columns).withColumn("pos", F.col("pos").cast("long")))
    asked = settled(known.select("page_id", F.col("thread").alias("asked")).limit(0))
    stuck = settled(known.select("page_id").limit(0))
    answers = responses.select(F.col("request").alias("thread"), *[F.col(c).alias(f"_{c}") for c in columns if c != "page_id"], "page_id")
    for step in range(1, rounds + 1):
        wanted = tree(known).where(should_load(F.col("expand"))).select("page_id", "thread")
        left = wanted.join(asked.withColumnRenamed("asked", "thread"), ["page_id", "thread"], "left_anti").join(stuck, "page_id", "left_anti")
        request = settled(in_order(known).join(left, ["page_id", "thread"]).groupBy("page_id").agg(F.min_by("thread", "place").alias("thread")))
        if request.isEmpty():
            break
        got = settled(request.join(answers, ["page_id", "thread"]))
        fresh = got.select("page_id", *[F.col(f"_{c}").alias(c) for c in columns if c != "page_id"])
        stuck = settled(stuck.unionByName(request.join(got.select("page_id").distinct(), "page_id", "left_anti").select("page_id")))
        done = request.join(stuck, "page_id", "left_anti")
        asked = settled(asked.unionByName(done.select("page_id", F.col("thread").alias("asked"))))
        # a new row comes after all rows known so far; rows that say "more" below the loaded comment are used up
        place = fresh.where(~is_more()).groupBy("page_id", "thread").agg(F.min("pos").alias("_p"))
        before = known.where(~is_more()).groupBy("page_id", "thread").agg(F.min("pos").alias("_q"))
        merged = merge(known, fresh)
        bad = F.when(F.col("violation").isNotNull(), F.raise_error(F.concat(F.col("violation"), F.lit(" "), F.col("thread"))).cast("long"))
        own = merged.join(before, ["page_id", "thread"], "left").join(place, ["page_id", "thread"], "left")
        own = own.withColumn("pos", F.coalesce(bad, F.col("_q"), F.lit(step) * F.lit(1_000_000) + F.col("_p"))).withColumn("type", F.lit(None).cast("string")).select(*columns)
        used = done.select("page_id", F.col("thread").alias("parent"))
        more = known.where(is_more()).join(used, ["page_id", "parent"], "left_anti").unionByName(fresh.where(is_more()).withColumn("pos", F.col("pos").cast("long")).join(used, ["page_id", "parent"], "left_anti"), allowMissingColumns=True)
        known = settled(own.unionByName(more.select(*columns)))
    else:
        raise ValueError(f"more than {rounds} expansions of one page")
    return known.where(~is_more() & ~is_placeholder()).join(stuck.withColumn("state", F.lit("incomplete")), "page_id", "left").withColumn("state", F.coalesce("state", F.lit("complete"))).select("page_id", "thread", "parent", "level", "loaded", "uname", "article", "state")
