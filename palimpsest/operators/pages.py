"""Passes over parsed journal pages (columns ``nodes`` of ``operators.html``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import codec, redirects, urls
from palimpsest.operators import html

#: What is boilerplate, by class, in the two page styles.
CLASSIC_JUNK = ("b-myplayer", "lj-like", "entry-linkbar", "controlstrip", "sidebar", "footer")
NEW_JUNK = ("aentry-post__adv", "header", "s-header", "mdspost-aside", "aentry-comments", "footer", "related-entries")
THREAD_JUNK = ("comments", "b-reactions", "related", "reply-form", "comment-form")


def style(tree: Column) -> Column:
    """classic or new-style by the classes of a page; an error where both show, null where none does."""
    new = F.exists(tree, lambda n: F.array_contains(html.classes(n), "aentry-post__text"))
    classic = F.exists(tree, lambda n: F.array_contains(html.classes(n), "b-singlepost-body"))
    return F.when(new & classic, F.raise_error(F.lit("two page styles")).cast("string")).when(new, "new-style").when(classic, "classic")


def without_classes(tree: Column, names: tuple[str, ...]) -> Column:
    """Nodes without the elements that have one of the classes."""
    wanted = F.array(*map(F.lit, names))
    return html.without(tree, html.elements(tree, None, lambda n: F.arrays_overlap(html.classes(n), wanted)))


def clean(tree: Column) -> Column:
    """Boilerplate of either style removed, scripts too."""
    bare = without_classes(tree, CLASSIC_JUNK + NEW_JUNK)
    return html.without(bare, html.elements(bare, "script"))


def _path_to_articles(tree: list[dict]) -> list[dict]:
    parent = {n["pos"]: n["parent"] for n in tree}
    articles = {n["pos"] for n in tree if n["tag"] == "article"}
    if not articles:
        return tree
    path: set[int] = set()
    for at in articles:
        while at > 0:
            at = parent[at]
            path.add(at)
    gone: set[int] = set()
    inside = set(articles)
    for n in tree:
        if n["parent"] in inside:
            inside.add(n["pos"])
        if n["parent"] in gone or n["tag"] in ("table", "tr", "td") and n["pos"] not in path | inside:
            gone.add(n["pos"])
    return [n for n in tree if n["pos"] not in gone]


def article_only(parsed: DataFrame) -> DataFrame:
    """Tables, rows and cells that are neither on the path to an article nor inside one removed; a page without one stays."""
    return html.transformed(parsed, _path_to_articles)


def without_threads(tree: Column) -> Column:
    return without_classes(tree, THREAD_JUNK)


def without_heights(tree: Column) -> Column:
    """Numeric heights of cells dropped."""
    return html.set_attr(tree, "height", lambda n: F.when(n["tag"].isin("td", "tr", "table") & html.attr(n, "height").rlike("^[0-9]+(px)?$"), ""))


def moved(tree: Column, old: str, new: str) -> Column:
    """Link prefixes of a page that moves to another depth."""
    for name in ("href", "src"):
        tree = html.set_attr(tree, name, lambda n, name=name: F.when(html.attr(n, name).startswith(old), F.concat(F.lit(new), F.substr(html.attr(n, name), F.lit(len(old) + 1)))))
    return tree


#: Where links stand.
LINK_PLACES = (("a", "href"), ("img", "src"), ("link", "href"), ("script", "src"), ("iframe", "src"), ("area", "href"), ("form", "action"), ("source", "src"), ("video", "src"), ("audio", "src"))


def with_scheme(tree: Column, site: str) -> Column:
    """Protocol-relative and root-relative links made absolute, wherever links stand."""
    for tag, name in LINK_PLACES:
        value = lambda n, name=name: html.attr(n, name)
        new = lambda n, tag=tag, value=value: F.when(n["tag"] != tag, None).when(value(n).startswith("//"), F.concat(F.lit("https:"), value(n))).when(value(n).startswith("/"), F.concat(F.lit(site), value(n)))
        tree = html.set_attr(tree, name, new)
    return tree


def resolved(href: Column, base: Column) -> Column:
    """An attribute against the page's address; absolute ones, anchors and queries stay."""
    return F.when(href.rlike("^[#?]|^(?i)[a-z][a-z0-9+.-]*:"), href).otherwise(redirects.columns.resolve(base, href))


def normal_link(href: Column, base: Column) -> Column:
    """The chain of a stored link: trimmed, old escapes and CP1251 repaired, resolved, unwrapped."""
    bare = codec.columns.repair_cp1251(codec.columns.repair_old_escapes(F.trim(href)))
    return redirects.columns.unwrap_encoded(resolved(bare, base))


def comment_presence(said: Column) -> Column:
    """Whether a count text tells of comments; null for text that tells nothing."""
    low = F.lower(F.trim(said))
    n = F.regexp_extract(low, "^([0-9]+) comments?$", 1)
    return F.when(n != "", n.cast("long") > 0).when(low.isin("leave a comment", "no comments", "post a new comment"), False).when(low.rlike("comments? (disabled|locked)|are disabled"), False)


def comment_pages(tree: Column) -> Column:
    """The greatest ``page=`` in the page's links; 1 without one."""
    pages = F.transform(html.links(tree), lambda h: F.regexp_extract(h, "[?&]page=([0-9]+)", 1).try_cast("int"))
    return F.coalesce(F.array_max(pages), F.lit(1))


def is_repost(tree: Column) -> Column:
    """The body is the repost block and blanks, and there are no comments."""
    block = html.with_class(tree, "repost")
    rest = html.without(tree, block)
    text = F.array_join(F.transform(F.filter(rest, lambda n: n["kind"] == "text"), lambda n: n["text"]), "")
    return (F.size(block) == 1) & (F.size(html.with_class(tree, "comment")) == 0) & text.rlike("^[\\s ]*$")


def background(style_text: Column) -> Column:
    """The address of an inline background; null without one."""
    found = F.regexp_extract(style_text, "(?i)background(?:-image)?\\s*:[^;]*url\\(\\s*['\"]?([^'\")]+)", 1)
    return F.when(found != "", F.trim(found))


def without_archive_banner(source: Column) -> Column:
    """Banner and rewritten addresses of an archive removed, and a charset declared."""
    out = F.regexp_replace(source, "(?s)<!-- BEGIN WAYBACK TOOLBAR INSERT -->.*?<!-- END WAYBACK TOOLBAR INSERT -->", "")
    out = F.regexp_replace(out, "(?:https?:)?(?://web\\.archive\\.org)?/web/[0-9]{14}[a-z_]*/(https?://)", "$1")
    meta = '<meta charset="utf-8">'
    return F.when(out.rlike("(?i)<meta[^>]*charset"), out).otherwise(F.regexp_replace(out, "(?i)(<head[^>]*>)", f"$1{meta}"))


def wall_posts(tree: Column, prefix: str) -> Column:
    """Elements whose id begins with ``prefix``."""
    return html.elements(tree, None, lambda n: html.attr(n, "id").startswith(prefix))


def proxied_picture(url: Column) -> Column:
    """The address that a picture proxy stands for."""
    return F.regexp_replace(url, "^https?://p[.]dreamwidth[.]org/[^/]+/[^/]+/", "https://")


def pager(said: Column) -> Column:
    """Pages of ``1/N`` text; null for other text."""
    return F.regexp_extract(said, "^\\s*[0-9]+\\s*/\\s*([0-9]+)\\s*$", 1).try_cast("int")


#: Parameters and places that name an embedded video.
_VIDEO_IDS = (("youtube", r"(?:youtube(?:-nocookie)?\.com/(?:embed/|v/|watch\?v=)|youtu\.be/)([A-Za-z0-9_-]{6,})"), ("vimeo", r"vimeo\.com/(?:video/)?([0-9]+)"), ("rutube", r"rutube\.ru/(?:play/embed|video)/([0-9a-f]+)"), ("vk", r"vk\.com/video_ext\.php\?(?:.*&)?oid=(-?[0-9]+)"))


def embed(src: Column) -> Column:
    """source, id and url of an embedded frame: parameters first, then places in the address; null if not recognised."""
    source, vid = urls.query_parameter(src, "source"), urls.query_parameter(src, "vid")
    name, found = F.when((source != "") & (vid != ""), source), F.when((source != "") & (vid != ""), vid)
    for kind, pattern in _VIDEO_IDS:
        own = F.regexp_extract(src, pattern, 1)
        name, found = F.coalesce(name, F.when(own != "", kind)), F.coalesce(found, F.when(own != "", own))
    return F.when(found.isNotNull(), F.struct(name.alias("source"), found.alias("id"), src.alias("url")))


def frames(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Embedded frames of pages, with what they show."""
    found = parsed.select(*keys, F.explode(html.elements(F.col("nodes"), "iframe")).alias("n"))
    src = html.attr(F.col("n"), "src")
    return found.select(*keys, F.col("n.pos").alias("pos"), src.alias("src"), embed(src).alias("target"))


# ------------------------------------------------------- other styles and pagers


def _under(tree: list[dict], tops: set[int]) -> set[int]:
    found = set(tops)
    for n in tree:
        if n["parent"] in found:
            found.add(n["pos"])
    return found


def _above(tree: list[dict], at: int) -> list[int]:
    parent, path = {n["pos"]: n["parent"] for n in tree}, []
    while at > 0:
        at = parent[at]
        path.append(at)
    return path


def _one(found: list[dict], what: str) -> int:
    if len(found) != 1:
        raise ValueError(f"{what}: {len(found)}")
    return found[0]["pos"]


def _value(n: dict, name: str) -> str | None:
    return dict(n["attrs"] or {}).get(name)


#: The main block of a page in this style, and what is removed by id, class and pair of classes.
PRIMARY = "primary"
PRIMARY_IDS = ("header", "footer", "secondary", "tertiary", "lj_controlstrip")
PRIMARY_CLASSES = ({"footer"}, {"bottomcomment"}, {"comment-pages", "toppages"}, {"comment-pages", "bottompages"})


def _primary_only(tree: list[dict]) -> list[dict]:
    divs = [n for n in tree if n["tag"] == "div"]
    main = _one([n for n in divs if _value(n, "id") == PRIMARY], "primary blocks")
    near = _under(tree, {main}) | set(_above(tree, main))
    gone = {n["pos"] for n in tree if n["tag"] in ("script", "noscript")}
    for n in divs:
        own = set((_value(n, "class") or "").split())
        if n["pos"] not in near or _value(n, "id") in PRIMARY_IDS or any(names <= own for names in PRIMARY_CLASSES):
            gone.add(n["pos"])
    gone = _under(tree, gone)
    return [n for n in tree if n["pos"] not in gone]


def primary_only(parsed: DataFrame) -> DataFrame:
    """Pages with a ``primary`` block: other blocks, pagers and scripts removed; none or two of them is an error."""
    return html.transformed(parsed, _primary_only)


def _around_anchor(tree: list[dict]) -> list[dict]:
    marks = [n for n in tree if n["tag"] == "img" and _value(n, "alt") is None and (_value(n, "width"), _value(n, "height")) == ("1", "3")]
    anchor = _one(marks, "article anchors")
    path = _above(tree, anchor)
    tags = {n["pos"]: n["tag"] for n in tree}
    cell = next((at for at in path if tags[at] == "td"), None)
    near = set(path) | (_under(tree, {cell}) if cell is not None else set())
    gone = _under(tree, {n["pos"] for n in tree if n["tag"] in ("script", "noscript") or n["tag"] in ("td", "tr", "table") and n["pos"] not in near})
    return [n for n in tree if n["pos"] not in gone]


def around_anchor(parsed: DataFrame) -> DataFrame:
    """Pages whose article has a 1 x 3 picture in it: only the tables around and inside its cell stay."""
    return html.transformed(parsed, _around_anchor)


def _spaced(said: Column) -> Column:
    return F.trim(F.regexp_replace(said, "[\\s ]+", " "))


def _without_notice(tree: list[dict]) -> list[dict]:
    gone: set[int] = set()
    for n in tree:
        if n["tag"] == "p" and "b-bubble-alert" in (_value(n, "class") or "").replace(",", " ").split():
            below = _under(tree, {n["pos"]})
            said = " ".join("".join(x["text"] for x in tree if x["kind"] == "text" and x["pos"] in below).split())
            if "This journal has been placed in memorial status" in said:
                gone |= below
    return [n for n in tree if n["pos"] not in gone]


def without_memorial_notice(parsed: DataFrame) -> DataFrame:
    """Pages without the notice that a journal is kept as a memorial."""
    return html.transformed(parsed, _without_notice)


def album_pages(tree: Column) -> Column:
    """Number of pages by the pagers of an album's first page: 1 without one, an error unless all say the same ``1/N``."""
    said = F.transform(html.with_class(tree, "b-pics-pager", "p"), lambda n: _spaced(html.text_of(tree, n["pos"])))
    counts = F.array_distinct(F.transform(said, lambda t: F.regexp_extract(t, "^1/([1-9][0-9]{0,8})$", 1)))
    sound = (F.size(counts) == 1) & ~F.array_contains(counts, "")
    return F.when(F.size(counts) == 0, 1).when(sound, F.try_element_at(counts, F.lit(1)).try_cast("int")).otherwise(F.raise_error(F.lit("pagers differ or have another form")).cast("int"))


def album_next(tree: Column) -> Column:
    """Address of an album's next page; null without one, an error if there are several or it is not absolute."""
    hrefs = F.array_distinct(F.transform(html.with_class(tree, "b-pics-pager-next", "a"), lambda n: F.coalesce(html.attr(n, "href"), F.lit(""))))
    first = F.try_element_at(hrefs, F.lit(1))
    return F.when(F.size(hrefs) == 0, None).when((F.size(hrefs) == 1) & first.rlike("(?i)^https?://"), first).otherwise(F.raise_error(F.lit("next pages differ or have another form")).cast("string"))


def album_frames(parsed: DataFrame) -> DataFrame:
    """Frames of albums (album, page, nodes) in the order of the merged page: the first, then the last down to the second.

    Each later frame goes right after the first one.  ``text`` is what the frame says without pagers;
    an album whose pages are not all there is an error.
    """
    nodes = F.col("nodes")
    frame = F.element_at(html.only(html.with_class(nodes, "b-pics-inner", "div")), 1)
    junk = F.concat(html.with_class(nodes, "b-pics-pager", "p"), F.when(F.col("page") > 1, html.with_class(nodes, "b-pics-bar", "div")).otherwise(F.filter(nodes, lambda n: F.lit(False))))
    said = F.array_join(F.transform(F.filter(html.without(html.subtree(nodes, frame["pos"]), junk), lambda n: n["kind"] == "text"), lambda n: n["text"]), "")
    rows = parsed.select("album", "page", said.alias("text"), F.when(F.col("page") == 1, album_pages(nodes)).alias("n"))
    total = rows.groupBy("album").agg(F.max("n").alias("n"), F.countDistinct("page").alias("have"), F.max("page").alias("last"))
    whole = F.when((F.col("n") == F.col("have")) & (F.col("n") == F.col("last")), F.col("n")).otherwise(F.raise_error(F.lit("pages of an album are missing")).cast("int"))
    place = F.when(F.col("page") == 1, 1).otherwise(F.col("of") + 2 - F.col("page"))
    return rows.drop("n").join(total.select("album", whole.alias("of")), "album").select("album", place.alias("place"), "page", "text")
