"""HTML as a table of nodes: an error-tolerant parser, selectors, changes and output.

``parse`` gives each page an array of nodes in document order.  A node has its
place (``pos``), the place of its parent, its depth, a kind (element, text or
comment), a tag in lower case, attributes and text.  The root is an element
``#root`` at place 0.  Selectors are higher-order functions on that array, so
they stay in the JVM; ``rows`` makes one row for each node.

Tolerated: missing and stray end tags, attributes without quotes or value,
blanks around ``=``, comments, raw text of scripts and styles, implied ends of
paragraphs, list items, cells, rows and options.  Entities are decoded in text
and attributes.  The first of repeated attributes counts.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_DDL = "struct<pos:int,parent:int,depth:int,kind:string,tag:string,attrs:map<string,string>,text:string>"
_NODE = pa.struct([("pos", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

#: Elements without content, and those whose content is text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp".split())
#: An opening tag ends these open ones, up to the nearest of the borders.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
} | dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 hr form pre blockquote article section header footer".split(), ({"p"}, {"table", "td", "th", "div", "article", "section", "blockquote", "li"}))

_MARKUP = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape(double or single or bare))
    return out


def nodes(source: str) -> list[dict]:
    """All nodes of a page in document order."""
    out = [{"pos": 0, "parent": -1, "depth": 0, "kind": "element", "tag": "#root", "attrs": {}, "text": None}]
    stack = [0]

    def add(kind: str, tag: str | None = None, attrs: dict | None = None, text: str | None = None) -> int:
        out.append({"pos": len(out), "parent": stack[-1], "depth": len(stack), "kind": kind, "tag": tag, "attrs": attrs or {}, "text": text})
        return len(out) - 1

    def say(text: str) -> None:
        if text:
            add("text", text=entities.unescape(text))

    at = 0
    while at < len(source):
        m = _MARKUP.search(source, at)
        say(source[at : m.start()] if m else source[at:])
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            add("comment", text=m["comment"])
        elif m["cdata"] is not None:
            add("text", text=m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            for k in range(len(stack) - 1, 0, -1):
                if out[stack[k]]["tag"] == tag:
                    del stack[k:]
                    break
        elif m["tag"]:
            tag = m["tag"].lower()
            ended, borders = _ENDS.get(tag, ((), ()))
            for k in range(len(stack) - 1, 0, -1):
                open_tag = out[stack[k]]["tag"]
                if open_tag in ended:
                    del stack[k:]
                elif open_tag in borders:
                    break
            own = add("element", tag, attributes(m["attrs"]))
            if tag in RAW:
                close = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                stack.append(own)
                text = source[at : close.start() if close else len(source)]
                if text:
                    add("text", text=entities.unescape(text) if tag in ("title", "textarea") else text)
                stack.pop()
                at = close.end() if close else len(source)
            elif tag not in VOID and not m["attrs"].rstrip().endswith("/"):
                stack.append(own)
    return out


def parse(pages: DataFrame, html_col: str = "html", into: str = "nodes") -> DataFrame:
    """The pages with a column of nodes; a null page has null nodes."""

    def tree(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [n | {"attrs": list(n["attrs"].items())} for n in nodes(x)] for x in column.to_pylist()], pa.list_(_NODE))

    tree.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return pages.withColumn(into, F.arrow_udf(tree, f"array<{NODE_DDL}>")(F.col(html_col).cast("string")))


def rows(parsed: DataFrame, keys: list[str], nodes_col: str = "nodes") -> DataFrame:
    """One row for each node."""
    return parsed.select(*keys, F.inline(nodes_col))


# -------------------------------------------------------------------- selectors


def attr(node: Column, name: str) -> Column:
    """Value of an attribute; null where it is missing."""
    return F.try_element_at(node["attrs"], F.lit(name.lower()))


def elements(tree: Column, tag: str | None = None, where: Callable[[Column], Column] | None = None) -> Column:
    """Elements of a tag in any case (of all tags for None) that pass a test."""

    def fits(n: Column) -> Column:
        test = (n["kind"] == "element") & (n["pos"] > 0)
        if tag is not None:
            test &= n["tag"] == tag.lower()
        return F.coalesce(test & where(n), F.lit(False)) if where else test

    return F.filter(tree, fits)


def by_attributes(tree: Column, tag: str, **wanted: str) -> Column:
    """Elements of a tag with one or more attributes of a given value."""

    def fits(n: Column) -> Column:
        test = F.lit(True)
        for name, value in wanted.items():
            test &= attr(n, name.rstrip("_")) == value
        return test

    return elements(tree, tag, fits)


def classes(node: Column, lower: bool = False, separators: str = "[ \\t\\r\\n,]+") -> Column:
    """The classes of a node; a comma separates too, unless ``separators`` say otherwise."""
    listed = F.filter(F.split(F.coalesce(attr(node, "class"), F.lit("")), separators), lambda c: c != "")
    return F.array_distinct(F.transform(listed, F.lower) if lower else listed)


def with_class(tree: Column, name: str, tag: str | None = None) -> Column:
    return elements(tree, tag, lambda n: F.array_contains(classes(n), name))


def with_all_classes(tree: Column, names: list[str], tag: str | None = None) -> Column:
    """Elements that have all the classes; blanks and no-break spaces separate, commas do not."""
    own = lambda n: classes(n, separators="[ \\t\\r\\n ]+")
    return elements(tree, tag, lambda n: F.size(F.array_except(F.array(*map(F.lit, names)), own(n))) == 0)


def comments(tree: Column) -> Column:
    return F.filter(tree, lambda n: n["kind"] == "comment")


def children(tree: Column, pos: Column) -> Column:
    return F.filter(tree, lambda n: n["parent"] == pos)


def subtree(tree: Column, pos: Column) -> Column:
    """A node and all below it: what follows it in order until the depth is no greater."""
    own = F.element_at(tree, pos + 1)
    ends = F.filter(tree, lambda n: (n["pos"] > pos) & (n["depth"] <= own["depth"]))
    last = F.when(F.size(ends) > 0, F.element_at(ends, 1)["pos"]).otherwise(F.size(tree))
    return F.slice(tree, pos + 1, last - pos)


def text_of(tree: Column, pos: Column) -> Column:
    """All text below a node, in order."""
    return F.array_join(F.transform(F.filter(subtree(tree, pos), lambda n: n["kind"] == "text"), lambda n: n["text"]), "")


def links(tree: Column) -> Column:
    """Targets of ``a`` elements in order, without empty ones and pure anchors."""
    found = elements(tree, "a", lambda n: (attr(n, "href") != "") & ~attr(n, "href").startswith("#"))
    return F.transform(found, lambda n: attr(n, "href"))


def only(found: Column, least: int = 1, most: int = 1) -> Column:
    """The elements if their number is in bounds; otherwise an error."""
    message = F.concat(F.lit("elements found: "), F.size(found).cast("string"))
    return F.when(F.size(found).between(least, most), found).otherwise(F.raise_error(message).cast(f"array<{NODE_DDL}>"))


def ancestors(tree: Column, pos: Column) -> Column:
    """Elements above a node, nearest first: those before it, of which each lower one is less deep."""
    above = F.filter(tree, lambda n: (n["pos"] < pos) & (n["kind"] == "element"))
    start = F.struct(F.element_at(tree, pos + 1)["parent"].alias("want"), F.filter(tree, lambda n: F.lit(False)).alias("found"))
    step = lambda t, n: F.when(n["pos"] == t["want"], F.struct(n["parent"].alias("want"), F.concat(t["found"], F.array(n)).alias("found"))).otherwise(t)
    return F.aggregate(F.reverse(above), start, step)["found"]


def inside(tree: Column, pos: Column, tag: str) -> Column:
    return F.exists(ancestors(tree, pos), lambda n: n["tag"] == tag)


# ---------------------------------------------------------------------- changes


def without(tree: Column, gone: Column) -> Column:
    """The nodes but those of ``gone`` and all below them; places stay as they were."""
    start = F.struct(F.lit(1 << 30).alias("limit"), F.filter(tree, lambda n: F.lit(False)).alias("kept"))
    places = F.transform(gone, lambda n: n["pos"])

    def step(t: Column, n: Column) -> Column:
        under = n["depth"] > t["limit"]
        dropped = F.array_contains(places, n["pos"])
        limit = F.when(under, t["limit"]).when(dropped, n["depth"]).otherwise(F.lit(1 << 30))
        return F.struct(limit.alias("limit"), F.when(under | dropped, t["kept"]).otherwise(F.concat(t["kept"], F.array(n))).alias("kept"))

    return F.aggregate(tree, start, step)["kept"]


def without_blank_text(tree: Column) -> Column:
    return F.filter(tree, lambda n: (n["kind"] != "text") | ~n["text"].rlike("^[ \\t\\r\\n ]*$"))


def set_attr(tree: Column, name: str, value: Callable[[Column], Column]) -> Column:
    """An attribute set on each element for which ``value`` is not null; an element loses it for the empty text."""
    kept = lambda n: F.map_filter(n["attrs"], lambda k, _: k != name)

    def one(n: Column) -> Column:
        new = F.when(n["kind"] == "element", value(n))
        attrs = F.when(new.isNull(), n["attrs"]).when(new == "", kept(n)).otherwise(F.map_concat(kept(n), F.map_from_arrays(F.array(F.lit(name)), F.array(F.coalesce(new, F.lit(""))))))
        return F.struct(*[n[c].alias(c) for c in ("pos", "parent", "depth", "kind", "tag")], attrs.alias("attrs"), n["text"].alias("text"))

    return F.transform(tree, one)


def render(tree: list[dict]) -> str:
    """HTML of nodes in document order."""
    out: list[str] = []
    open_: list[tuple[int, str]] = []
    for n in tree:
        while open_ and open_[-1][0] >= n["depth"]:
            out.append(f"</{open_.pop()[1]}>")
        if n["kind"] == "text":
            out.append(n["text"] if open_ and open_[-1][1] in ("script", "style", "noscript", "xmp") else entities.escape(n["text"], quote=False))
        elif n["kind"] == "comment":
            out.append(f"<!--{n['text']}-->")
        elif n["pos"]:
            out.append("<" + n["tag"] + "".join(f' {k}="{entities.escape(v)}"' for k, v in dict(n["attrs"]).items()) + ">")
            if n["tag"] not in VOID:
                open_.append((n["depth"], n["tag"]))
    return "".join(out) + "".join(f"</{tag}>" for _, tag in reversed(open_))


def serialize(parsed: DataFrame, nodes_col: str = "nodes", into: str = "html") -> DataFrame:
    """Adds the HTML of the nodes."""

    def write(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render(x) for x in column.to_pylist()], pa.string())

    write.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return parsed.withColumn(into, F.arrow_udf(write, "string")(nodes_col))


def transformed(parsed: DataFrame, change: Callable[[list[dict]], list[dict]], nodes_col: str = "nodes") -> DataFrame:
    """Pages with ``change`` applied to their nodes, for changes that need the whole tree at once."""

    def run(column: pa.Array) -> pa.Array:
        pages = ([n | {"attrs": dict(n["attrs"])} for n in x] if x is not None else None for x in column.to_pylist())
        return pa.array([None if x is None else [n | {"attrs": list(n["attrs"].items())} for n in change(x)] for x in pages], pa.list_(_NODE))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return parsed.withColumn(nodes_col, F.arrow_udf(run, f"array<{NODE_DDL}>")(nodes_col))


def comparable(tree: Column) -> Column:
    """Nodes for a comparison that does not look at pictures: each is a mark, and login tokens go."""
    plain = set_attr(tree, "data-auth-token", lambda n: F.when(F.map_contains_key(n["attrs"], "data-auth-token"), ""))
    mark = lambda n: F.struct(n["pos"].alias("pos"), n["parent"].alias("parent"), n["depth"].alias("depth"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag"), F.map_filter(n["attrs"], lambda k, v: F.lit(False)).alias("attrs"), F.lit("<deleted-img>").alias("text"))
    return F.transform(plain, lambda n: F.when(F.coalesce(n["tag"] == "img", F.lit(False)), mark(n)).otherwise(n))


def link_facts(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """Link occurrences: the keys, pos (its place among the page's elements of the tag with that attribute), tag, attr, href and original_href.

    ``a.href`` and ``img.src``, without empty ones and pure anchors.  Each page
    is parsed once; only links leave Python.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for row, source in enumerate(batch.column(len(keys)).to_pylist()):
                place = {"a": 0, "img": 0}
                for n in nodes(source or ""):
                    name = {"a": "href", "img": "src"}.get(n["tag"])
                    value = n["attrs"].get(name) if name else None
                    if value is None:
                        continue
                    if value and not value.startswith("#"):
                        found.append((row, place[n["tag"]], n["tag"], name, value, n["attrs"].get(f"original-{name}")))
                    place[n["tag"]] += 1
            rows, *columns = list(zip(*found)) or [()] * 6
            own = [batch.column(k).take(pa.array(rows, pa.int32())) for k in range(len(keys))]
            own += [pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.string()] * 4])]
            yield pa.RecordBatch.from_arrays(own, [*keys, "pos", "tag", "attr", "href", "original_href"])

    kinds = "".join(f"{k} {pages.schema[k].dataType.simpleString()}, " for k in keys)
    return pages.select(*keys, F.col(html_col).cast("string")).mapInArrow(run, f"{kinds}pos int, tag string, attr string, href string, original_href string")
