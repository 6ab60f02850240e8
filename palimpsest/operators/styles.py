"""Style texts: external references, their local forms, depth, and cycles of imports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import redirects
from palimpsest.functions.vectors import column_function
from palimpsest.shared import settled

_REFERENCE = re.compile(r"""/\*.*?\*/|@import\s+(?:url\(\s*)?(["']?)([^"')\s;]+)\1\s*\)?|url\(\s*(["']?)(.*?)\3\s*\)""", re.S | re.I)


def references(css: str) -> list[str]:
    """Addresses of ``url()`` and ``@import``, in order; comments and ``data:`` do not count."""
    found = (m[2] or m[4] for m in _REFERENCE.finditer(css))
    return [repaired(x) for x in found if x and not x.strip().lower().startswith("data:")]


def rewritten(css: str, change: Callable[[str], str | None]) -> str:
    """The text with each address replaced for which ``change`` gives one."""

    def one(m: re.Match) -> str:
        k = 2 if m[2] else 4
        new = change(repaired(m[k])) if m[k] else None
        return m[0] if new is None else m[0][: m.start(k) - m.start()] + new + m[0][m.end(k) - m.start() :]

    return _REFERENCE.sub(one, css)


def repaired(url: str) -> str:
    """Quotes around, hosts glued to the scheme, protocol-relative addresses."""
    url = url.strip().strip("\"'").strip()
    if m := re.match("(https?):?/?/?(?=[A-Za-z0-9-]+[.])", url, re.I):
        return f"{m[1].lower()}://{url[m.end() :]}"
    return "https:" + url if url.startswith("//") else url


def external(css: str) -> list[str]:
    """Addresses that are still absolute."""
    return [x for x in references(css) if re.match("(https?:)?//", x, re.I)]


def localised(css: str, mapping: dict[str, str]) -> str:
    """Addresses of the mapping as local paths."""
    return rewritten(css, mapping.get)


def shifted(css: str, levels: int) -> str:
    """Local links of a style text that moves ``levels`` directories down (up if negative)."""

    def change(link: str) -> str | None:
        if re.match("([a-z]+:|//|/|#)", link, re.I):
            return None
        return "../" * levels + link if levels > 0 else re.sub(rf"^(\.\./){{0,{-levels}}}", "", link)

    return rewritten(css, change)


def decision(url: Column, blocked: Column, known: Column) -> Column:
    """What is done with a style resource: none, keep, skip, reuse or fetch."""
    remote = url.rlike("(?i)^(https?:)?//")
    return F.when(F.trim(url) == "", "none").when(url.startswith("data:") | ~remote, "keep").when(blocked, "skip").when(known, "reuse").otherwise("fetch")


def plain_style(style_text: Column) -> Column:
    """An inline style without external references, ``data:`` aside."""
    return ~F.regexp_replace(style_text, "(?i)url\\(\\s*['\"]?data:[^)]*\\)", "").rlike("(?i)url\\(|@import|https?:")


def imports(sheets: DataFrame) -> DataFrame:
    """(src, dst) between style sheets (url, css)."""
    link = F.explode(columns.references("css"))
    return sheets.select(F.col("url").alias("src"), link.alias("link")).select("src", redirects.columns.resolve(F.col("src"), F.col("link")).alias("dst"))


def cycles(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) that are on a cycle or between two: sheets whose localisation must stop.

    Edges into sheets that import nothing, and out of sheets that nothing
    imports, fall away round by round; what stays is cyclic.
    """
    left = settled(edges.distinct())
    while True:
        n = left.count()
        left = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = settled(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        if left.count() == n:
            return left.select("src", "dst")


class columns:
    """The functions above on columns."""

    references = staticmethod(column_function(references, "array<string>"))
    external = staticmethod(column_function(external, "array<string>"))
    localised = staticmethod(column_function(lambda css, pairs: localised(css, dict(pairs))))
    shifted = staticmethod(column_function(shifted))
