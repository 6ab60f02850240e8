"""Column functions on text, file names and dates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.vectors import column_function


def trim_nbsp(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "^[ \\t\\n\\r\u00a0]+", ""), "[ \\t\\n\\r\u00a0]+$", "")


def despace(s: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(s, "[ \\t\\n\\r\u00a0]+", " "))


def occurrences(s: Column, part: str) -> Column:
    """How often ``part`` occurs without overlap."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("long")


def between(s: Column, left: str, right: str) -> Column:
    """Text from the first ``left`` to the next ``right``; null where either is missing."""
    rest = F.when(s.contains(left), F.substr(s, F.instr(s, left) + len(left)))
    return F.when(rest.contains(right), F.substr(rest, F.lit(1), F.instr(rest, right) - 1))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def year_month(ts: Column) -> Column:
    """A number that orders months."""
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def archive_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def mangle_user(name: Column) -> Column:
    """Underscores become hyphens, but for the first and the last character."""
    inner = F.translate(F.substr(name, F.lit(2), F.length(name) - 2), "_", "-")
    return F.when(F.length(name) < 3, name).otherwise(F.concat(F.left(name, F.lit(1)), inner, F.right(name, F.lit(1))))


def expand(template: Column, values: dict[str, Column]) -> Column:
    """``{$name}`` replaced by its value; names with a null value stay."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{$" + name + "}"), F.coalesce(value, F.lit("{$" + name + "}")))
    return out


def strip_prefix(s: Column, prefixes: list[str], any_case: bool = False, repeat: bool = False) -> Column:
    """Without the first of ``prefixes`` that it begins with, or without all of them in a row."""
    quoted = "|".join("".join(c if c.isalnum() else f"[{c}]" if c not in "^\\[]" else f"\\{c}" for c in p) for p in prefixes)
    return F.regexp_replace(s, ("(?i)" if any_case else "") + f"^({quoted})" + ("+" if repeat else ""), "")


def same(a: Column, b: Column, any_case: bool = False) -> Column:
    """Equality in which null equals null only."""
    return F.lower(a).eqNullSafe(F.lower(b)) if any_case else a.eqNullSafe(b)


def bytes_contain(content: Column, part: str) -> Column:
    """Whether bytes hold an ASCII text, in any case."""
    return F.lower(F.decode(content, "ISO-8859-1")).contains(part.lower())


#: Letters of Cyrillic text in UTF-8, each read as two characters of CP1251.
_MISREAD = re.compile("[\u0420\u0421][\u0080-\u00ff\u0400-\u045f\u0490\u0491\u2010-\u203a\u20ac\u2116\u2122]")


def recovered(s: str) -> str:
    """Misread Cyrillic as it was; text whose letters do not come in such pairs stays."""
    odd = sum(c > "\x7f" for c in s)
    if odd < 8 or 2 * len(_MISREAD.findall(s)) < 0.8 * odd:
        return s
    try:
        return s.encode("cp1251").decode("utf-8")
    except UnicodeError:
        return s


recover_garbled = column_function(recovered)


def is_garbled(s: Column) -> Column:
    return recover_garbled(s) != s


def part_of_name(name: Column) -> Column:
    """Part label of a month file: the number between its last hyphen and its last dot, else 1."""
    found = F.regexp_extract(name, "-([0-9]+)[.][^.-]*$", 1)
    return F.when(found == "", 1).otherwise(found.try_cast("int"))
