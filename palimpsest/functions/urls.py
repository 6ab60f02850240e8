"""Column functions on URLs; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^(?i)[a-z][a-z0-9+.-]*://"
#: Ports that a scheme implies.
DEFAULT_PORTS = (("http", "80"), ("https", "443"))


def host(url: Column) -> Column:
    """Host without port and one final dot; null without a dot in it.  Tolerates malformed URLs."""
    rest = F.regexp_replace(F.regexp_replace(url, SCHEME, ""), "^//", "")
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), ":[0-9]*$", ""), r"\.$", "")
    return F.when(found.contains("."), found)


def host_lowercase(url: Column) -> Column:
    return F.lower(host(url))


def decode(url: Column) -> Column:
    """Percent-decoding that keeps ``+``; undecodable input stays."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def has_percent_encoding(url: Column) -> Column:
    return url.rlike("%[0-9A-Fa-f]{2}")


def strip_default_port(url: Column) -> Column:
    out = url
    for scheme, port in DEFAULT_PORTS:
        out = F.regexp_replace(out, f"(?i)^({scheme}://[^/?#:]+):{port}([/?#]|$)", "$1$2")
    return out


def strip_trailing_slash(url: Column) -> Column:
    """Without final slashes, but never into ``scheme://``."""
    return F.when(url.rlike("^[a-zA-Z]+:/*$"), url).otherwise(F.regexp_replace(url, "/+$", ""))


def strip_anchor(url: Column) -> Column:
    return F.regexp_extract(url, "^([^#]*)", 1)


def anchor(url: Column) -> Column:
    """Text after the first ``#``; null without one."""
    return F.when(url.contains("#"), F.regexp_extract(url, "#(.*)$", 1))


def with_anchor(url: Column, name: Column) -> Column:
    return F.when(name.isNull(), url).otherwise(F.concat(url, F.lit("#"), name))


def strip_parameters(url: Column) -> Column:
    return F.regexp_extract(url, "^([^?]*)", 1)


def strip_protocol(url: Column) -> Column:
    return F.regexp_replace(url, "(?i)^https?://", "")


def flip_protocol(url: Column) -> Column:
    """http for https and the reverse; other URLs stay."""
    return F.when(url.startswith("http://"), F.concat(F.lit("https://"), F.substr(url, F.lit(8)))).when(url.startswith("https://"), F.concat(F.lit("http://"), F.substr(url, F.lit(9)))).otherwise(url)


def query_parameter(url: Column, name: str) -> Column:
    """Value of the first parameter of this name, undecoded; empty where it is missing."""
    return F.regexp_extract(strip_anchor(url), f"[?&]{name}=([^&]*)", 1)


def variant_score(url: Column) -> Column:
    """Fixed values; the lower, the better a spelling: https counts -10, %25 +10, %20 +5, and one for each 100 characters."""
    one = lambda test, points: F.when(test, points).otherwise(0)
    return (one(url.startswith("https:"), -10) + one(url.contains("%25"), 10) + one(url.contains("%20"), 5) + F.floor(F.length(url) / 100)).cast("long")


def repair_slashes(url: Column) -> Column:
    """``http:/x`` and ``http:///x`` become ``http://x``."""
    return F.regexp_replace(url, "^(https?):/+", "$1://")


def media_extension(path: Column) -> Column:
    """Lower-case extension of the last component, at most four characters long; null without one."""
    found = F.lower(F.regexp_extract(strip_parameters(strip_anchor(path)), r"\.([A-Za-z0-9]+)$", 1))
    return F.when((found != "") & ((F.length(found) <= 4) | found.isin("shtml", "xhtml")), found)


def path_of(url: Column) -> Column:
    """Path of a URL or of a root-relative link, without query and anchor."""
    return F.regexp_extract(F.regexp_replace(url, "(?i)^[a-z]+://[^/?#]*", ""), "^([^?#]*)", 1)


def path_depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long")


def on_site(host_: Column, site: str) -> Column:
    """The host is the site or one of its subdomains."""
    return (host_ == site) | host_.endswith(f".{site}")


def archive_url(url: Column, stamp: Column, flag: str = "") -> Column:
    """Address of a snapshot; ``flag`` is the kind of copy, such as ``id_``."""
    return F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit(f"{flag}/"), url)


def is_archive_url(url: Column) -> Column:
    return url.rlike("^https?://web[.]archive[.]org/web/[0-9]{14}[a-z_]*/")


def archived_part(url: Column) -> Column:
    """The innermost URL of nested snapshots."""
    return F.regexp_extract(url, "^.*/web/[0-9]{14}[a-z_]*/(.*)$", 1)


def matches_any(url: Column, patterns: list[str]) -> Column:
    """A pattern is a host and path without scheme; ``*.`` in front means any subdomain, a final ``*`` any rest.

    The list is part of the expression, so no join is needed.
    """
    rest, hit = strip_protocol(url), F.lit(False)
    for pattern in patterns:
        quoted = "".join(c if c.isalnum() or c in "/-_" else f"[{c}]" for c in pattern.removeprefix("*.").removesuffix("*"))
        hit |= rest.rlike("^" + "([^/]+[.])?" * pattern.startswith("*.") + quoted + "$" * (not pattern.endswith("*")))
    return hit
