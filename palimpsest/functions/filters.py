"""Tests on URLs, hosts, responses and pages; built-in expressions but where unwrapping is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import redirects, text, urls

#: Hosts of video embeds, with their subdomains.
VIDEO_HOSTS = ("youtube.com", "youtu.be", "youtube-nocookie.com", "vimeo.com", "rutube.ru", "vk.com", "ok.ru", "dailymotion.com", "facebook.com")
#: Wikis whose File: pages look like pictures.
WIKI_HOSTS = ("wikipedia.org", "wikimedia.org", "wikibooks.org", "wikisource.org")
#: What pages of a failing gateway say.
_GATEWAY = ("502 bad gateway", "503 service temporarily unavailable", "504 gateway time-out")


def normal(url: Column) -> Column:
    """Without protocol, the host in lower case."""
    bare = urls.strip_protocol(url)
    host = F.regexp_extract(bare, "^([^/?#]*)", 1)
    return F.concat(F.lower(host), F.substr(bare, F.length(host) + 1))


def year_path(url: Column) -> Column:
    return url.rlike("/[0-9]{4}/?$")


def year_month_path(url: Column) -> Column:
    return url.rlike("/[0-9]{4}/(0[1-9]|1[0-2])/?$")


def on_site(url: Column, site: str, allowed: list[str] | None = None) -> Column:
    """The host is the site, one of its subdomains, or on the list."""
    host = urls.host_lowercase(url)
    return F.coalesce(urls.on_site(host, site) | host.isin(*(allowed or ["-"])), F.lit(False))


def journal_rest(url: Column, user: str, site: str = "livejournal.com") -> Column:
    """What follows the journal's base under four layouts; null for other addresses."""
    mangled = user.strip("_").replace("_", "-") if len(user) < 3 else user[0] + user[1:-1].replace("_", "-") + user[-1]
    s = site.replace(".", "[.]")
    bases = (f"{mangled}[.]{s}/", f"(?:www[.])?{s}/users/{user}/", f"users[.]{s}/{user}/", f"(?:community|syndicated)[.]{s}/{user}/")
    found = F.regexp_extract(url, f"(?i)^https?://(?:{'|'.join(bases)})(.*)$", 1)
    hit = url.rlike(f"(?i)^https?://(?:{'|'.join(bases)})")
    return F.when(hit, found)


def is_record(rest: Column) -> Column:
    """The remainder of a journal address is ``<digits>.html``."""
    return F.coalesce(rest.rlike("^[0-9]+[.]html$"), F.lit(False))


def wiki_file_page(url: Column) -> Column:
    host = urls.host_lowercase(url)
    on_wiki = F.lit(False)
    for site in WIKI_HOSTS:
        on_wiki |= urls.on_site(host, site)
    return F.coalesce(on_wiki, F.lit(False)) & url.rlike("/wiki/[^/?#:]+:[^/?#]*[.][A-Za-z]{3,4}([?#]|$)")


def wanted(url: Column, image: bool, online: bool, never: list[str], not_online: list[str]) -> Column:
    """Whether a link is downloaded: a web address that, unwrapped, is on no block list and has a host (a picture also a path)."""
    target = urls.strip_anchor(redirects.columns.unwrap(url))
    host, path = urls.host_lowercase(target), urls.path_of(target)
    blocked = urls.matches_any(target, never) | (urls.matches_any(target, not_online) if online else F.lit(False))
    good = url.rlike("(?i)^https?://") & ~blocked & host.isNotNull() & ~host.contains("*") & (host != "imgprx.livejournal.net")
    return F.coalesce(good & (~path.isin("", "/") if image else ~wiki_file_page(target)), F.lit(False))


def in_set(rows: DataFrame, url_col: str, listed: DataFrame) -> DataFrame:
    """Rows with ``listed``: the address is in a set (line) of exact addresses and of prefixes with a final ``*``.

    Exact addresses are an equi-join.  Prefixes join on the host and are then
    compared, so no pair of unlike hosts is made.
    """
    host = lambda c: F.regexp_extract(c, "^([^/?#*]*)", 1)
    lines = listed.select(normal(F.col("line")).alias("_line")).withColumn("_host", host(F.col("_line")))
    keyed = rows.withColumn("_url", normal(F.col(url_col))).withColumn("_host", host(F.col("_url")))
    fits = F.when(F.col("_line").endswith("*"), F.col("_url").startswith(F.left("_line", F.length("_line") - 1))).otherwise(F.col("_url") == F.col("_line"))
    hit = keyed.join(lines, "_host").where(fits).select("_url").distinct().withColumn("listed", F.lit(True))
    return keyed.join(hit, "_url", "left").withColumn("listed", F.coalesce("listed", F.lit(False))).drop("_url", "_host")


def either_protocol(rows: DataFrame, url_col: str, listed: DataFrame) -> DataFrame:
    """Rows whose address is not on a list of addresses, whatever the protocol."""
    known = listed.select(urls.strip_protocol(F.col("line")).alias("_k"))
    return rows.join(known, urls.strip_protocol(rows[url_col]) == F.col("_k"), "left_anti")


def excluded_path(relpath: Column, paths: list[str], prefixes: list[str]) -> Column:
    out = relpath.isin(*paths) if paths else F.lit(False)
    for prefix in prefixes:
        out |= relpath.startswith(prefix)
    return out


def is_page(relpath: Column) -> Column:
    """An HTML file, or an address that ends like a directory."""
    return F.lower(relpath).rlike("([.](html|htm|shtml|shtm|xhtml)|/)$") | ~F.regexp_extract(relpath, "([^/]*)$", 1).contains(".")


def same_root(a: Column, b: Column, any_www: bool = False) -> Column:
    """Two archive addresses of one original root, whatever the time (and ``www.``)."""
    root = lambda u: F.regexp_extract(urls.archived_part(u), "(?i)^https?://" + ("(?:www[.])?" if any_www else "") + "([^/?#]*)", 1)
    return (root(a) != "") & (F.lower(root(a)) == F.lower(root(b)))


def archive_path(url: Column) -> Column:
    """The path form of an archive address, with a year that can be."""
    year = F.regexp_extract(url, "(?:^|/)web/([0-9]{4})[0-9]{10}[a-z_]*/", 1).try_cast("int")
    return F.coalesce(year.between(1990, 2100), F.lit(False))


def in_repository(link: Column, root: str, sections: list[str]) -> Column:
    """A relative link into the link repository, and not into a known section."""
    bare = F.regexp_replace(link, r"^(\.\./)+", "")
    return bare.startswith(root.rstrip("/") + "/") & ~F.regexp_extract(bare, "^[^/]*/([^/]*)", 1).isin(*sections)


def is_video(url: Column) -> Column:
    host, out = urls.host_lowercase(url), F.lit(False)
    for site in VIDEO_HOSTS:
        out |= urls.on_site(host, site)
    return F.coalesce(out | (urls.on_site(host, "archive.org") & urls.path_of(url).startswith("/embed/")), F.lit(False))


def site_of(url: Column) -> Column:
    """The last two labels of the host."""
    return F.regexp_extract(urls.host_lowercase(url), "([^.]+[.][^.]+)$", 1)


def forum_control(url: Column) -> Column:
    """Forum addresses that do something instead of showing something."""
    return url.rlike("(?i)/(posting|search|memberlist|ucp|mcp|faq|login|register)[.]php([?]|$)|[?&](action|mode|sort|view|sid)=")


def gateway_error(html: Column) -> Column:
    low, out = F.lower(html), F.lit(False)
    for says in _GATEWAY:
        out |= low.contains(f"<title>{says}")
    return out


def page_state(html: Column) -> Column:
    """login limit, blocked or loading, by what the collapsed text says; null for a page as it should be."""
    says = F.lower(text.despace(F.regexp_replace(html, "<[^>]*>", " ")))
    limit = says.contains("your ip address is temporarily banned") | says.contains("too many failed logins")
    return F.when(limit, "login limit").when(says.contains("access to this page has been blocked"), "blocked").when(says.rlike("^(loading|please wait)( ?\\.\\.\\.)?$"), "loading")


def may_stay_remote(url: Column, hosts: list[str]) -> Column:
    """Style resources of these hosts (and their subdomains) may stay where they are when they cannot be fetched."""
    host, out = urls.host_lowercase(url), F.lit(False)
    for site in hosts:
        out |= urls.on_site(host, site)
    return F.coalesce(out, F.lit(False))


def profile_link(href: Column, bases: list[str]) -> Column:
    """album, picture or post of a link under one of the bases of a user; null for others."""
    rest = F.lit(None).cast("string")
    for base in bases:
        rest = F.coalesce(rest, F.when(href.startswith(base), F.substr(href, F.lit(len(base) + 1))))
    return F.when(rest.rlike("^/?photo/album/[0-9]+/?([?#]|$)"), "album").when(rest.rlike("^/?photo/album/[0-9]+/[0-9]+/?"), "picture").when(rest.rlike("^/?[0-9]+[.]html([?#]|$)"), "post")


def slow(requests: DataFrame, least_ms: int = 2500) -> DataFrame:
    """Requests of at least so long, the slowest first."""
    return requests.where(F.col("ms") >= least_ms).orderBy(F.col("ms").desc(), "url")
