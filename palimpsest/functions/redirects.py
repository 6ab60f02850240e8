"""Redirect unwrapping, consolidation of spellings, resolution of links.

Plain functions on decoded URLs; ``columns`` has them as column functions.
"""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urljoin, urlsplit

from palimpsest.functions import codec
from palimpsest.functions.vectors import column_function

#: Redirectors whose target is all that follows; each with http and https.
_PREFIXES = ("www.livejournal.com/away?to=", "www.livejournal.com/away/?to=", "vk.com/away.php?to=", "vk.com/away.php/?to=")
#: Redirectors whose target is the parameter ``u``.
_U_PREFIXES = ("www.facebook.com/l.php?", "l.facebook.com/l.php?", "l.instagram.com/?", "l.instagram.com?")
_GOOGLE = re.compile(r"(www\.)?google\.[a-z]{2,3}(\.[a-z]{2})?")
_WEB = re.compile("https?://", re.I)
_HOST = re.compile(r"([A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


def parameter(url: str, name: str) -> str | None:
    """Decoded value of the first parameter whose decoded name is ``name``."""
    for pair in url.partition("#")[0].partition("?")[2].split("&"):
        key, found, value = pair.partition("=")
        if found and codec.decode(key) == name:
            return codec.decode(value)
    return None


def parameters(url: str) -> dict[str, str | None]:
    """All parameters, undecoded; one without ``=`` has no value, the last of a name wins."""
    query = url.partition("#")[0].partition("?")[2]
    pairs = (pair.partition("=") for pair in query.split("&") if pair)
    return {key: value if found else None for key, found, value in pairs}


def _target(url: str, name: str) -> str:
    """The web address in a parameter; the URL itself where there is none."""
    value = parameter(url, name)
    value = value and codec.decode(value)
    return codec.encode_minimal(value) if value and _WEB.match(value) else url


def _proxied(url: str, host: str, path: str) -> str:
    """Rules that look at host and path; the URL itself where none fits."""
    if (host == "images.google.com" or host.endswith(".images.google.com")) and path == "/imgres":
        found = parameters(url).get("imgurl")
        return codec.decode(found) if found else url
    if host == "imgprx.livejournal.net":
        parts = urlsplit(url).path.split("/")
        first = next((k for k in range(2, len(parts)) if _HOST.fullmatch(parts[k])), None)
        tail = url.partition(urlsplit(url).path)[2] if first else ""
        return f"https://{'/'.join(parts[first:])}{tail}" if first else url
    if host == "infonarod.ru" and path == "/away.php" and url.lower().startswith("http:"):
        return _target(url, "url")
    if host.startswith("external") and host.endswith(".xx.fbcdn.net") and path == "/safe_image.php":
        return _target(url, "url")
    if host == "docs.google.com" and path == "/viewer":
        return _target(url, "url")
    if host.endswith(".live.com") and path == "/handlers/imageproxy.mvc":
        return _target(url, "url")
    if _GOOGLE.fullmatch(host) and path == "/url":
        return _target(url, "q")
    if host == "p.dreamwidth.org":
        return "https://" + re.sub(r"^https?://[^/]*/[^/]*/[^/]*/", "", url, flags=re.I) if url.count("/") >= 5 else url
    return url


def unwrap_once(url: str) -> str:
    """One layer of redirection taken off; the anchor goes with the target."""
    url = url.strip(codec.BLANKS)
    bare, mark, anchor = url.partition("#")
    m = _WEB.match(bare)
    if not m:
        return url
    rest = bare[m.end() :]
    own = m[0].islower()
    prefix = next((p for p in _PREFIXES if own and rest.startswith(p)), None)
    if prefix:
        inner = rest[len(prefix) :]
    elif own and rest.startswith(_U_PREFIXES):
        inner = parameter(bare, "u") or ""
        if not re.match("https?(://|%3a//)", inner, re.I):
            return url
    else:
        split = re.match(r"([^/?#:]*)(?::\d+)?([^?]*)", rest)
        inner = _proxied(bare, split[1].lower(), split[2])
        if inner == bare:
            return url
    if re.match("https?%3a", inner, re.I):
        inner = codec.decode(inner)
    return codec.repair_cp1251(inner + (mark + anchor if mark else ""))


def layers(url: str) -> list[str]:
    """The URL and what each layer holds, down to one that holds no other."""
    out = [url]
    while (inner := unwrap_once(out[-1])) not in out:
        out.append(inner)
    return out


def unwrap(url: str) -> str:
    return layers(url)[-1]


def unwrap_encoded(href: str) -> str:
    """``unwrap`` on an attribute's text: decoded, unwrapped, encoded again; what cannot be decoded stays."""
    bare = href.strip(codec.BLANKS)
    if not re.match("https?(://|3a//)", bare, re.I):
        return bare
    if codec._BAD_ESCAPE.search(codec.repair_old_escapes(bare)):
        return href
    decoded = codec.decode(bare)
    found = unwrap(decoded)
    return href if found == decoded else codec.encode_attribute(found, True) or href


# ------------------------------------------------------------ consolidation


def _decoded_through(text: str) -> str:
    while True:
        as_form = "+" in text and "%2b" not in text.lower()
        inner = (codec.decode_form(text) if as_form else codec.decode(text)) or text
        if inner == text:
            return inner.replace("%0A", "").replace("\n", "")
        text = inner


def comparison_key(url: str, ignore_path_case: bool = False) -> str | None:
    """What spellings of one address share: no anchor, decoded to a fixed point, http, host in lower case."""
    text = _decoded_through(url.partition("#")[0].replace(" ", "%20"))
    m = re.fullmatch(r"https?://([^/?]+)([^?]*)(?:\?(.*))?", text, re.S | re.I)
    if not m:
        return None
    path = m[2].lower() if ignore_path_case else m[2]
    pairs = "&".join("=".join(map(codec.encode_segment, pair.split("=", 1))) for pair in m[3].split("&")) if m[3] is not None else None
    return f"http://{m[1].lower()}{codec.encode_minimal(path)}" + ("" if pairs is None else f"?{pairs}")


def variant_score(url: str) -> int:
    """Https counts -10, %25 +10, %20 +5, and one for each 100 characters."""
    return -10 * url.startswith("https://") + 10 * ("%25" in url) + 5 * ("%20" in url) + len(url) // 100


def consolidate(urls: list[str], ignore_path_case: bool = False) -> str | None:
    """The best spelling of one address, https if any spelling has it; null for several addresses or none."""
    known = [re.sub("/+$", "", _without_port(u)) if not re.fullmatch("https?:/+", u, re.I) else u for u in urls]
    if len({comparison_key(u, ignore_path_case) for u in known} - {None}) != 1:
        return None
    best = min(known, key=variant_score)
    if any(u.lower().startswith("https://") for u in known):
        best = re.sub("^http://", "https://", best, flags=re.I)
    head, rest = re.fullmatch("([^/]*//[^/?#]*)(.*)", codec.encode_minimal(best), re.S).groups()
    return head.lower() + rest.partition("#")[0]


def _without_port(url: str) -> str:
    m = re.match(r"(https?)(://[^/:]+):(80|443)(/.*|$)", url, re.I | re.S)
    own = m and {"http": "80", "https": "443"}[m[1].lower()] == m[3]
    return m[1].lower() + m[2] + m[4] if own else url


# --------------------------------------------------------------- resolution


def resolve(base: str, link: str) -> str:
    """A link of a page as an absolute address.

    ``data:`` stays; back slashes are slashes; the anchor is escaped; a page of
    an archive resolves within the archived address.
    """
    base, link = base.strip(), link.strip()
    if link.startswith("data:") or not base:
        return link
    head, mark, anchor = link.partition("#")
    link = head.replace("\\", "/") + (mark + codec.encode_segment(anchor) if mark else "")
    if link.startswith("//"):
        return (re.match("([A-Za-z][A-Za-z0-9+.-]*):", base) or ["", "https"])[1] + ":" + link
    m = re.match(r"(https://web\.archive\.org/web/.*?)(https?://.*)", base)
    return m[1] + urljoin(m[2], link) if m else urljoin(base, link)


def same_url(a: str, b: str) -> bool:
    """Scheme and host in any case, all else to the letter."""
    fold = lambda u: re.sub("^[^/?#]*//[^/?#:]*", lambda m: m[0].lower(), u)
    return fold(a) == fold(b)


def differ_in_version(a: str, b: str) -> bool:
    """Whether two URLs differ in the parameter ``v`` alone."""
    p, q = parameters(a), parameters(b)
    bare = lambda u: (u.partition("?")[0], u.partition("#")[2])
    drop = lambda d: {k: v for k, v in d.items() if k != "v"}
    return a != b and bare(a) == bare(b) and drop(p) == drop(q)


def css_bundle(href: str) -> list[str] | None:
    """``base??a,b?query`` as a list of addresses; null where ``??`` occurs twice."""
    base, combined, rest = href.partition("??")
    if not href or not combined:
        return [href] if href else []
    if "??" in rest:
        return None
    names, mark, query = rest.partition("?")
    return [base + name.strip() + mark + query for name in names.split(",") if name.strip()]


def relative_link(source: str, target: str) -> str:
    """Link from one file to another, both relative to one root."""
    return posixpath.relpath(target, posixpath.dirname(source) or ".")


def resolve_dots(path: str) -> str | None:
    """A relative path without ``.`` and ``..``; null where it leaves its root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and not out:
            return None
        if part == "..":
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def archived_relative(page: str, link: str) -> str | None:
    """Path of an archived link below the root of the archived page; null outside it."""
    inner = lambda u: re.sub(r"^.*/web/\d{14}[a-z_]*/", "", u)
    bare = lambda u: re.sub(r"^https?://(www\.)?", "", inner(u), flags=re.I)
    root, path = bare(page).rstrip("/"), bare(link)
    return path[len(root) + 1 :] if path.startswith(root + "/") else "" if path == root else None


def garbled(url: str) -> str:
    """Addresses that an offline browser has mangled: ``http_\\host/…`` and ``http/host/…`` after a local root."""
    m = re.search(r"(?:^|/)(https?)(?:_\\|_/|/)([^/\\]+\.[A-Za-z]{2,})([/\\].*)?$", url)
    return f"{m[1]}://{m[2]}" + (m[3] or "").replace("\\", "/") if m and not _WEB.match(url) else url


class columns:
    """The functions above on columns."""

    parameter = staticmethod(column_function(parameter))
    parameters = staticmethod(column_function(parameters, "map<string,string>"))
    unwrap = staticmethod(column_function(unwrap))
    unwrap_once = staticmethod(column_function(unwrap_once))
    unwrap_encoded = staticmethod(column_function(unwrap_encoded))
    layers = staticmethod(column_function(layers, "array<string>"))
    comparison_key = staticmethod(column_function(comparison_key))
    comparison_key_any_case = staticmethod(column_function(lambda url: comparison_key(url, True)))
    consolidate = staticmethod(column_function(consolidate))
    resolve = staticmethod(column_function(resolve))
    same_url = staticmethod(column_function(same_url, "boolean"))
    differ_in_version = staticmethod(column_function(differ_in_version, "boolean"))
    css_bundle = staticmethod(column_function(css_bundle, "array<string>"))
    relative_link = staticmethod(column_function(relative_link))
    resolve_dots = staticmethod(column_function(resolve_dots))
    archived_relative = staticmethod(column_function(archived_relative))
    garbled = staticmethod(column_function(garbled))
