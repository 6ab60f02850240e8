"""Repository paths of URLs, their inverse, and repairs of stored paths.

Names that must be invented (over-long or reserved ones) come from a digest of
what they replace, so a retried task names a file the same way.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from palimpsest.functions import codec
from palimpsest.functions.vectors import column_function

#: Longest component and longest path.
LONGEST_PART, LONGEST_PATH = 90, 230
#: Names that one file system keeps for devices.
_DEVICE = re.compile(r"(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?", re.I)
_EDGE = "[ \t\xa0\u2000-\u200f]"


def media_extension(path: str) -> str | None:
    """Lower-case extension of the last component: up to four letters or digits, or shtml or xhtml."""
    m = re.search(r"\.([^./\\]+)$", path)
    ext = m[1].lower() if m else ""
    return ext if ext in ("shtml", "xhtml") or 0 < len(ext) <= 4 and ext.isalnum() else None


def made_up(text: str, ext: str | None = None) -> str:
    return "x-" + hashlib.md5(text.encode("utf-8", "replace")).hexdigest() + (f".{ext}" if ext else "")


def sane_component(part: str) -> str:
    """A path component any file system takes: decoded through, reserved characters and odd edges escaped."""
    name = codec.encode_filename(codec.decode_fully(part))
    escaped = lambda m: "".join(f"%{ord(c):02X}" for c in m[0])
    if re.fullmatch(f"(?:{_EDGE}|[.])*", name):
        return made_up(part)
    name = re.sub(f"^{_EDGE}+", escaped, re.sub(f"(?:{_EDGE}|[.])+$", escaped, name))
    if _DEVICE.fullmatch(name):
        return f"{made_up(part)}_{name}"
    return made_up(part, media_extension(name)) if len(name) > LONGEST_PART else name


def host_component(authority: str) -> str:
    host, _, port = authority.lower().partition(":")
    return host if port in ("", "80", "443") else f"{host}__{port}"


def file_path(url: str) -> str | None:
    """Where the repository keeps a URL: host, components, query with the extension again; null without a host."""
    m = re.match(r"[a-z]+://([^/?#]+)([^?#]*)(?:\?([^#]*))?", url, re.I)
    if not m:
        return None
    parts = [p for p in m[2].split("/") if p]
    ext = media_extension(parts[-1]) if parts else None
    if m[3]:
        last = parts.pop() if parts else ""
        parts.append(f"{last}?{m[3]}" + (f".{ext}" if ext else ""))
    host = host_component(m[1])
    path = "/".join([host, *map(sane_component, parts or ["[unnamed-root]"])])
    if len(path) < LONGEST_PATH:
        return path
    digest = hashlib.md5(url.encode()).hexdigest()
    return f"{host}/@@@/x-{int(digest[:6], 16) % 100:02d}/{made_up(url, ext)}"


def is_made_up(path: str) -> bool:
    """A generated name: an ``@@@`` directory or a component that is a digest."""
    return any(part == "@@@" or part.endswith("@@@") or re.match("x-[0-9a-f]{32}([._]|$)", part) for part in path.split("/"))


def original_url(path: str) -> str | None:
    """The URL that a repository path was made from, as https; null for generated names."""
    if is_made_up(path):
        return None
    host, *parts = path.split("/")
    if "__" in host:
        host = ":".join(host.rsplit("__", 1))
    if parts == ["[unnamed-root]"]:
        parts = []
    decoded = [unquote(p) for p in parts]
    query = ""
    if decoded and "?" in decoded[-1]:
        name, _, query = decoded[-1].partition("?")
        ext = media_extension(name)
        if ext and query.endswith("." + ext):
            query = query[: -len(ext) - 1]
        decoded = [*decoded[:-1], name] if name else decoded[:-1]
    return f"https://{host}" + "".join("/" + quote(p) for p in decoded) + (f"?{query}" if query else "")


def encode_components(path: str) -> str:
    return "/".join(map(codec.encode_segment, path.split("/")))


def decode_components(path: str) -> str:
    return "/".join(codec.decode_mixed(p) for p in path.split("/"))


def safe_title(title: str) -> str:
    """A file name from a title: reserved characters and line ends are blanks, runs of blanks one."""
    return re.sub(r"[ .]+$", "", re.sub(r"\s+", " ", "".join(" " if c in codec.RESERVED else c for c in title)).strip())


def without_edge_dots(path: str) -> str | None:
    """Final dots and blanks of each component removed; null if that leaves an empty component."""
    parts = [p if p == ".." else re.sub(r"[. ]+$", "", p) for p in path.split("/")]
    return "/".join(parts) if all(parts) else None


def depth(path: str) -> int:
    """Components below the root; a drive or a share is part of the root."""
    rest = re.sub(r"^([A-Za-z]:|//[^/]+/[^/]+)", "", path.replace("\\", "/"))
    return sum(1 for p in rest.split("/") if p)


def below(root: str, path: str) -> str | None:
    """An absolute value of a map relative to its root, with slashes; null outside it."""
    root, path = (x.replace("\\", "/").rstrip("/") for x in (root, path))
    return path[len(root) + 1 :] if path.startswith(root + "/") else None


#: Beginnings that incomplete local addresses have, and what they stand for.
_INCOMPLETE = (("//", "https://"), ("http:/", "http://"), ("https:/", "https://"), ("www.", "https://www."), ("http//", "http://"))


def complete(url: str) -> str:
    """Local addresses that lack a scheme or a slash."""
    if re.match("https?://", url, re.I):
        return url
    return next((new + url[len(old) :].lstrip("/") for old, new in _INCOMPLETE if url.startswith(old)), url)


def spellings(href: str) -> list[str]:
    """Spellings under which a stored file may be linked, likeliest first."""
    forms = (href, codec.decode_mixed(href), decode_components(codec.decode_mixed(href)), encode_components(href))
    return list(dict.fromkeys(forms))


def shorten(path: str) -> str:
    """Each over-long component as the digest of it, its extension kept."""
    return "/".join(p if len(p) <= LONGEST_PART else made_up(p, media_extension(p)) for p in path.split("/"))


def numbered(name: str, taken: list[str]) -> str:
    """A free name: the name itself, else with the least number before its extension; names compare in lower case."""
    used = {t.lower() for t in taken}
    stem, dot, ext = name.rpartition(".") if "." in name else (name, "", "")
    k, out = 1, name
    while out.lower() in used:
        k += 1
        out = f"{stem}_{k}{dot}{ext}"
    return out


class columns:
    """The functions above on columns."""

    media_extension = staticmethod(column_function(media_extension))
    sane_component = staticmethod(column_function(sane_component))
    file_path = staticmethod(column_function(file_path))
    original_url = staticmethod(column_function(original_url))
    is_made_up = staticmethod(column_function(is_made_up, "boolean"))
    encode_components = staticmethod(column_function(encode_components))
    decode_components = staticmethod(column_function(decode_components))
    safe_title = staticmethod(column_function(safe_title))
    without_edge_dots = staticmethod(column_function(without_edge_dots))
    depth = staticmethod(column_function(depth, "int"))
    below = staticmethod(column_function(below))
    complete = staticmethod(column_function(complete))
    spellings = staticmethod(column_function(spellings, "array<string>"))
    shorten = staticmethod(column_function(shorten))
