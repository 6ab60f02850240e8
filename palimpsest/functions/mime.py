"""Content types from bytes and headers, extensions, and what a download is worth.

``sniff`` and ``profile`` look at file contents; the rest are built-in
expressions on columns.
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.vectors import column_function

OCTETS = "application/octet-stream"
#: How contents of a type begin.
_MAGIC = (
    (b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"),
    (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"), (b"\0\0\1\0", "image/vnd.microsoft.icon"), (b"%PDF-", "application/pdf"),
    (b"PK\3\4", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (b"Rar!\x1a\7", "application/vnd.rar"), (b"AT&TFORM", "image/vnd.djvu"), (b"{\\rtf", "application/rtf"), (b"ID3", "audio/mpeg"),
    (b"fLaC", "audio/x-flac"), (b"OggS", "application/ogg"), (b"FLV", "video/x-flv"), (b"\x1aE\xdf\xa3", "video/x-matroska"),
)
#: Extension of a type.
_EXTENSIONS = {
    "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/gif": "gif", "image/bmp": "bmp", "image/tiff": "tif", "image/webp": "webp",
    "image/svg+xml": "svg", "image/vnd.microsoft.icon": "ico", "image/x-icon": "ico", "image/vnd.djvu": "djvu", "image/x-djvu": "djvu",
    "text/html": "html", "application/xhtml+xml": "xhtml", "text/css": "css", "text/plain": "txt", "message/news": "txt", "application/pdf": "pdf",
    "application/zip": "zip", "application/gzip": "gz", "application/vnd.rar": "rar", "application/x-rar-compressed": "rar",
    "application/x-7z-compressed": "7z", "application/rtf": "rtf", "audio/mpeg": "mp3", "audio/x-flac": "flac", "application/ogg": "ogg",
    "video/mp4": "mp4", "video/x-flv": "flv", "video/x-matroska": "mkv",
}
#: Extensions of one kind; the first names the kind.
_KINDS = (
    ("jpg", "jpeg"), ("bmp", "dib"), ("tiff", "tif"), ("ico", "icon"), ("wav", "wave"), ("aiff", "aif"), ("ogg", "oga"), ("mp2", "mpa"),
    ("mp4", "m4v"), ("mov", "qt"), ("mpeg", "mpg"), ("mkv", "mk3d", "mka"), ("flv", "f4v"), ("html", "htm", "xhtml", "shtml", "xhtm", "shtm"), ("gz", "tgz"),
)
IMAGES = ("avif", "bmp", "dib", "gif", "ico", "icon", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp")
HTML = _KINDS[13]
SERVLETS = ("action", "api", "asp", "aspx", "cgi", "dll", "do", "exe", "fcgi", "jsp", "php", "php3", "php4", "phtml", "pl", "py", "rb", "svc")
#: Types that a .txt address may answer with.
TEXT_TYPES = (
    "text/plain", "text/x-markdown", "text/x-c", "text/x-c++", "text/x-latex", "text/x-log", "text/x-diff", "text/x-setext", "message/rfc822",
    "application/x-sh", "application/x-perl", "application/x-python", "application/x-tex", "application/x-troff", "application/x-subrip",
    "application/x-httpd-php", "application/x-csrc", "application/x-c++src", "application/x-java-source",
)
#: Hosts that answer .txt with HTML around a pre block, and where.
_PRE_HOSTS, _MOSHKOW_HOSTS = ("lib.ru", "www.lib.ru", "lib.kharkov.ua", "www1.lib.ru"), ("kulichki.com", "www.kulichki.com", "kulichki.ru", "www.kulichki.ru")


def unprintable_share(raw: bytes) -> float:
    return sum(b < 32 and b not in (9, 10, 12, 13) or b == 127 for b in raw) / len(raw) if raw else 0.0


def sniff(raw: bytes, ext: str = "") -> str:
    """Content type from bytes; ``ext`` is the extension of the path and helps plain texts only."""
    if not raw:
        return OCTETS
    for head, kind in _MAGIC:
        if raw.startswith(head):
            return kind
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return "image/webp"
    if raw[4:8] == b"ftyp":
        return "video/mp4"
    start = raw[:2048].lstrip(b"\xef\xbb\xbf \t\r\n").lower()
    if re.match(rb"(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<svg[\s>]", start, re.S):
        return "image/svg+xml"
    if re.match(rb"(<!--.*?-->\s*)*<(!doctype html|html|head|body|title)[\s>]", start, re.S):
        return "text/html"
    share = unprintable_share(raw)
    if share < 0.005 and (ext.lower() == "txt" or max(raw) < 128 and len(raw) > 100):
        return "text/plain"
    return "text/plain" if share < 0.005 and b"<style>" in raw and b"<div " in raw else OCTETS


def extension_of(mime: str) -> str | None:
    """Extension of a content type or a malformed header; null where none is known."""
    name = mime.partition(";")[0].strip().lower()
    if name in ("jpg", "jpeg", "pdf", ".pdf"):
        return {"jpeg": "jpg"}.get(name, name.lstrip("."))
    return _EXTENSIONS.get(name) or ("txt" if name.startswith("text/") else None)


#: Charset names that headers misspell.
_CHARSETS = {"utf8": "utf-8", "win-1251": "windows-1251", "cp-1251": "windows-1251", "windows1251": "windows-1251", "iso8859-1": "iso-8859-1"}


def charset_of(header: str) -> str | None:
    """Charset that a Content-Type header names, if it is one."""
    m = re.search(r"charset\s*=\s*[\"']?([^\s;\"']+)", header, re.I)
    name = _CHARSETS.get(m[1].lower(), m[1].lower()) if m else ""
    try:
        return codecs.lookup(name) and name if name else None
    except LookupError:
        return None


def text_of(raw: bytes, header: str) -> str:
    """Bytes as text: a byte order mark wins, then the header, then UTF-8, then CP1251."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    if name := charset_of(header):
        return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1251", "replace")


def profile(raw: bytes) -> str:
    """empty, zeros, small (under 128 bytes) or data."""
    return "empty" if not raw else "zeros" if not raw.strip(b"\0") else "small" if len(raw) < 128 else "data"


def kind(ext: Column) -> Column:
    """One name for extensions that mean the same."""
    low = F.lower(ext)
    out = low
    for first, *others in _KINDS:
        out = F.when(low.isin(others), first).otherwise(out)
    return out


def equivalent(a: Column, b: Column) -> Column:
    return F.coalesce(kind(a) == kind(b), F.lit(False))


def is_image(ext: Column) -> Column:
    return F.lower(ext).isin(*IMAGES)


def is_html(ext: Column) -> Column:
    return F.lower(ext).isin(*HTML)


def is_servlet(ext: Column) -> Column:
    return F.lower(ext).isin(*SERVLETS)


def decision(name_ext: Column, header_ext: Column, content_ext: Column, content_type: Column, host: Column, path: Column, has_pre: Column) -> Column:
    """Content policy: the extension a download is accepted under, or null where the policy has no say."""
    name, no = F.lower(name_ext), F.lit(False)
    css = (name == "css") & (F.coalesce(F.lower(header_ext).isin("css", "txt"), no) | F.coalesce(F.lower(content_ext).isin("css", "txt"), no))
    plain = (name == "txt") & content_type.isin(*TEXT_TYPES)
    place = host.isin(*_PRE_HOSTS) | (host.isin(*_MOSHKOW_HOSTS) & F.lower(path).startswith("/moshkow/"))
    pre = (name == "txt") & (F.lower(content_ext) == "html") & place & has_pre
    return F.when(css, "css").when(plain, "txt").when(pre, "html")


def verdict(code: Column, name_ext: Column, content_ext: Column, accepted: Column) -> Column:
    """good, reject or mismatch of a response: status first, then equal kinds, then the policy's extension."""
    fits = name_ext.isNull() | content_ext.isNull() | equivalent(name_ext, content_ext) | accepted.isNotNull()
    servlet = F.coalesce(is_servlet(name_ext), F.lit(False))
    return F.when(code != 200, "reject").when(fits | servlet, "good").otherwise("mismatch")


def failure(code: Column, content_type: Column, wanted_ext: Column, size: Column) -> Column:
    """Kind of a failed download: status, empty, or an HTML page in place of a file; null if it did not fail."""
    page = content_type.startswith("text/html") & ~F.coalesce(is_html(wanted_ext), F.lit(True)) & ~F.coalesce(is_servlet(wanted_ext), F.lit(False))
    return F.when(code == 429, "later").when(code.between(400, 599), "status").when(size == 0, "empty").when(page, "error page")


def repaired_name(relpath: Column, ext: Column, found: Column) -> Column:
    """Adjusted path of a stored file: the found extension is appended, never put in place of the old one."""
    fits = found.isNull() | equivalent(ext, found)
    return F.when(fits, relpath).otherwise(F.concat(relpath, F.lit("."), found))


class columns:
    """Functions on bytes and headers, as column functions."""

    sniff = staticmethod(column_function(sniff))
    extension_of = staticmethod(column_function(extension_of))
    charset_of = staticmethod(column_function(charset_of))
    text_of = staticmethod(column_function(text_of))
    profile = staticmethod(column_function(profile))
