"""Percent codes: decoding with repairs, encoding for several places, file names.

Plain functions on strings; ``columns`` has them as column functions.  An
escape is ``%`` and two hex digits.  Malformed escapes make strict decoding
fail; the tolerant forms leave the text as it is.
"""

from __future__ import annotations

import base64
import binascii
import re
from urllib.parse import quote, unquote_to_bytes

from palimpsest.functions.vectors import column_function

_ESCAPES = re.compile("(?:%[0-9A-Fa-f]{2})+")
_BAD_ESCAPE = re.compile("%(?![0-9A-Fa-f]{2})")
#: Fixed values: %uXXXX is repaired for these code points, and only where it occurs three times or more.
_OLD_ESCAPE = re.compile("%u(04[1-8][0-9A-Fa-f]|0490)")
_LEAST_OLD = 3
#: Characters that form encoding leaves alone besides letters and digits.
_FORM_SAFE = "*-._"
#: Characters that a URI cannot hold as they are, besides controls, blanks and non-ASCII.
_ILLEGAL = re.compile("[\"<>\\\\^`{}|\\[\\]\x00-\x20\x7f-\U0010ffff]")
#: Characters that file systems reserve.
RESERVED = '|\\/:*?"<>'
BLANKS = " \t\n\r\xa0"


def repair_old_escapes(text: str) -> str:
    """Legacy ``%uXXXX`` of Cyrillic letters as UTF-8 escapes."""
    if len(_OLD_ESCAPE.findall(text)) < _LEAST_OLD:
        return text
    return _OLD_ESCAPE.sub(lambda m: quote(chr(int(m[1], 16))), text)


def decode_strict(text: str) -> str:
    """All escapes as UTF-8, ``+`` kept; a malformed escape is an error."""
    if _BAD_ESCAPE.search(text):
        raise ValueError(f"malformed escape in {text!r}")
    return unquote_to_bytes(text).decode("utf-8", "replace")


def decode(text: str) -> str:
    """URL decoding: trimmed, old escapes repaired, ``+`` kept; an undecodable text stays."""
    text = repair_old_escapes(text.strip(BLANKS))
    try:
        return decode_strict(text) if _ESCAPES.search(text) else text
    except ValueError:
        return text


def decode_form(text: str) -> str | None:
    """Form decoding: ``+`` is a space; null for a malformed escape."""
    try:
        return decode_strict(text.replace("+", " "))
    except ValueError:
        return None


def decode_mixed(text: str) -> str:
    """Escapes decoded run by run, everything else kept."""
    return _ESCAPES.sub(lambda m: unquote_to_bytes(m[0]).decode("utf-8", "replace"), text)


def decode_fully(text: str, rounds: int = 10) -> str:
    """``decode_mixed`` until nothing changes; an error where that takes too long."""
    for _ in range(rounds):
        before, text = text, decode_mixed(text)
        if text == before:
            return text
    raise ValueError("decoding did not settle")


def encode_rfc3986(text: str) -> str:
    return quote(text, safe="-_.~")


def encode_segment(text: str) -> str:
    """Form encoding with ``%20`` for a space."""
    return quote(text, safe=_FORM_SAFE).replace("~", "%7E")


def encode_segments(text: str) -> str:
    """Each segment of a path; slashes stay, those at the end go."""
    return "/".join(map(encode_segment, text.rstrip("/").split("/")))


def _safe(text: str) -> str:
    """Escapes stay; the rest is escaped in lower-case hex, but for unreserved characters."""
    out, at = [], 0
    lower = lambda s: re.sub("%..", lambda m: m[0].lower(), quote(s, safe="-._~"))
    for m in _ESCAPES.finditer(text):
        out += [lower(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, lower(text[at:])])


def encode_attribute(url: str, safe: bool = False) -> str | None:
    """A decoded URL as an attribute holds it: path, query and fragment escaped apart; null without a scheme."""
    one = _safe if safe else encode_segment
    m = re.fullmatch(r"([^/]*?[^/:]|[^/]+?)://([^/]*)(.*)", url, re.S)
    if not m:
        return None
    rest, _, fragment = m[3].partition("#")
    path, _, query = rest.partition("?")
    out = f"{m[1]}://{m[2]}" + "/".join(map(one, path.rstrip("/").split("/")))
    if "?" in rest:
        pairs = (pair.partition("=") for pair in query.split("&"))
        out += "?" + "&".join(one(k) + eq + one(v) for k, eq, v in pairs)
    return out + ("#" + one(fragment) if "#" in m[3] else "")


def encode_minimal(text: str) -> str:
    """Only what a URI cannot hold; ``%`` stays."""
    return _ILLEGAL.sub(lambda m: quote(m[0], safe=""), text)


def normalize_authority(url: str) -> str:
    """Scheme and host in lower case, without the scheme's own port; the rest untouched."""
    m = re.match(r"(https?)://([^/:?#]+)(:\d+)?(?=[/?#]|$)", url, re.I)
    if not m:
        return url
    scheme, port = m[1].lower(), m[3] or ""
    own = {"http": ":80", "https": ":443"}[scheme]
    return f"{scheme}://{m[2].lower()}{'' if port == own else port}{url[m.end() :]}"


def wire_form(url: str) -> str | None:
    """As a client sends it: escaped, without anchor, authority normalised."""
    encoded = encode_attribute(url, safe=True)
    return encoded and normalize_authority(encoded.partition("#")[0])


def repair_cp1251(url: str) -> str:
    """Runs of escapes that are no UTF-8 are read as CP1251 and escaped anew; others stay."""

    def one(m: re.Match) -> str:
        raw = unquote_to_bytes(m[0])
        try:
            raw.decode("utf-8")
            return m[0]
        except UnicodeDecodeError:
            return "".join(f"%{b:02X}" for b in raw.decode("cp1251", "replace").encode("utf-8"))

    return _ESCAPES.sub(one, url)


def encode_filename(name: str) -> str:
    """Reserved characters, controls, U+00FF and U+FFFD as escapes."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c in RESERVED or c < " " or c in "\xff�" else c for c in name)


def has_reserved(path: str) -> bool:
    """Whether a component of a relative path holds a reserved character; ``.`` and ``..`` are fine."""
    return any(set(part) & set(RESERVED) for part in path.split("/"))


#: Extensions of media types in data URLs.
_DATA_EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp", "text/css": "css", "text/html": "html", "text/plain": "txt"}


def data_url(url: str) -> dict | None:
    """media_type, extension and content of a ``data:`` URL; null for others and for bad base64."""
    m = re.fullmatch(r"data:([^,]*),(.*)", url, re.S | re.I)
    if not m:
        return None
    head = m[1].split(";")
    media = (head[0] or "text/plain").strip().lower()
    try:
        raw = base64.b64decode(unquote_to_bytes(re.sub(r"\s", "", m[2])), validate=True) if "base64" in (x.strip().lower() for x in head[1:]) else unquote_to_bytes(m[2])
    except (binascii.Error, ValueError):
        return None
    return {"media_type": media, "extension": _DATA_EXTENSIONS.get(media), "content": raw}


class columns:
    """The functions above on columns."""

    decode = staticmethod(column_function(decode))
    decode_form = staticmethod(column_function(decode_form))
    decode_mixed = staticmethod(column_function(decode_mixed))
    decode_fully = staticmethod(column_function(decode_fully))
    encode_rfc3986 = staticmethod(column_function(encode_rfc3986))
    encode_segment = staticmethod(column_function(encode_segment))
    encode_segments = staticmethod(column_function(encode_segments))
    encode_attribute = staticmethod(column_function(encode_attribute))
    encode_attribute_safe = staticmethod(column_function(lambda url: encode_attribute(url, True)))
    encode_minimal = staticmethod(column_function(encode_minimal))
    normalize_authority = staticmethod(column_function(normalize_authority))
    wire_form = staticmethod(column_function(wire_form))
    repair_cp1251 = staticmethod(column_function(repair_cp1251))
    repair_old_escapes = staticmethod(column_function(repair_old_escapes))
    encode_filename = staticmethod(column_function(encode_filename))
    has_reserved = staticmethod(column_function(has_reserved, "boolean"))
