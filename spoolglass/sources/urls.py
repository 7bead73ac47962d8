"""Admission of clips by URL and size, as columns, before any provider is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VIDEO_EXTENSIONS = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".webm")
OTHER_EXTENSION = ".video"
MIME_TYPES = {".avi": "video/x-msvideo", ".m4v": "video/mp4", ".mkv": "video/x-matroska", ".mov": "video/quicktime", ".mp4": "video/mp4", ".mpeg": "video/mpeg", ".mpg": "video/mpeg", ".webm": "video/webm"}
LABEL_CHARS = 96


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def admitted(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https"), F.lit(False))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path, percent-decoded; plus signs and broken escapes stay as they are."""
    raw = F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    safe = F.regexp_replace(F.replace(raw, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), raw)


def file_name(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)


def extension(url: Column) -> Column:
    """A known video extension of the path, in lower case, or ``.video``."""
    found = F.lower(F.regexp_extract(file_name(url), r"[^.](\.[^.]+)$", 1))
    return F.when(found.isin(*VIDEO_EXTENSIONS), found).otherwise(F.lit(OTHER_EXTENSION))


def mime_type(url: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), extension(url))


def clip_label(url: Column) -> Column:
    name, where = F.left(file_name(url), F.lit(LABEL_CHARS)), F.left(host(url), F.lit(LABEL_CHARS))
    return F.when(name != "", name).when(where != "", where).otherwise(F.lit("video"))


def within_bytes(declared: Column, actual: Column, limit: Column | int) -> Column:
    """Neither the declared size, where there is one, nor the actual one is over a positive limit."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    return (most > 0) & F.coalesce(declared <= most, F.lit(True)) & F.coalesce(actual <= most, F.lit(True))


def analysis_route(size: Column, limit: Column | int) -> Column:
    """pass_through, transcode or reject for a clip of a size."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "reject").when(size <= limit, "pass_through").otherwise("transcode")


def joined_url(base: Column, tail: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(tail, "^/+", ""))
