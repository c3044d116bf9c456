"""URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIX = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*"


def _visible(col: Column | str) -> Column:
    """The URL without tabs and line breaks, which URL parsing ignores."""
    url = F.col(col) if isinstance(col, str) else col
    return F.translate(url, "\t\r\n", "")


def url_authority(col: Column | str) -> Column:
    """Host part of the URL, ``''`` where there is none."""
    return F.regexp_extract(_visible(col), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_segments(col: Column | str) -> Column:
    """Non-empty path segments; query, fragment and the last segment's ``;`` part are ignored."""
    path = F.regexp_extract(_visible(col), rf"(?:{_PREFIX})?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    return F.filter(F.split(path, "/"), lambda s: s != "")


def url_parts(col: Column | str) -> Column:
    """Struct of ``authority`` and ``segments``."""
    return F.struct(url_authority(col).alias("authority"), url_segments(col).alias("segments"))
