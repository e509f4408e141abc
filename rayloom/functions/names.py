"""Names of images, times of acquisitions and durations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_id(path: Column) -> Column:
    """The file's name without folders and its last ending."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with `suffix` before the file's last ending."""
    ending = F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(ending)), F.lit(suffix), ending)


def clock(seconds: Column) -> Column:
    """A duration as HH:MM:SS.ss."""
    h = F.floor(seconds / 3600)
    m = F.floor((seconds - h * 3600) / 60)
    return F.format_string("%02d:%02d:%05.2f", h, m, seconds - h * 3600 - m * 60)


def acquired(tag: Column, path: Column) -> Column:
    """When an image was taken: the file's own tag, else the first 15 characters of its name."""
    by_tag = F.try_to_timestamp(tag, F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.coalesce(by_tag, F.try_to_timestamp(F.substring(image_id(path), 1, 15), F.lit("yyyyMMdd_HHmmss")))
