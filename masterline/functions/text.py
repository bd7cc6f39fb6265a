"""File-name and title cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles that stay in lower case, the short tag of a re-recorded
# title, its long form, and the one era whose album has another name.
LOWERCASE_TITLES = ("reputation", "folklore", "evermore")
SHORT_TAG = "TV"
LONG_TAG = "Taylor's Version"
RENAMED = {"Debut": "Taylor Swift"}


def replace_first(x: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match.  ``pattern`` must hold no capture group
    and ``replacement`` no reference."""
    return F.regexp_replace(x, f"^([\\s\\S]*?)(?:{pattern})", "$1" + replacement)


def replace_all(x: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(x, pattern, replacement)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def plain_path(path: Column) -> Column:
    """A path without its scheme and with its escapes undone, as readers write the same
    path in different ways."""
    return F.regexp_replace(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), "^[a-z]+:/+", "/")


def drop_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def from_last(path: Column, word: str) -> Column:
    """Cut everything before the last occurrence of ``word``."""
    return F.regexp_replace(path, f"^.*(?={word})", "")


def prefixed(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), x.cast("string"))


def clean_title(path: Column, root: str = "figure") -> dict[str, Column]:
    """Image path -> ``img``, ``era`` and ``album`` columns.

    The file stem loses its two-digit sort prefix and its hyphens; titles are
    put in title case except the ones listed above, and a "tv" tag is written
    "(TV)" in the era and in full in the album name.
    """
    img = from_last(path, root)
    stem = F.regexp_replace(replace_first(drop_extension(file_name(img)), "[0-9]{2}-", ""), "-", " ")
    titled = F.initcap(stem)
    era = (
        F.when(stem.isin(*LOWERCASE_TITLES), stem)
        .when(stem.contains("tv"), replace_first(titled, "Tv", f"({SHORT_TAG})"))
        .otherwise(titled)
    )
    album = F.when(era.contains(f"({SHORT_TAG})"), replace_first(era, SHORT_TAG, LONG_TAG))
    for old, new in RENAMED.items():
        album = album.when(era == old, new)
    return {"img": img, "era": era, "album": album.otherwise(era)}
