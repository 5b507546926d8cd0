"""File names, slugs and lists of edit hints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sequence_prefix(stem: Column) -> Column:
    """What precedes the trailing digits; null if there are none."""
    return F.when(stem.rlike(r"\d$"), F.regexp_extract(stem, r"(?s)^(.*?)(\d+)$", 1))


def sequence_index(stem: Column) -> Column:
    """The trailing number, without leading zeros; null if there is none or it
    exceeds 18 digits' worth."""
    digits = F.regexp_extract(stem, r"(?s)^(.*?)(\d+)$", 2)
    return F.nullif(digits, F.lit("")).try_cast("bigint")


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+$", "$1")


def suffix(name: Column) -> Column:
    """The last suffix with its dot, lowered; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


#: White space that is stripped from hints and answers.
SPACES = " \t\n\r\x0b\f"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def stripped(items: Column) -> Column:
    """Items without outer white space, empty ones dropped."""
    return F.filter(F.transform(items, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def slug(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def strip_rank(name: Column) -> Column:
    """What follows the first underscore, or the whole name without one."""
    at = F.instr(name, "_")
    return F.when(at > 0, F.substr(name, at + 1)).otherwise(name)


def suffix_for_mime(mime: Column, fallback: Column) -> Column:
    m = F.lower(mime)
    return F.when(m == "image/png", ".png").when(m.isin("image/jpeg", "image/jpg"), ".jpg").when(m == "image/webp", ".webp").otherwise(fallback)


#: Words that betray a request to rotate.
ROTATION = "rotat|turn 90|flip|orient"


def drop_rotation(hints: Column) -> Column:
    """Hints without those that ask to rotate, trimmed, none empty."""
    return F.filter(stripped(hints), lambda x: ~F.lower(x).rlike(ROTATION))


def joined_unique(items: Column, fallback: str) -> Column:
    """Distinct non-empty items in first-seen order, joined by ``"; "``."""
    kept = F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; ")).otherwise(F.lit(fallback))


def numbered_name(name: Column, position: Column) -> Column:
    """The first of equal names keeps it, later ones get ``_1``, ``_2``, ..."""
    return F.when(position <= 1, name).otherwise(F.concat(stem(name), F.lit("_"), (position - 1).cast("string"), F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)))
