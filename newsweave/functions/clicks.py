"""Functions on click-log fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsweave.constants import TIME_FORMAT


def click_label(impression: Column) -> Column:
    """1 for a shown item marked as clicked, 0 for anything else."""
    return F.when(F.endswith(impression, F.lit("-1")), 1).otherwise(0)


def shown_item(impression: Column) -> Column:
    """The item id: the text before the first dash."""
    return F.substring_index(impression, "-", 1)


def numeric_id(value: Column, prefix: str) -> Column:
    """``U12`` or ``N12`` as 12; null where no int remains."""
    return F.regexp_replace(value, f"^{prefix}", "").try_cast("int")


def repeatable_key(seed: int, *values: Column) -> Column:
    """A sort key that looks random and is the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[v.cast("string") for v in values]))


def hash_fraction(key: Column) -> Column:
    """The first 32 bits of an md5 key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def words(text: Column) -> Column:
    """Whitespace-separated parts, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda part: part != "")


def click_time(time: Column) -> Column:
    """The click-log time as a timestamp; null where it does not parse."""
    return F.try_to_timestamp(time, F.lit(TIME_FORMAT))
