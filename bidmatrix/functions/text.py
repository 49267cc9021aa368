"""Text expressions shared by the intake lanes and the comparison."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_label(vendor_name: Column, source_filename: Column) -> Column:
    """``Name (file)``; null when either part is null, as concat is null-propagating."""
    return F.concat(vendor_name, F.lit(" ("), source_filename, F.lit(")"))


def short_vendor(label: Column) -> Column:
    """The part of a vendor label before the file."""
    return F.substring_index(label, " (", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def session_or_new(session_id: Column, request_key: Column) -> Column:
    """The given session, or one derived from the request so that a replay gets the same id."""
    fresh = F.concat(F.lit("session_"), F.sha2(request_key, 256))
    return F.coalesce(F.nullif(session_id, F.lit("")), fresh)


def normalised(label: Column) -> Column:
    """Lower case, words separated by single blanks, other signs dropped."""
    return F.trim(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", " "))
