"""File paths as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """The last part without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last dot part in lower case, empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def folder(path: Column) -> Column:
    """The path without its last part."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    """Whether the lower-cased extension is among ``extensions`` (with or without their dot)."""
    return extension(path).isin([e.lower().lstrip(".") for e in extensions])


def ends_with(path: Column, endings: Sequence[str]) -> Column:
    """Case-sensitive test of the file name's end."""
    out = F.lit(False)
    for e in endings:
        out = out | path.endswith(e)
    return out


def hidden(path: Column) -> Column:
    """Whether the file or any folder of a relative path starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]")


def moved(path: Column, old_root: str, new_root: str) -> Column:
    """The path with one root folder exchanged for another."""
    return F.concat(F.lit(new_root.rstrip("/")), F.substring(path, len(old_root.rstrip("/")) + 1, 1 << 30))
