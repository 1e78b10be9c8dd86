"""Scalar functions and predicates over provenance columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reads(mode: Column) -> Column:
    return mode.rlike("[r+]")


def writes(mode: Column) -> Column:
    return mode.rlike("[wxa+]")


def deletes(mode: Column) -> Column:
    return mode.contains("d")


def is_internal(name: Column, path: Column) -> Column:
    """Relative paths, and those that hold the trial's path anywhere."""
    return ~name.startswith("/") | F.contains(name, path)


def relative_path(name: Column, path: str) -> Column:
    """Inside the folder: relative to it; absolute elsewhere: null; relative: as it is."""
    inside = F.substring(name, len(path) + 2, 1 << 20)
    return F.when(~name.startswith("/"), name).when(name.startswith(path + "/"), inside)


def duration_micros(start: Column, finish: Column) -> Column:
    """Whole microseconds between two timestamps, 0 if one is missing."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.coalesce(micros(finish) - micros(start), F.lit(0)).cast("long")


def duration_text(micros: Column) -> Column:
    seconds = F.floor(micros / 1_000_000)
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def status_letter(status: Column) -> Column:
    return F.when(status == "finished", "").when(status == "backup", "b").otherwise("*")


def like_wildcard(value: Column, pattern: str) -> Column:
    """Equality in which ``*`` stands for anything."""
    return value.like(pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def brief_access(mode: Column, name: Column, before: Column) -> Column:
    return F.concat(F.lit("("), mode, F.lit(") "), name, F.when(before.isNull(), " (new)").otherwise(""))


def short_label(text: Column, size: int) -> Column:
    """Middle ellipsis to ``size`` characters, with quotes escaped."""
    half = (size - 3) // 2
    cut = F.when(F.length(text) > size, F.concat(F.substring(text, 1, half), F.lit("..."), F.expr(f"right({_name(text)}, {size - 3 - half})"))).otherwise(text)
    return F.replace(cut, F.lit('"'), F.lit('\\"'))


def _name(column: Column) -> str:
    return column._jc.toString()


def version_parts(name: Column) -> Column:
    """Dotted whole numbers as an array; a part that is none counts as -1, so it sorts lower."""
    return F.transform(F.split(name, "\\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def value_text(value: Column) -> Column:
    """A number that is no whole number gets the suffix f."""
    return F.when(value.try_cast("long").isNull() & value.try_cast("double").isNotNull(), F.concat(value, F.lit("f"))).otherwise(value)
