"""Decoders of the lists that facts hold in one string: entries end at RS (0x1E), fields at US (0x1F)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RS, US = "\x1e", "\x1f"


def _entries(c: str | Column) -> Column:
    text = F.col(c) if isinstance(c, str) else c
    return F.when(text.isNotNull() & (text != ""), F.split(text, RS)).otherwise(F.array().cast("array<string>"))


def _fields(entry: Column, n: int) -> Column:
    return F.size(F.split(entry, US)) == n


def invocations(c: str | Column) -> Column:
    """array<struct<receiver_text, receiver_type, method_name>>, innermost first; entries of other lengths are skipped."""
    return F.transform(
        F.filter(_entries(c), lambda e: _fields(e, 3)),
        lambda e: F.struct(
            F.split(e, US)[0].alias("receiver_text"), F.split(e, US)[1].alias("receiver_type"), F.split(e, US)[2].alias("method_name")
        ),
    )


def names(c: str | Column) -> Column:
    """array<string>; null and '' are an empty list."""
    return _entries(c)


def scopes(c: str | Column) -> Column:
    """array<struct<kind, type>>; malformed entries are skipped."""
    return F.transform(
        F.filter(_entries(c), lambda e: _fields(e, 2)),
        lambda e: F.struct(F.split(e, US)[0].alias("kind"), F.split(e, US)[1].alias("type")),
    )


def guards(c: str | Column) -> Column:
    """array<struct<predicate, when_true>>; null (the code must run) and '' are an empty list."""
    return F.transform(
        F.filter(_entries(c), lambda e: _fields(e, 2)),
        lambda e: F.struct(F.split(e, US)[0].alias("predicate"), (F.split(e, US)[1] == "1").alias("when_true")),
    )
