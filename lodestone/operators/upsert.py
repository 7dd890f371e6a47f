"""Keyed writes as aggregations: what a table holds after a batch of writes, without a row-at-a-time store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole last row of each key; order must tell all rows of a key apart. Map-side combined, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def merged(rows: DataFrame, keys: list[str], order: list[Column], overwritten: list[str]) -> DataFrame:
    """Partial upsert: `overwritten` columns keep the last value of a key, the others the first."""
    first = [c for c in rows.columns if c not in keys and c not in overwritten]
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*first), at).alias("__first"), F.max_by(F.struct(*overwritten), at).alias("__last")).select(*keys, "__first.*", "__last.*").select(*rows.columns)


def insert_ignore(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key stays, later ones are ignored."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
