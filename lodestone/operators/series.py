"""Observation series: hourly collapse, neighbouring days, trailing windows, best rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_per_hour(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each series and hour; `hour` is added. An aggregation, so hot series combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    hourly = rows.withColumn("hour", F.date_trunc("hour", F.col(time)))
    return hourly.groupBy(*keys, "hour").agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__row")).select(*keys, "hour", "__row.*")


def last_two_days(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """For each series its last two days with the last row of each: columns prefixed cur_ and prev_ (null without a second day)."""
    rest = [c for c in rows.columns if c not in keys]
    daily = rows.withColumn("day", F.to_date(time)).groupBy(*keys, "day").agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("row"))
    ranked = daily.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("day")))).where("rank <= 2")
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.struct("day", "row")))
    wide = ranked.groupBy(*keys).agg(pick(1).alias("c"), pick(2).alias("p"))
    return wide.select(*keys, F.col("c.day").alias("cur_day"), F.col("p.day").alias("prev_day"), *[F.col(f"c.row.{x}").alias(f"cur_{x}") for x in rest], *[F.col(f"p.row.{x}").alias(f"prev_{x}") for x in rest])


def trailing_ends(rows: DataFrame, keys: list[str], time: str, tie: str, value: str, days: int) -> DataFrame:
    """First and last value of each series within `days` of its last day, where there are two rows or more."""
    ends = rows.groupBy(*keys).agg(F.max(F.to_date(time)).alias("__end"))
    near = rows.join(ends, keys).where(F.to_date(time) >= F.date_sub("__end", days))
    at = F.struct(time, tie)
    return near.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("n")).where("n >= 2")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best rows of each key with their `rank`; Spark filters groups before the shuffle (window group limit)."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def politeness(rows: DataFrame, key: str, time: Column, tie: str, gap: float) -> DataFrame:
    """Start of each request of a host when starts must be `gap` apart: s_i = max(t_i, s_(i-1) + gap), in closed form."""
    w = W.partitionBy(key).orderBy("__t", tie)
    ranked = rows.withColumn("__t", time).withColumn("__n", F.row_number().over(w))
    slack = F.max(F.col("__t") - F.col("__n") * gap).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("start", slack + F.col("__n") * gap).drop("__t", "__n")
