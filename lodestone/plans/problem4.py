"""Problem 4: quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.units import checked
from lodestone.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(table(spark, sf_dir, "offers"), table(spark, sf_dir, "fx_rates"))
    return rows.where("bad_currency or bad_price or bad_rate or bad_usd").select("id")


def p4_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "offers"), table(spark, sf_dir, "fx_rates")).select("id", "unit", "amount", "iso_currency", "amount_usd", "confidence", "review")


def p4_review_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers, faults and rows routed to review, by recorded unit."""
    rows = checked(table(spark, sf_dir, "offers"), table(spark, sf_dir, "fx_rates"))
    return rows.groupBy("unit", "source").agg(F.count("*").alias("offers"), F.count_if("bad_rate").alias("bad_rates"), F.count_if("bad_usd").alias("bad_usd"), F.count_if("review").alias("review"))


QUERIES = {"p4_found": p4_found, "p4_converted": p4_converted, "p4_review_rate": p4_review_rate}
SQL: dict[str, str] = {}
