"""Problem 4: the same quantity in different units; every offer in whole units of an ISO currency and in US dollars.

A random forest predicts how an offer's price is recorded (whole units, minor units, thousands, ten or hundred thousands, or
another currency than the one named) from its magnitude, source (region, currency), category and neighbours: the other rows of
the listing and of the product.  Its labels are the offers whose title spells the amount out; at most ``TRAIN_ROWS`` of
them for each class are learned from, a quarter of which calibrate the confidence (isotonic).  Confident predictions are
converted; the rest is routed to review, without an amount.  A title that spells the amount out is then read as it stands.

Rates and dollar values are checked against the rate table.  Null or unknown currencies are read from the title or the
region.  A null price or a price of 0 has unit ``whole``; null rates and dollar values are filled, never flagged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, table

#: Labelled rows of one class that the forest may learn from.
TRAIN_ROWS = 8_000
TREES, DEPTH = 24, 9
#: Calibrated confidence from which a prediction is converted.
CONFIDENT = 0.8
UNITS = ("whole", "minor", "thousand", "ten_thousand", "other_currency", "hundred_thousand")
#: What one recorded unit is worth in whole units.
SCALE = (1.0, 0.01, 1_000.0, 10_000.0, 1.0, 100_000.0)
#: The region's own currency, and names under which a currency is recorded.
REGION_CURRENCY = {"US": "USD", "EU": "EUR", "UK": "GBP", "IN": "INR", "JP": "JPY", "CA": "CAD", "AU": "AUD", "SG": "SGD", "BR": "BRL"}
CURRENCY_NAMES = {
    "us$": "USD", "us dollars": "USD", "$": "USD", "€": "EUR", "euro": "EUR", "£": "GBP", "pounds": "GBP", "₹": "INR", "rs.": "INR", "rs": "INR", "rupees": "INR", "¥": "JPY", "￥": "JPY", "円": "JPY", "yen": "JPY",
    "c$": "CAD", "ca$": "CAD", "cdn": "CAD", "a$": "AUD", "au$": "AUD", "s$": "SGD", "r$": "BRL", "reais": "BRL",
}
_CODES = "USD|EUR|GBP|INR|JPY|CAD|AUD|SGD|BRL"
_SIGNS = r"US\$|CA\$|AU\$|R\$|C\$|A\$|S\$|\$|€|£|¥|￥|₹|Rs\.?"
BEFORE = rf"(?<![\p{{L}}$])(?<!was )({_SIGNS}|{_CODES}) ?(\d[\d.,]*\d|\d)( ?(?:k|thousand|lakh|万)(?!\p{{L}}))?"
AFTER = rf"(?<![\d.,])(?<!was )(?<!was [$€£¥₹])(\d[\d.,]*\d|\d) ?(k|thousand|lakh|万)? ?({_CODES}|円|€|£|₹|cents|pence|centavos|paise|sen)(?!\p{{L}})"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def _number(text: Column, scaled: Column) -> Column:
    """An amount as written: the last sign is a decimal one unless three digits follow it and no scale word stands there."""
    thousands = ~scaled & text.rlike(r"[.,]\d{3}$")
    whole = F.regexp_replace(F.regexp_replace(text, r"[.,]\d*$", ""), r"[.,]", "")
    decimals = F.regexp_extract(text, r"[.,](\d*)$", 1)
    return F.when(thousands | ~text.rlike(r"[.,]"), F.regexp_replace(text, r"[.,]", "").try_cast("double")).otherwise(F.concat(whole, F.lit("."), decimals).try_cast("double"))


def title_amount(title: Column) -> tuple[Column, Column]:
    """Amount in whole units and currency that a title spells out; nulls where it doesn't."""
    sign, number, scale = (F.regexp_extract(title, BEFORE, k) for k in (1, 2, 3))
    number2, scale2, sign2 = (F.regexp_extract(title, AFTER, k) for k in (1, 2, 3))
    first = number != ""
    scale = F.when(first, F.trim(scale)).otherwise(scale2)
    minor = ~first & sign2.isin("cents", "pence", "centavos", "paise", "sen")
    factor = F.when(scale.isin("k", "thousand"), F.lit(1000.0)).when(scale == "万", F.lit(10000.0)).when(scale == "lakh", F.lit(100000.0)).when(minor, F.lit(0.01)).otherwise(F.lit(1.0))
    amount = _number(F.when(first, number).otherwise(number2), scale != "") * factor
    name = F.when(first, sign).when(~minor, sign2)
    return F.when(first | (number2 != ""), amount), F.coalesce(F.when(name.rlike(f"^({_CODES})$"), name), _lookup(CURRENCY_NAMES, F.lower(name)))


def _near(ratio: Column, value: float) -> Column:
    return F.abs(ratio / value - 1) < 0.02


def features(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """The offers with `day`, `rate` (of the row's own currency), `home_rate` (of the region's) and the columns the forest reads, all named x_."""
    rates = rates.select(F.col("currency").alias("c"), F.col("rate_date").cast("date").alias("r_day"), F.col("usd_per_unit").alias("r"))
    amount, named = title_amount(F.col("listing_title"))
    text = F.coalesce("product_name", "listing_title", F.lit(""))
    rows = (
        offers.withColumn("day", F.coalesce(F.to_date(F.try_to_timestamp("exchange_rate_timestamp")), F.to_date("scraped_at")))
        .withColumn("home", _lookup(REGION_CURRENCY, F.col("region")))
        .withColumn("t_amount", amount).withColumn("t_currency", named)
        .withColumn("product", F.concat_ws("|", F.lower(F.coalesce("competitor", "brand", F.lit(""))), F.regexp_extract(text, r"(?<!\d)(\d{4})(?!\d)", 1)))
        .withColumn("category", F.regexp_extract(text, r"(?<!\p{L})(\p{Ll}{3,})(?!\p{L})", 1))
        .join(F.broadcast(rates.select(F.col("c").alias("currency"), F.col("r_day").alias("day"), F.col("r").alias("rate"))), ["currency", "day"], "left")
        .join(F.broadcast(rates.select(F.col("c").alias("home"), F.col("r_day").alias("day"), F.col("r").alias("home_rate"))), ["home", "day"], "left")
    )  # the rate table has a fixed number of rows: nine currencies, one row a day
    usd = F.when(F.col("price") > 0, F.col("price") * F.coalesce("home_rate", "rate"))
    rows = materialise(rows.withColumn("by_home", usd))
    listing = rows.groupBy("canonical_url").agg(F.percentile_approx("by_home", 0.5, 1000).alias("l_usd"), F.count("by_home").alias("l_n"))
    product = listing.join(rows.groupBy("canonical_url").agg(F.min("product").alias("product"), F.min("category").alias("category")), "canonical_url")
    products = product.groupBy("product").agg(F.percentile_approx("l_usd", 0.5, 1000).alias("p_usd"), F.count("l_usd").alias("p_n"))
    categories = product.groupBy("category").agg(F.percentile_approx("l_usd", 0.5, 1000).alias("c_usd"))
    around = product.join(products, "product").join(categories, "category").select("canonical_url", "l_usd", "l_n", "p_usd", "p_n", "c_usd")
    log = lambda a, b: F.coalesce(F.when((a > 0) & (b > 0), F.log10(F.try_divide(a, b))), F.lit(0.0))
    c = F.col
    return (
        rows.join(around, "canonical_url", "left")
        .withColumn("x_listing", log(c("by_home"), c("l_usd")))
        .withColumn("x_listing_n", F.least(F.coalesce("l_n", F.lit(0)), F.lit(20)).cast("double"))
        .withColumn("x_product", log(c("by_home"), c("p_usd")))
        .withColumn("x_product_n", F.least(F.coalesce("p_n", F.lit(0)), F.lit(20)).cast("double"))
        .withColumn("x_category", log(c("by_home"), c("c_usd")))
        .withColumn("x_listing_product", log(c("l_usd"), c("p_usd")))
        .withColumn("x_magnitude", log(c("by_home"), F.lit(1.0)))
        .withColumn("x_usd", log(c("normalized_price_usd"), c("price") * c("rate")))
        .withColumn("x_usd_product", log(c("normalized_price_usd"), c("p_usd")))
        .withColumn("x_rate", log(c("exchange_rate"), c("rate")))
        .withColumn("x_home", F.coalesce((c("currency") == c("home")).cast("double"), F.lit(0.5)))
        .withColumn("x_decimals", F.coalesce((F.abs(c("price") * 100 - F.round(c("price") * 100)) > 1e-6).cast("double") + (c("price") != F.floor("price")).cast("double"), F.lit(0.0)))
    )


def labelled(rows: DataFrame) -> DataFrame:
    """The rows whose title tells the unit, with `label`; an index of UNITS."""
    ratio = F.try_divide(F.col("price"), F.col("t_amount"))
    right = (F.col("t_currency") == F.col("currency")) | F.col("t_currency").isNull()
    label = (
        F.when(_near(ratio, 1.0) & ~right & F.col("rate").isNotNull(), 4.0)
        .when(_near(ratio, 1.0) & right, 0.0).when(_near(ratio, 100.0), 1.0).when(_near(ratio, 1e-3), 2.0).when(_near(ratio, 1e-4), 3.0).when(_near(ratio, 1e-5), 5.0)
    )
    return rows.withColumn("label", label)


def fit(rows: DataFrame, seed: int = 7) -> tuple[PipelineModel, object]:
    """Forest and calibration, learned from a bounded sample of the rows with a label; both None where there are too few."""
    told = rows.where(F.col("label").isNotNull() & (F.col("price") > 0))
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2 or sum(counts.values()) < 50:
        return None, None
    share = reduce(lambda acc, kv: acc.when(F.col("label") == kv[0], min(1.0, TRAIN_ROWS / kv[1])), counts.items(), F.when(F.lit(False), 0.0))
    drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    names = [x for x in rows.columns if x.startswith("x_")]
    total = sum(min(n, TRAIN_ROWS) for n in counts.values())
    weight = reduce(lambda acc, kv: acc.when(F.col("label") == kv[0], (total / len(counts) / min(kv[1], TRAIN_ROWS)) ** 0.5), counts.items(), F.when(F.lit(False), 0.0))
    sample = materialise(told.where(drawn < share).select("label", weight.alias("weight"), *names, (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(4)) == 0).alias("held")))
    columns = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight", featureSubsetStrategy="0.6").fit(columns.transform(sample.where("not held")))
    model = PipelineModel([columns, forest])
    held = materialise(model.transform(sample.where("held")).select(F.array_max(vector_to_array("probability")).alias("p"), (F.col("prediction") == F.col("label")).cast("double").alias("right")))
    least = held.agg(F.min("p")).first()[0]
    return model, None if least is None else (IsotonicRegression(featuresCol="p", labelCol="right").fit(held), least)


def predicted(rows: DataFrame) -> DataFrame:
    """`rows` with `unit` (index of UNITS), `confidence` (calibrated) and `source` ('title', 'forest' or 'none')."""
    rows = labelled(rows)
    model, calibration = fit(rows)
    priced = F.col("price") > 0
    if model is None:
        return rows.withColumn("unit", F.coalesce("label", F.lit(0.0))).withColumn("confidence", F.lit(0.0)).withColumn("source", F.when(F.col("label").isNotNull(), "title").otherwise("none"))
    guessed = model.transform(rows).withColumn("p", F.array_max(vector_to_array("probability")))
    if calibration is not None:
        isotonic, least = calibration
        guessed = isotonic.setPredictionCol("confidence").transform(guessed)
        # less sure than anything calibration has seen: the forest's own share of votes counts
        guessed = guessed.withColumn("confidence", F.when(F.col("p") < least, F.least("p", "confidence")).otherwise(F.col("confidence")))
    else:
        guessed = guessed.withColumn("confidence", F.col("p"))
    told = F.col("label").isNotNull() & priced
    return (
        guessed.withColumn("unit", F.when(~F.coalesce(priced, F.lit(False)), F.lit(0.0)).when(told, F.col("label")).otherwise(F.col("prediction")))
        .withColumn("confidence", F.when(told | ~F.coalesce(priced, F.lit(False)), F.lit(1.0)).otherwise(F.col("confidence")))
        .withColumn("source", F.when(told, "title").otherwise("forest"))
    )


def checked(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Every offer once with what was recorded, the faults found, and its amount in whole units and in US dollars."""
    return converted(predicted(features(offers, rates)))


def converted(rows: DataFrame) -> DataFrame:
    """Rows of `predicted` with their faults and amounts; a row routed to review has no amount and no fault that needs one."""
    review = (F.col("source") == "forest") & (F.coalesce("confidence", F.lit(0.0)) < CONFIDENT)
    known = F.col("currency").isin(*REGION_CURRENCY.values())
    unit = F.col("unit").cast("int")
    scale = F.element_at(F.array(*[F.lit(s) for s in SCALE]), unit + 1)
    amount = F.when(~review, F.col("price") * scale)
    iso = F.when(F.coalesce(known, F.lit(False)) & (unit != 4), F.col("currency")).otherwise(F.coalesce("t_currency", "home", _lookup(CURRENCY_NAMES, F.lower("currency")), F.upper("currency")))
    rate_of = F.when(F.coalesce(known, F.lit(False)) & (unit != 4), F.col("rate")).otherwise(F.col("home_rate"))
    off = lambda a, b, least: F.coalesce(F.abs(a - b) > least + 2e-5 * F.abs(b), F.lit(False))
    return rows.select(
        "id", "canonical_url", F.col("price").alias("recorded"), F.col("currency").alias("recorded_currency"),
        F.element_at(F.array(*[F.lit(u) for u in UNITS]), unit + 1).alias("unit"), "source", "confidence",
        (~F.coalesce(known, F.lit(False))).alias("bad_currency"),
        ((unit != 0) & ~review).alias("bad_price"),
        off(F.col("exchange_rate"), F.col("rate"), 0.0).alias("bad_rate"),
        off(F.col("normalized_price_usd"), amount * rate_of, 0.0051).alias("bad_usd"),
        amount.alias("amount"), iso.alias("iso_currency"), (amount * rate_of).alias("amount_usd"),
        review.alias("review"),
    )
