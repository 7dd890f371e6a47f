"""Observation series, event counts and streaming twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import rounded
from lodestone.operators.limits import admitted
from lodestone.operators.series import last_per_hour, last_two_days, politeness, top_k, trailing_ends
from lodestone.session import table
from lodestone.streaming import events as streams

SQL: dict[str, str] = {}
C = F.col


def _offers(spark, d):
    return table(spark, d, "offers").where(C("canonical_url").isNotNull()).select("canonical_url", "id", "scraped_at", "price", "currency", "seller", "region", "canonical_product_id")


def undercut(spark, d):
    """Cheapest and second cheapest observation of every product and region, by recorded US dollars."""
    o = table(spark, d, "offers").where("availability <> 'out_of_stock' and normalized_price_usd is not null and canonical_product_id is not null")
    best = top_k(o, ["canonical_product_id", "region"], [C("normalized_price_usd"), F.desc("scraped_at"), C("id")], 2)
    pick = lambda k, c: F.max(F.when(C("rank") == k, C(c)))
    return best.groupBy("canonical_product_id", "region").agg(pick(1, "id").alias("leader_id"), pick(1, "normalized_price_usd").alias("leader_usd"), pick(2, "id").alias("next_id"), pick(2, "normalized_price_usd").alias("next_usd"))


SQL["undercut"] = """SELECT canonical_product_id, region, max(id) FILTER (k = 1) AS leader_id, max(normalized_price_usd) FILTER (k = 1) AS leader_usd, max(id) FILTER (k = 2) AS next_id, max(normalized_price_usd) FILTER (k = 2) AS next_usd FROM
(SELECT *, row_number() OVER (PARTITION BY canonical_product_id, region ORDER BY normalized_price_usd, scraped_at DESC, id) AS k FROM offers WHERE availability <> 'out_of_stock' AND normalized_price_usd IS NOT NULL AND canonical_product_id IS NOT NULL)
WHERE k <= 2 GROUP BY canonical_product_id, region"""


def hourly_series(spark, d):
    """The last observation of each listing and hour."""
    return last_per_hour(_offers(spark, d), ["canonical_url"], "scraped_at", "id").select("canonical_url", "hour", "id", "price", "currency")


SQL["hourly_series"] = """SELECT canonical_url, date_trunc('hour', scraped_at) AS hour, arg_max(id, (scraped_at, id)) AS id, arg_max(s, (scraped_at, id)).price AS price, arg_max(s, (scraped_at, id)).currency AS currency FROM
(SELECT *, struct_pack(price := price, currency := currency) AS s FROM offers WHERE canonical_url IS NOT NULL) GROUP BY canonical_url, date_trunc('hour', scraped_at)"""


def series_stats(spark, d):
    """Size, range, median and last value of the hourly series."""
    h = last_per_hour(_offers(spark, d), ["canonical_url"], "scraped_at", "id").where("price is not null")
    return h.groupBy("canonical_url").agg(F.count("*").alias("hours"), F.min("price").alias("lowest"), F.max("price").alias("highest"), F.median("price").alias("middle"), F.max_by("price", F.struct("scraped_at", "id")).alias("last"))


SQL["series_stats"] = f"""SELECT canonical_url, count(*) AS hours, min(price) AS lowest, max(price) AS highest, median(price) AS middle, arg_max(price, hour) AS last FROM ({SQL["hourly_series"]}) WHERE price IS NOT NULL GROUP BY canonical_url"""


def last_two_days_of_listings(spark, d):
    o = _offers(spark, d).select("canonical_url", "id", "scraped_at", "price")
    return last_two_days(o, ["canonical_url"], "scraped_at", "id").select("canonical_url", "cur_day", "prev_day", "cur_id", "prev_id", "cur_price", "prev_price")


SQL["last_two_days_of_listings"] = """WITH x AS (SELECT canonical_url, CAST(scraped_at AS DATE) AS day, arg_max(struct_pack(id := id, price := price), (scraped_at, id)) AS s FROM offers WHERE canonical_url IS NOT NULL GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY day DESC) AS k FROM x)
SELECT canonical_url, max(day) FILTER (k = 1) AS cur_day, max(day) FILTER (k = 2) AS prev_day, max(s.id) FILTER (k = 1) AS cur_id, max(s.id) FILTER (k = 2) AS prev_id, max(s.price) FILTER (k = 1) AS cur_price, max(s.price) FILTER (k = 2) AS prev_price
FROM y WHERE k <= 2 GROUP BY canonical_url"""


def trailing_week(spark, d):
    """First and last value of every listing in the week before its last day."""
    return trailing_ends(_offers(spark, d), ["canonical_url"], "scraped_at", "id", "price", 7)


SQL["trailing_week"] = """SELECT canonical_url, arg_min(s, (scraped_at, id)).price AS first_value, arg_max(s, (scraped_at, id)).price AS last_value, count(*) AS n FROM
(SELECT *, struct_pack(price := price) AS s, max(CAST(scraped_at AS DATE)) OVER (PARTITION BY canonical_url) AS last_day FROM offers WHERE canonical_url IS NOT NULL)
WHERE CAST(scraped_at AS DATE) >= last_day - 7 GROUP BY canonical_url HAVING count(*) >= 2"""


def step_volatility(spark, d):
    """Population deviation of the relative steps of each listing, where it has three or more observations."""
    w = W.partitionBy("canonical_url").orderBy("scraped_at", "id")
    steps = _offers(spark, d).withColumn("before", F.lag("price").over(w)).where("before > 0 and price is not null").withColumn("step", (C("price") - C("before")) / C("before"))
    return steps.groupBy("canonical_url").agg(F.count("*").alias("steps"), rounded(F.stddev_pop("step"), 4).alias("volatility")).where("steps >= 2")


SQL["step_volatility"] = """SELECT canonical_url, count(*) AS steps, floor(stddev_pop((price - before) / before) * 10000 + 0.5) / 10000 AS volatility FROM
(SELECT canonical_url, price, lag(price) OVER (PARTITION BY canonical_url ORDER BY scraped_at, id) AS before FROM offers WHERE canonical_url IS NOT NULL) WHERE before > 0 AND price IS NOT NULL GROUP BY canonical_url HAVING count(*) >= 2"""


def regional_snapshot(spark, d):
    """Latest row, range and count of every product, region and seller."""
    o = table(spark, d, "offers").where(C("canonical_product_id").isNotNull()).withColumn("entity", F.coalesce(F.nullif("competitor", F.lit("")), F.nullif("seller", F.lit("")), F.lit("unknown")))
    return o.groupBy("canonical_product_id", "region", "entity").agg(F.count("*").alias("offers"), F.min("normalized_price_usd").alias("lowest_usd"), F.max("normalized_price_usd").alias("highest_usd"), F.max_by("id", F.struct("scraped_at", "id")).alias("latest_id"))


SQL["regional_snapshot"] = """SELECT canonical_product_id, region, coalesce(nullif(competitor, ''), nullif(seller, ''), 'unknown') AS entity, count(*) AS offers, min(normalized_price_usd) AS lowest_usd, max(normalized_price_usd) AS highest_usd,
arg_max(id, (scraped_at, id)) AS latest_id FROM offers WHERE canonical_product_id IS NOT NULL GROUP BY ALL"""


def fx_join(spark, d):
    """Offers with the rate of their currency and day; amounts as decimals."""
    rates = table(spark, d, "fx_rates").select("currency", C("rate_date").cast("date").alias("day"), C("usd_per_unit").cast("decimal(18,6)").alias("rate"))
    o = table(spark, d, "offers").select("id", "currency", F.to_date("scraped_at").alias("day"), C("price").cast("decimal(18,2)").alias("amount"))
    return o.join(rates, ["currency", "day"], "left").select("id", "currency", "day", F.round(C("amount") * C("rate"), 2).cast("decimal(18,2)").alias("usd"))


SQL["fx_join"] = """SELECT id, o.currency, CAST(scraped_at AS DATE) AS day, CAST(round(CAST(price AS DECIMAL(18,2)) * CAST(usd_per_unit AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS usd
FROM offers o LEFT JOIN fx_rates f ON o.currency = f.currency AND CAST(o.scraped_at AS DATE) = CAST(f.rate_date AS DATE)"""


def first_seen_products(spark, d):
    """Products whose first day is the last day of the data."""
    o = table(spark, d, "offers").where(C("canonical_product_id").isNotNull()).groupBy("canonical_product_id").agg(F.min(F.to_date("scraped_at")).alias("first_day"), F.count("*").alias("n"))
    end = table(spark, d, "offers").agg(F.max(F.to_date("scraped_at")).alias("end"))
    return o.join(end, C("first_day") == C("end")).select("canonical_product_id", "first_day", "n")


SQL["first_seen_products"] = """SELECT canonical_product_id, min(CAST(scraped_at AS DATE)) AS first_day, count(*) AS n FROM offers WHERE canonical_product_id IS NOT NULL GROUP BY canonical_product_id
HAVING min(CAST(scraped_at AS DATE)) = (SELECT max(CAST(scraped_at AS DATE)) FROM offers)"""


def politeness_schedule(spark, d):
    """Request starts one second apart for each user of the event log (seconds since 2024)."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(C("ts").cast("timestamp")) - F.lit(1704067200000000)).alias("us"))
    return politeness(e, "user_id", C("us"), "event_id", 1_000_000).select("event_id", "user_id", C("start").cast("long").alias("start_us"))


SQL["politeness_schedule"] = """SELECT event_id, user_id, CAST(max(us - k * 1000000) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) + k * 1000000 AS BIGINT) AS start_us FROM
(SELECT event_id, user_id, epoch_us(ts) - 1704067200000000 AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


def event_counts(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("k"))


SQL["event_counts"] = "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"


def last_events(spark, d):
    """The last six events of every user, oldest first."""
    e = top_k(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6)
    return e.select("user_id", "event_id", C("rank").cast("long").alias("back"))


SQL["last_events"] = "SELECT user_id, event_id, k AS back FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 6"


def stream_hourly_last(spark, d):
    return streams.hourly_last(spark, d)


SQL["stream_hourly_last"] = """SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(s, (ts, event_id)).value AS value, arg_max(s, (ts, event_id)).event_type AS event_type, count(*) AS n
FROM (SELECT *, struct_pack(value := value, event_type := event_type) AS s FROM events) GROUP BY user_id, date_trunc('hour', ts)"""


def stream_first_seen(spark, d):
    return streams.first_seen(spark, d)


SQL["stream_first_seen"] = "SELECT DISTINCT run_id, source_url, content_hash FROM raw_evidence"



def rate_limit(spark, d):
    """Which events of each user pass a limit of two in six hours, refused ones not counted; a fold, so without SQL."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(C("ts").cast("timestamp")).alias("us"))
    return admitted(e, "user_id", "us", "event_id", 2, 6 * 3_600_000_000)


def null_profile(spark, d):
    """Nulls and empty strings of every text column of offers, one row a column (unpivoted)."""
    o = table(spark, d, "offers")
    names = [n for n, t in o.dtypes if t == "string"]
    counts = o.agg(*[F.count_if(C(n).isNull()).alias(f"n_{n}") for n in names], *[F.count_if(C(n) == "").alias(f"e_{n}") for n in names])
    pairs = ", ".join(f"'{n}', n_{n}, e_{n}" for n in names)
    return counts.select(F.expr(f"stack({len(names)}, {pairs}) as (field, nulls, empties)"))


_NAMES = "product_name brand currency region url seller availability listing_title competitor canonical_url exchange_rate_timestamp offer_key run_id canonical_product_id canonical_product_name".split()
SQL["null_profile"] = " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) - count({n}) AS nulls, count(*) FILTER ({n} = '') AS empties FROM offers" for n in _NAMES)

QUERIES = {"rate_limit": rate_limit} | {name: globals()[name] for name in SQL}
