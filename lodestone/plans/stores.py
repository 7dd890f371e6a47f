"""Scans, keyed writes, run bookkeeping and joins over the stores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import parsed_date, product_key
from lodestone.functions.urls import canonical, host, host_suffixes
from lodestone.operators.series import top_k
from lodestone.operators.upsert import insert_ignore, latest, merged, pending
from lodestone.session import table

SQL: dict[str, str] = {}
C = F.col


def recent_offers(spark, d):
    """The 100 newest offers in one region whose name matches, newest first (the limit is the feature)."""
    o = table(spark, d, "offers").where(C("product_name").ilike("%tablet%") & (C("region") == "US"))
    return o.orderBy(F.desc("scraped_at"), F.desc("id")).limit(100).select("id", "product_name", "region", "seller", "scraped_at")


SQL["recent_offers"] = "SELECT id, product_name, region, seller, scraped_at FROM offers WHERE product_name ILIKE '%tablet%' AND region = 'US' ORDER BY scraped_at DESC, id DESC LIMIT 100"


def evidence_listing(spark, d):
    e = table(spark, d, "raw_evidence")
    return e.select("id", "run_id", "source_url", "scraped_at", F.length("content").cast("long").alias("size"))


SQL["evidence_listing"] = "SELECT id, run_id, source_url, scraped_at, CAST(length(content) AS BIGINT) AS size FROM raw_evidence"


def latest_evidence(spark, d):
    """The newest capture of every URL and run, content hash only."""
    e = table(spark, d, "raw_evidence").where(C("source_url").isNotNull())
    return e.groupBy("run_id", "source_url").agg(F.max("id").alias("id"), F.max_by("content_hash", "id").alias("content_hash"))


SQL["latest_evidence"] = "SELECT run_id, source_url, max(id) AS id, arg_max(content_hash, id) AS content_hash FROM raw_evidence WHERE source_url IS NOT NULL GROUP BY run_id, source_url"


def pages_without_text(spark, d):
    """Page metadata; the text column is never read."""
    return table(spark, d, "research_pages").select("id", "run_id", "url", "status", "http_status", "depth", "origin", "chars")


SQL["pages_without_text"] = "SELECT id, run_id, url, status, http_status, depth, origin, chars FROM research_pages"


def offer_counts_by_run(spark, d):
    n = table(spark, d, "offers").groupBy("run_id").agg(F.count("*").alias("offers"), F.count_distinct("region").alias("regions"))
    return table(spark, d, "research_runs").select("run_id", "status").join(n, "run_id", "left").select("run_id", "status", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("regions", F.lit(0)).alias("regions"))


SQL["offer_counts_by_run"] = """SELECT r.run_id, r.status, coalesce(o.offers, 0) AS offers, coalesce(o.regions, 0) AS regions FROM research_runs r
LEFT JOIN (SELECT run_id, count(*) AS offers, count(DISTINCT region) AS regions FROM offers GROUP BY run_id) o USING (run_id)"""


def distinct_products(spark, d):
    return table(spark, d, "offers").select(F.coalesce("canonical_product_id", "product_name").alias("product")).distinct()


SQL["distinct_products"] = "SELECT DISTINCT coalesce(canonical_product_id, product_name) AS product FROM offers"


def coverage_by_run(spark, d):
    p, s = table(spark, d, "research_pages"), table(spark, d, "research_sections")
    pages = p.groupBy("run_id").agg(F.count("*").alias("pages"), F.count_if(C("error").isNotNull()).alias("failed"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.max("depth").alias("deepest"))
    sections = s.groupBy("run_id").agg(F.count("*").alias("sections"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words"))
    return pages.join(sections, "run_id", "left").select("run_id", "pages", "failed", "chars", "deepest", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("words", F.lit(0)).alias("words"))


SQL["coverage_by_run"] = """SELECT p.run_id, pages, failed, chars, deepest, coalesce(sections, 0) AS sections, coalesce(words, 0) AS words FROM
(SELECT run_id, count(*) AS pages, count(error) AS failed, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, max(depth) AS deepest FROM research_pages GROUP BY run_id) p
LEFT JOIN (SELECT run_id, count(*) AS sections, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM research_sections GROUP BY run_id) s ON p.run_id = s.run_id"""


def run_json(spark, d):
    """Plan and coverage decoded from JSON text, with defaults."""
    r = table(spark, d, "research_runs")
    plan = F.from_json("plan", "sub_questions array<string>, max_pages bigint")
    cover = F.from_json("coverage", "pages bigint, failed bigint")
    return r.select("run_id", F.coalesce(F.size(plan.sub_questions).cast("long"), F.lit(0)).alias("questions"), F.coalesce(plan.max_pages, F.lit(0)).alias("max_pages"), F.coalesce(cover.pages, F.lit(0)).alias("pages"), F.coalesce(cover.failed, F.lit(0)).alias("failed"))


SQL["run_json"] = """SELECT run_id, coalesce(CAST(json_array_length(plan, '$.sub_questions') AS BIGINT), 0) AS questions, coalesce(CAST(json_extract_string(plan, '$.max_pages') AS BIGINT), 0) AS max_pages,
coalesce(CAST(json_extract_string(coverage, '$.pages') AS BIGINT), 0) AS pages, coalesce(CAST(json_extract_string(coverage, '$.failed') AS BIGINT), 0) AS failed FROM research_runs"""


def upsert_offers(spark, d):
    """What a keyed store holds after all offers in arrival order: eight columns keep the last value, the others the first."""
    o = table(spark, d, "offers").select("offer_key", "id", "product_name", "region", "url", "price", "currency", "seller", "availability", "listing_title", "scraped_at", "run_id")
    return merged(o, ["offer_key"], [C("id")], ["price", "currency", "seller", "availability", "listing_title", "scraped_at", "run_id"])


SQL["upsert_offers"] = """SELECT offer_key, arg_min(f, id).id AS id, arg_min(f, id).product_name AS product_name, arg_min(f, id).region AS region, arg_min(f, id).url AS url, arg_max(l, id).price AS price, arg_max(l, id).currency AS currency,
arg_max(l, id).seller AS seller, arg_max(l, id).availability AS availability, arg_max(l, id).listing_title AS listing_title, arg_max(l, id).scraped_at AS scraped_at, arg_max(l, id).run_id AS run_id FROM
(SELECT offer_key, id, struct_pack(id := id, product_name := product_name, region := region, url := url) AS f,
struct_pack(price := price, currency := currency, seller := seller, availability := availability, listing_title := listing_title, scraped_at := scraped_at, run_id := run_id) AS l FROM offers) GROUP BY offer_key"""


def upsert_reviews(spark, d):
    """The last version of every review; versions of one time and run by text, rating and name, greatest last."""
    r = table(spark, d, "reviews").select("id", "product_name", "rating", "review_text", "scraped_at", "run_id")
    return latest(r, ["id"], [C("scraped_at"), C("run_id"), C("review_text"), C("rating"), C("product_name")]).select("id", "product_name", "rating", "review_text", "scraped_at")


SQL["upsert_reviews"] = """SELECT id, product_name, rating, review_text, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scraped_at DESC NULLS LAST, run_id DESC NULLS LAST,
review_text DESC NULLS LAST, rating DESC NULLS LAST, product_name DESC NULLS LAST) AS k FROM reviews) WHERE k = 1"""


def insert_evidence(spark, d):
    """Captures once for each run, source and content; the hash is of the whole text."""
    e = table(spark, d, "raw_evidence").where(C("content").isNotNull()).select("run_id", "source_url", F.sha2("content", 256).alias("stored_hash"), "id", "scraped_at")
    return insert_ignore(e, ["run_id", "source_url", "stored_hash"], [C("id")])


SQL["insert_evidence"] = """SELECT run_id, source_url, sha256(content) AS stored_hash, min(id) AS id, arg_min(scraped_at, id) AS scraped_at FROM raw_evidence WHERE content IS NOT NULL GROUP BY run_id, source_url, stored_hash"""


def pending_pages(spark, d):
    """Pages of URLs that no successful fetch of any run covers."""
    p = table(spark, d, "research_pages")
    return pending(p.where(C("error").isNotNull()).select("id", "canonical_url"), p.where("text <> ''"), ["canonical_url"])


SQL["pending_pages"] = "SELECT id, canonical_url FROM research_pages p WHERE error IS NOT NULL AND NOT EXISTS (SELECT 1 FROM research_pages q WHERE q.text <> '' AND q.canonical_url = p.canonical_url)"


def page_changes(spark, d):
    """Pages of a run against its predecessor: added, gone, changed or same, by a full outer join of the two newest runs of each URL host."""
    p = table(spark, d, "research_pages").where(C("text") != "").select(host(C("url")).alias("host"), "url", "run_id", "content_hash", "fetched_at", "id")
    days = p.groupBy("host", F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))
    ranked = days.withColumn("r", F.row_number().over(W.partitionBy("host").orderBy(F.desc("day")))).where("r <= 2").select("host", "day", "r")
    rows = p.withColumn("day", F.to_date("fetched_at")).join(ranked, ["host", "day"]).groupBy("host", "url", "r").agg(F.max_by("content_hash", "id").alias("hash"))
    new, old = rows.where("r = 1").select("host", "url", C("hash").alias("new_hash")), rows.where("r = 2").select("host", "url", C("hash").alias("old_hash"))
    kind = F.when(C("old_hash").isNull(), "added").when(C("new_hash").isNull(), "gone").when(C("old_hash") == C("new_hash"), "same").otherwise("changed")
    return new.join(old, ["host", "url"], "full").select("host", "url", kind.alias("change"))


SQL["page_changes"] = r"""WITH p AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, url, content_hash, CAST(fetched_at AS DATE) AS day, id FROM research_pages WHERE text <> ''),
k AS (SELECT host, day, row_number() OVER (PARTITION BY host ORDER BY day DESC) AS r FROM (SELECT DISTINCT host, day FROM p)),
x AS (SELECT p.host, p.url, k.r, arg_max(content_hash, id) AS hash FROM p JOIN k ON p.host = k.host AND p.day = k.day AND k.r <= 2 GROUP BY ALL)
SELECT coalesce(n.host, o.host) AS host, coalesce(n.url, o.url) AS url, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'gone' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS change
FROM (SELECT * FROM x WHERE r = 1) n FULL JOIN (SELECT * FROM x WHERE r = 2) o ON n.host = o.host AND n.url = o.url"""


def canonical_urls(spark, d):
    """Every recorded address with its canonical form and hash."""
    return table(spark, d, "offers").select("id", canonical(C("url")).alias("canonical"), F.sha2(canonical(C("url")), 256).alias("url_hash"))


_PARTS = r"""regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query'])"""
_ENCODE = "replace(url_encode(url_decode(replace({0}, '+', ' '))), '%20', '+')"
_PAIRS = f"""list_transform(list_filter(string_split(u.query, '&'), lambda p: p <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','gclid','fbclid','igshid','ref','spm','scm'],
lower({_ENCODE.format("string_split(p, '=')[1]")}))), lambda p: {_ENCODE.format("string_split(p, '=')[1]")} || '=' || {_ENCODE.format("CASE WHEN contains(p, '=') THEN substring(p, strpos(p, '=') + 1) ELSE '' END")})"""
_PATH = "rtrim(regexp_replace(u.path, ';[^/]*$', ''), '/')"
_CANONICAL = f"""((CASE WHEN u.scheme = '' THEN 'https' ELSE lower(u.scheme) END) || '://' || lower(u.host) || (CASE WHEN {_PATH} = '' THEN '/' WHEN {_PATH} LIKE '/%' THEN {_PATH} ELSE '/' || {_PATH} END)
|| (CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string({_PAIRS}, '&') ELSE '' END))"""
SQL["canonical_urls"] = f"SELECT id, {_CANONICAL} AS canonical, sha256({_CANONICAL}) AS url_hash FROM (SELECT id, {_PARTS} AS u FROM offers)"


def dedupe_urls(spark, d):
    """The first row of every canonical address."""
    o = table(spark, d, "offers").where(C("url").isNotNull()).select(canonical(C("url")).alias("canonical"), "id", "url")
    return o.groupBy("canonical").agg(F.min("id").alias("id"), F.min_by("url", "id").alias("url"), F.count("*").alias("copies"))


SQL["dedupe_urls"] = f"SELECT {_CANONICAL} AS canonical, min(id) AS id, arg_min(url, id) AS url, count(*) AS copies FROM (SELECT id, url, {_PARTS} AS u FROM offers WHERE url IS NOT NULL) GROUP BY 1"


def host_attribution(spark, d):
    """Pages attributed to the run target with the longest matching host suffix: suffixes exploded, then an equi join."""
    pages = table(spark, d, "research_pages").select("id", host(C("url")).alias("host"))
    targets = table(spark, d, "research_runs").select(host(C("target_url")).alias("suffix")).where("suffix <> ''").distinct()
    met = pages.select("id", F.explode(host_suffixes(C("host"))).alias("suffix")).join(targets, "suffix")
    return met.groupBy("id").agg(F.max_by("suffix", F.length("suffix")).alias("target"))


_HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"
SQL["host_attribution"] = f"""SELECT p.id, arg_max(t.suffix, length(t.suffix)) AS target FROM (SELECT id, {_HOST.format('url')} AS host FROM research_pages) p
JOIN (SELECT DISTINCT {_HOST.format('target_url')} AS suffix FROM research_runs) t ON t.suffix <> '' AND (p.host = t.suffix OR ends_with(p.host, '.' || t.suffix)) GROUP BY p.id"""


def run_overview(spark, d):
    """Runs with their newest page and counts of pages."""
    p = table(spark, d, "research_pages").groupBy("run_id").agg(F.count("*").alias("pages"), F.max_by("url", F.struct("fetched_at", "id")).alias("last_url"), F.max("fetched_at").alias("last_at"))
    return table(spark, d, "research_runs").select("run_id", "mode", "status").join(p, "run_id", "left").select("run_id", "mode", "status", F.coalesce("pages", F.lit(0)).alias("pages"), "last_url", "last_at")


SQL["run_overview"] = """SELECT r.run_id, mode, status, coalesce(pages, 0) AS pages, last_url, last_at FROM research_runs r LEFT JOIN
(SELECT run_id, count(*) AS pages, arg_max(url, (fetched_at, id)) AS last_url, max(fetched_at) AS last_at FROM research_pages GROUP BY run_id) p USING (run_id)"""


def run_sources_union(spark, d):
    """Runs known from any store, once each, with the store that names it first in order of precedence."""
    stores = ["research_runs", "research_pages", "raw_evidence", "offers", "reviews"]
    rows = None
    for rank, name in enumerate(stores):
        part = table(spark, d, name).where(C("run_id").isNotNull()).groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(rank).alias("rank"), F.lit(name).alias("store"), "n")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("run_id").agg(F.min_by("store", "rank").alias("store"), F.sum("n").alias("records"), F.count("*").alias("stores"))


SQL["run_sources_union"] = "SELECT run_id, arg_min(store, rank) AS store, CAST(sum(n) AS BIGINT) AS records, count(*) AS stores FROM (" + " UNION ALL ".join(
    f"SELECT run_id, {k} AS rank, '{s}' AS store, count(*) AS n FROM {s} WHERE run_id IS NOT NULL GROUP BY run_id" for k, s in enumerate(["research_runs", "research_pages", "raw_evidence", "offers", "reviews"])
) + ") GROUP BY run_id"


def citations(spark, d):
    """The first section of each source of a run, numbered by the source reference."""
    s = table(spark, d, "research_sections").where(C("source_ref").isNotNull())
    first = s.groupBy("run_id", "source_ref").agg(F.min_by(F.struct("id", "url", "title", "heading"), "id").alias("s"), F.count("*").alias("sections"))
    return first.select("run_id", "source_ref", F.regexp_replace("source_ref", r"\D", "").try_cast("bigint").alias("number"), "s.id", "s.url", "s.title", "s.heading", "sections")


SQL["citations"] = r"""SELECT run_id, source_ref, TRY_CAST(regexp_replace(source_ref, '\D', '', 'g') AS BIGINT) AS number, min(id) AS id, arg_min(url, id) AS url, arg_min(title, id) AS title, arg_min(heading, id) AS heading, count(*) AS sections
FROM research_sections WHERE source_ref IS NOT NULL GROUP BY run_id, source_ref"""


def host_caps(spark, d):
    """At most eight pages a host and run, by relevance, then id."""
    p = table(spark, d, "research_pages").select("id", "run_id", host(C("url")).alias("host"), "relevance")
    return top_k(p, ["run_id", "host"], [C("relevance").desc_nulls_last(), C("id")], 8).select("id", "run_id", "host", C("rank").cast("long").alias("rank"))


SQL["host_caps"] = f"SELECT id, run_id, host, k AS rank FROM (SELECT id, run_id, host, row_number() OVER (PARTITION BY run_id, host ORDER BY relevance DESC NULLS LAST, id) AS k FROM (SELECT *, {_HOST.format('url')} AS host FROM research_pages)) WHERE k <= 8"


def running_budget(spark, d):
    """Sections of a run in order while their lengths fit in 14,000 characters; the first overflow ends the list."""
    w = W.partitionBy("run_id").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    s = table(spark, d, "research_sections").select("run_id", "id", F.length("content").cast("long").alias("n"))
    return s.withColumn("total", F.sum("n").over(w)).where("total <= 14000").select("run_id", "id", "total")


SQL["running_budget"] = "SELECT run_id, id, total FROM (SELECT run_id, id, CAST(sum(length(content)) OVER (PARTITION BY run_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM research_sections) WHERE total <= 14000"


def provider_chain(spark, d):
    """The scrapers of each run in order of first use, each once."""
    p = table(spark, d, "research_pages").where(C("scraper").isNotNull()).groupBy("run_id", "scraper").agg(F.min(F.struct("fetched_at", "id")).alias("at"))
    return p.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "scraper"))), lambda x: x.scraper).alias("c")).select("run_id", F.array_join("c", " > ").alias("chain"))


SQL["provider_chain"] = "SELECT run_id, string_agg(scraper, ' > ' ORDER BY first_use) AS chain FROM (SELECT run_id, scraper, min((fetched_at, id)) AS first_use FROM research_pages WHERE scraper IS NOT NULL GROUP BY run_id, scraper) GROUP BY run_id"


def review_dates(spark, d):
    """Dates read from their written forms; free text gives null."""
    return table(spark, d, "reviews").select("id", "scraped_at", parsed_date(C("review_date")).alias("review_day"))


SQL["review_dates"] = r"""SELECT id, scraped_at, coalesce(TRY_CAST(NULLIF(regexp_extract(trim(review_date), '^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$', 1), '') AS DATE),
CAST(try_strptime(trim(review_date), '%d/%m/%Y') AS DATE), CAST(try_strptime(trim(review_date), '%m/%d/%Y') AS DATE), CAST(try_strptime(trim(review_date), '%d %b %Y') AS DATE),
CAST(try_strptime(trim(review_date), '%B %d, %Y') AS DATE), CAST(try_strptime(trim(review_date), '%b %d, %Y') AS DATE)) AS review_day FROM reviews"""


def product_identity(spark, d):
    """Products as named, with their folded key and id."""
    names = table(spark, d, "offers").where(C("product_name").isNotNull()).groupBy("product_name").agg(F.count("*").alias("offers"))
    return names.select("product_name", product_key(C("product_name")).alias("product_key"), F.substring(F.sha2(product_key(C("product_name")), 256), 1, 16).alias("product_id"), "offers")


_FOLD = """list_filter(list_transform(regexp_extract_all(lower(product_name), '[a-z0-9]+'), lambda w: CASE w WHEN 'headset' THEN 'headphones' WHEN 'earphone' THEN 'headphones' ELSE w END),
lambda w: NOT list_contains(['with','the','and','series','edition','new','plus','model'], w))"""
_KEY = "CASE WHEN len(k) >= 2 THEN array_to_string(k, ' ') WHEN plain = '' THEN 'unknown' ELSE plain END"
SQL["product_identity"] = f"""SELECT product_name, {_KEY} AS product_key, substring(sha256({_KEY}), 1, 16) AS product_id, offers FROM
(SELECT product_name, list_transform(list_filter(list_zip(f, range(1, len(f) + 1)), lambda x: list_position(f, x[1]) = x[2]), lambda x: x[1]) AS k, trim(regexp_replace(regexp_replace(lower(product_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS plain, offers FROM
(SELECT product_name, {_FOLD} AS f, count(*) AS offers FROM offers WHERE product_name IS NOT NULL GROUP BY product_name))"""


def region_fanout(spark, d):
    """Every listing with every region that any of its rows names or its product sells in, each once: a join on the product, not a cross join."""
    o = table(spark, d, "offers").where(C("canonical_url").isNotNull() & C("canonical_product_id").isNotNull())
    return o.select("canonical_url", "canonical_product_id").distinct().join(o.select("canonical_product_id", C("region").alias("target_region")).distinct(), "canonical_product_id").select("canonical_url", "target_region").distinct()


SQL["region_fanout"] = """SELECT DISTINCT a.canonical_url, b.region AS target_region FROM offers a JOIN (SELECT DISTINCT canonical_product_id, region FROM offers) b ON a.canonical_product_id = b.canonical_product_id WHERE a.canonical_url IS NOT NULL"""


def field_agreement(spark, d):
    """How often two fields of an offer agree, by region: an accuracy report without labels."""
    brand = F.trim(F.regexp_replace(F.lower("brand"), r"\s*inc\.?$", ""))
    o = table(spark, d, "offers").select("region", (brand == F.lower("competitor")).alias("b"), (C("url") == C("canonical_url")).alias("u"), C("extraction_confidence").isNotNull().alias("c"))
    return o.groupBy("region").agg(F.count("*").alias("offers"), F.count_if("b").alias("brand_is_competitor"), F.count_if("u").alias("url_is_clean"), F.count_if("c").alias("with_confidence"))


SQL["field_agreement"] = r"""SELECT region, count(*) AS offers, count(*) FILTER (trim(regexp_replace(lower(brand), '\s*inc\.?$', '')) = lower(competitor)) AS brand_is_competitor, count(*) FILTER (url = canonical_url) AS url_is_clean,
count(extraction_confidence) AS with_confidence FROM offers GROUP BY region"""

QUERIES = {name: globals()[name] for name in SQL}
