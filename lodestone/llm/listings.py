"""Problem 7: listings of the same product, by probabilistic linkage.

Model number, variant and size (in canonical units) are parsed from every name and title; a listing takes the most usual
of each.  Listings of equal attributes are one class.  Classes are compared within blocks of equal model number, variant
and size: brand, line (equal, a slip apart, different) and price level.  The weights of the fields are fitted by
expectation-maximisation over the counts of the comparison patterns, and links above a posterior of ``LINKED`` are
clustered as connected components.

A model number is a word and four digits in the first place; a listing whose texts have none is read by the other forms:
letters and digits in one (X200, X-200, 65QN90B), a word and three to six digits, a number alone, a word and one or two digits.
A listing without any is one product by itself.  A missing size or variant is a value of its own; a missing brand or line is
neither for nor against, but a pair needs one of the two.  Rows without a canonical_url are no listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.session import materialise, table

LINKED = 0.5
#: Units of size with their kind and what one is worth in the kind's canonical unit.
UNITS = {
    "mah": ("mah", 1.0), "ah": ("mah", 1000.0), "gb": ("gb", 1.0), "tb": ("gb", 1000.0), "w": ("w", 1.0), "watt": ("w", 1.0), "kw": ("w", 1000.0), "g": ("g", 1.0), "kg": ("g", 1000.0), "lb": ("g", 453.59237),
    "ml": ("ml", 1.0), "cl": ("ml", 10.0), "l": ("ml", 1000.0), "litre": ("ml", 1000.0), "inch": ("in", 1.0), "in": ("in", 1.0), '"': ("in", 1.0), "”": ("in", 1.0), "cm": ("in", 1 / 2.54),
}
#: Steps to which canonical sizes are rounded, as conversions in the texts are themselves rounded.
STEPS = {"mah": 10.0, "gb": 1.0, "w": 10.0, "g": 50.0, "ml": 10.0, "in": 0.5}
_UNITS = r"mAh|Ah|GB|TB|kW|watt|W|kg|lb|g|ml|cl|litre|L|inch|in|cm"
SIZE = rf'(?i)(?<![\d.,\p{{L}}-])(\d+(?:[.,]\d+)*)[ -]?({_UNITS}|"|”)(?!\p{{L}})'
MODEL = (
    r"(?i)(?<!\p{L})(\p{L}{2,})[ -](?:\p{L}{2}[ -]?)?(\d{4})(?!\d)"
    rf"(?![.,]\d)(?![ -]?(?:(?:{_UNITS}|edition|cents|centavos|pence|k|thousand|USD|EUR|GBP|INR|JPY|CAD|AUD|SGD|BRL)(?!\p{{L}})|[万円€£₹\"”]))"
    r"(?:[ -](Pro|Lite|Plus|Max|Mini|Ultra|Air|SE|Gen[ -]?\d+)(?!\p{L}))?"
)

#: What makes a number a measure, count or price rather than a model number, behind it and before it.
_CODES = "USD|EUR|GBP|INR|JPY|CAD|AUD|SGD|BRL"
_COUNTED = (
    r"watts?|litres?|liters?|inche?s?|mm|m|oz|lbs|kgs|V|volts?|A|[kMG]?Hz|[kM]B|MP|p|px|dpi|fps|rpm|bar|nits|k|thousand|x|pcs|pieces?|packs?|sheets?|pages?|reviews?|ratings?|stars?|off|percent|degrees?|"
    rf"years?|months?|weeks?|days?|hours?|hrs?|h|min|st|nd|rd|th|edition|cents|centavos|pence|{_CODES}"
)
_ANNOUNCE = rf"{_CODES}|US|save|was|now|only|from|over|under|up|to|of|for|with|and|or|by|in|at|on|per|top|best|pack|set|gen|generation|mk|version|ver|vol|part|size|type|level|age|ages|since|year|usb|hdmi|wifi|ip|mp|rj|ddr|pcie|bluetooth"
_NUMBERED = "model|no|nr|number|item|art"
_MEASURE = rf"(?:(?:{_UNITS}|{_COUNTED})(?!\p{{L}})|[万円€£₹$¥%\"”°×])"
_END = rf"(?!\d)(?![.,]\d)(?![ -]?{_MEASURE})"
_WORD = rf"(?<!\p{{L}})(?!(?:{_ANNOUNCE}|{_NUMBERED})(?!\p{{L}}))"
_VARIANTS = r"(?:Pro|Lite|Plus|Max|Mini|Ultra|Air|SE|Gen[ -]?\d+)(?!\p{L})"
_VARIANT = rf"(?:[ -]?({_VARIANTS}))?(?![\p{{L}}\p{{N}}])"
#: Model numbers of other forms; the groups are line, code, number and variant, in the first line, its letters, number and variant.
SHORTENED = rf"(?i)(?<!\p{{L}})((\p{{L}})\p{{L}}*?(\p{{L}})\p{{L}}*)[ -]\2\3[ -]?(\d{{2,6}}){_END}{_VARIANT}"
JOINED = rf"(?i)(?:(?<!\p{{L}})(\p{{L}}{{2,}})[ -])?(?<![\p{{L}}\p{{N}}\p{{Sc}}])(?!(?:{_ANNOUNCE}|{_NUMBERED})(?!\p{{L}})|[xv]\d(?!\d))(\p{{L}}{{1,2}})-?(\d{{1,6}}(?![.,]\d)(?![ -]{_MEASURE})(?!{_VARIANTS})(?:\p{{L}}{{1,3}}\d{{0,3}})?|\d{{1,6}}){_VARIANT}"
DIGITS_FIRST = rf"(?i)(?:(?<!\p{{L}})(\p{{L}}{{2,}})[ -])?(?<![\p{{L}}\p{{N}}\p{{Sc}}.,-])(?!\d+(?:x|in)\d)()(\d{{1,6}}\p{{L}}{{1,3}}\d{{1,6}}\p{{L}}{{0,3}}|\d{{3,6}}(?!{_MEASURE}|{_VARIANTS})\p{{L}}{{1,2}}){_VARIANT}"
SPACED = rf"(?i)(?:(?<!\p{{L}})(\p{{L}}{{2,}})[ -])?{_WORD}(\p{{L}}{{1,2}}) (\d{{2,6}}){_END}{_VARIANT}"
PLAIN = rf"(?i){_WORD}(\p{{L}}{{3,}})[ -]?()(\d{{3,6}}){_END}{_VARIANT}"
ALONE = rf"(?i)(?<![\p{{L}}\p{{N}}\p{{Sc}}.,-])(?<!\p{{Sc}} )(?<!(?<!\p{{L}})(?:{_ANNOUNCE}) )()()(\d{{3,6}}){_END}{_VARIANT}"
SHORT = rf"(?i){_WORD}(\p{{L}}{{3,}})[ -]?()(\d{{1,2}}){_END}{_VARIANT}"


def size_of(text: Column) -> Column:
    """The first size in a text as "kind:amount" in canonical units; null without one."""
    number, unit = F.regexp_extract(text, SIZE, 1), F.lower(F.regexp_extract(text, SIZE, 2))
    amount = F.when(number.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(number, F.lit(","), F.lit(""))).otherwise(F.replace(number, F.lit(","), F.lit("."))).try_cast("double")
    entry = lambda k: F.create_map(*[F.lit(x) for u, v in UNITS.items() for x in (u, v[k])])[unit]
    kind = entry(0)
    step = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])[kind]
    return F.when(unit != "", F.concat(kind, F.lit(":"), (F.floor(amount * entry(1) / step + 0.5) * step).cast("string")))


def brand_of(brand: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(brand), r"\b(?:inc|official|ltd|co|gmbh|store)\b\.?|[^\p{L}\p{N} ]", " ")), F.lit(""))


def read_as(text: Column, form: str, groups: tuple = (1, 2, 3, 4)) -> Column:
    """ "model|line|variant" of a text by one of the other forms, null without."""
    line, code, number, variant = (F.lower(F.regexp_extract(text, form, k)) if k else F.lit("") for k in groups)
    return F.when(number != "", F.concat_ws("|", F.concat(code, number), line, F.regexp_replace(variant, r"[ -]", "")))


def readings(text: Column) -> list[Column]:
    """What the other forms read, in the order in which a listing's readings are believed: with letters, digits, one or two digits."""
    shortened = read_as(text, SHORTENED, (1, 0, 4, 5))  # two letters of the line are no part of the model
    lettered = F.coalesce(*[read_as(text, form) for form in (JOINED, DIGITS_FIRST, SPACED)])
    digits = F.when(lettered.isNull(), F.coalesce(read_as(text, PLAIN), read_as(text, ALONE)))
    return [F.when(shortened.isNull(), lettered), F.coalesce(shortened, digits), read_as(text, SHORT)]


def parsed(offers: DataFrame) -> DataFrame:
    """(url, brand, line, model, variant, size, usd) of every listing, also of those without a text or model number."""
    texts = offers.where(F.col("canonical_url").isNotNull()).select(F.col("canonical_url").alias("url"), F.explode(F.array("product_name", "listing_title")).alias("text")).where(F.col("text").isNotNull())
    texts = texts.groupBy("url", "text").agg(F.count("*").alias("n"))
    m = lambda k: F.nullif(F.regexp_extract("text", MODEL, k), F.lit(""))
    others = ["lettered", "digits", "short"]
    other = [F.when(m(2).isNull(), c).alias(n) for n, c in zip(others, readings(F.col("text")), strict=True)]
    fields = texts.select("url", F.lower(m(1)).alias("line"), m(2).alias("model"), F.when(m(2).isNotNull(), F.lower(F.regexp_replace(F.regexp_extract("text", MODEL, 3), r"[ -]", ""))).alias("variant"), size_of(F.col("text")).alias("size"), *other)
    most = fields.groupBy("url").agg(*[F.mode(c, True).alias(c) for c in ("line", "model", "variant", "size", *others)])
    rows = offers.where(F.col("canonical_url").isNotNull()).groupBy(F.col("canonical_url").alias("url")).agg(F.mode(brand_of(F.col("brand")), True).alias("brand"), F.percentile_approx("normalized_price_usd", 0.5, 100).alias("usd"))
    # where another text has the same number behind a line, two letters before it shorten a line with a slip
    slip = F.col("digits").rlike(r"^\d+\|.") & (F.regexp_extract("lettered", r"^\p{L}{2}(\d+)\|", 1) == F.substring_index("digits", "|", 1))
    read = F.split(F.when(slip, F.col("digits")).otherwise(F.coalesce(*others)), r"\|")
    maker = F.array_contains(F.split(F.coalesce("brand", F.lit("")), " "), read[1])  # the brand before a number is no line
    has = F.col("model").isNotNull()
    return rows.join(most, "url", "left").select(
        "url", "brand", F.when(has, F.col("line")).otherwise(F.when(maker, "").otherwise(read[1])).alias("line"), F.coalesce("model", read[0]).alias("model"),
        F.when(has, F.col("variant")).otherwise(read[2]).alias("variant"), "size", "usd",
    )


def compared(classes: DataFrame) -> DataFrame:
    """(a, b, brand, line, price) of the pairs of classes in a block; comparison levels are small integers.

    An unknown line says nothing (3); another word before a model number with letters of its own need not be a line and has a
    weight of its own (4).
    """
    fields = ("class_id", "brand", "line", "usd")
    keys = ["model", "variant", "size"]
    left = classes.select(*keys, *[F.col(f).alias(f"{f}_a") for f in fields])
    right = classes.select(*keys, *[F.col(f).alias(f"{f}_b") for f in fields])
    c = F.col
    pairs = left.join(right, keys).where("class_id_a < class_id_b")
    letters = lambda x: F.array_sort(F.split(x, ""))
    slip = (F.levenshtein("line_a", "line_b") <= 1) | (letters(c("line_a")) == letters(c("line_b")))
    apart = F.abs(F.log(F.try_divide(c("usd_a"), c("usd_b"))))
    return pairs.select(
        F.col("class_id_a").alias("a"), F.col("class_id_b").alias("b"),
        F.when(c("brand_a").isNull() | c("brand_b").isNull(), 2).when((c("brand_a") == c("brand_b")) | (F.levenshtein("brand_a", "brand_b") <= 1), 1).otherwise(0).alias("brand"),
        F.when((c("line_a") == "") | (c("line_b") == ""), 3).when(c("line_a") == c("line_b"), 2).when(slip, 1).when(c("model").rlike(r"\p{L}"), 4).otherwise(0).alias("line"),
        F.when(apart.isNull(), 2).when(apart < 0.35, 1).otherwise(0).alias("price"),
    )


#: Comparison levels of each field, and which of them says nothing.
LEVELS = {"brand": (0, 1), "line": (0, 1, 2, 4), "price": (0, 1)}


def fit_weights(counts: list[dict], rounds: int = 200) -> dict[tuple, float]:
    """Posterior of a match for every pattern, from the counts of the patterns, by expectation-maximisation."""
    match = {"brand": {0: 0.02, 1: 0.98}, "line": {0: 0.02, 1: 0.18, 2: 0.80, 4: 0.30}, "price": {0: 0.1, 1: 0.9}}
    other = {"brand": {0: 0.97, 1: 0.03}, "line": {0: 0.96, 1: 0.02, 2: 0.02, 4: 0.96}, "price": {0: 0.7, 1: 0.3}}
    share, posterior = 0.5, {}
    for _ in range(rounds):
        posterior = {}
        for r in counts:
            pm, pu = share, 1 - share
            for f, levels in LEVELS.items():
                if r[f] in levels:
                    pm, pu = pm * match[f][r[f]], pu * other[f][r[f]]
            posterior[r["brand"], r["line"], r["price"]] = pm / (pm + pu)
        weight = [(r, r["n"] * posterior[r["brand"], r["line"], r["price"]]) for r in counts]
        total = sum(r["n"] for r in counts)
        share = min(0.99, max(0.01, (sum(w for _, w in weight) + 1) / (total + 2)))
        for f, levels in LEVELS.items():
            known = [(r[f], w, r["n"] - w) for r, w in weight if r[f] in levels]
            for table_, k in ((match, 1), (other, 2)):
                # the starting values count as a few pairs, so that rare levels keep their meaning
                prior = {v: 20 * table_[f][v] for v in levels}
                table_[f] = {v: (sum(x[k] for x in known if x[0] == v) + prior[v]) / (sum(x[k] for x in known) + 20) for v in levels}
    return posterior


def clustered(listings: DataFrame) -> DataFrame:
    """(url, cluster) of listings as parsed, all with a model number."""
    listings = listings.fillna("", ["variant", "size", "line"])
    names = ["brand", "line", "model", "variant", "size"]
    bare = F.when(F.col("brand").isNull() & (F.col("line") == ""), F.col("url"))  # a number alone makes no class; null adds nothing to the hash
    listings = listings.withColumn("class_id", F.xxhash64(*[F.coalesce(n, F.lit("\0")) for n in names], bare))
    classes = materialise(listings.groupBy("class_id", *names).agg(F.percentile_approx("usd", 0.5, 100).alias("usd")))
    pairs = materialise(compared(classes))
    counts = [r.asDict() for r in pairs.groupBy("brand", "line", "price").agg(F.count("*").alias("n")).collect()]  # at most 45 patterns
    yes = [k for k, p in fit_weights(counts).items() if p >= LINKED and k[:2] != (2, 3)]  # a number alone links nothing
    keep = F.array(*[F.lit("%d%d%d" % k) for k in yes]) if yes else F.array().cast("array<string>")
    links = pairs.where(F.array_contains(keep, F.concat("brand", "line", "price"))).select("a", "b")
    clusters = connected_components(links)
    return listings.join(clusters.withColumnRenamed("node", "class_id"), "class_id", "left").select("url", F.coalesce("component", "class_id").alias("cluster"))


def linked(offers: DataFrame) -> DataFrame:
    """(url, cluster) of every listing with a model number; cluster is a number shared by the listings of one product."""
    return clustered(materialise(parsed(offers).where(F.col("model").isNotNull())))


def grouped(offers: DataFrame) -> DataFrame:
    """(url, cluster) of every listing; one without a model number is a cluster of its own."""
    listings = materialise(parsed(offers))
    alone = listings.where(F.col("model").isNull()).select("url", F.xxhash64(F.lit("url"), "url").alias("cluster"))
    return clustered(listings.where(F.col("model").isNotNull())).unionByName(alone)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialise(linked(table(spark, sf_dir, "offers")))
    return found.select("cluster", F.col("url").alias("url_a")).join(found.select("cluster", F.col("url").alias("url_b")), "cluster").where("url_a < url_b").select("url_a", "url_b")


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "offers"))


QUERIES = {"p7_found": p7_found, "p7_groups": p7_groups}
SQL: dict[str, str] = {}
