"""Problem 3: template residue, filler, error pages and script notices, by SimHash tables, verified similarity and label spread.

Texts and fetch errors are taken apart into units: lines, delimited stretches (between braces, brackets or twin signs) and
words, masked (numbers, codes, hosts; letters of a stretch) and folded.  Trusted labels come from values known to be proper
(pages whose body is known) or improper (pages that were fetched but have no body, errors of pages that were fetched):
a unit is trusted residue if no proper page has it and it comes in more improper pages than chance allows, over all such units
of its kind (``CHANCE``); an error's, if it is on fetched pages ``TIMES`` as often as errors are.  A few well-known wordings
(``SEEDS``) are trusted too.  Labels spread from unit to unit through near-duplicate links until none is new, which labels
the components that hold a trusted unit: lines meet in ``TABLES`` partitions of SimHash bits, and a link needs a Hamming
distance of ``HAMMING`` at most and an edit similarity of ``SIMILARITY``.  A unit of a proper page is never labelled.
Rows are residue by their units alone.  Null and empty texts and errors are no cases; texts count whole, whatever their size.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.pages import STRETCH, page_bodies, page_texts, pages_without_body
from lodestone.session import materialise, table

#: Expected number of units of a kind that are trusted by chance; how much more common than usual an error must be on fetched pages.
CHANCE, TIMES = 0.05, 2.0
SIMILARITY, HAMMING = 0.8, 18
#: Partitions of sampled SimHash bits, and bits of each.
TABLES, BITS = 40, 12
#: Labelled units are sent to all tasks up to this number; more are joined.
SMALL = 200_000
#: Well-known wording of filler and of servers, trusted without evidence.
SEEDS = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
    "Page not found", "Access denied", "Please enable JavaScript to continue.", "You need to enable JavaScript to run this app.", "{{ name }}", "${name}", "<%= name %>", "{% if name %}", "[object Object]", "%s", "undefined",
)
#: Words of a line, and share of them, that must be confined to improper values for the line to fold into the unit of filler.
FILLER_WORDS, FILLER_SHARE = 5, 0.5
_CHOSEN = np.array([np.random.default_rng(t).permutation(64) for t in range(TABLES)])


def masked(values: DataFrame) -> DataFrame:
    """values with `masked`: its text in lower case, hosts, codes and numbers masked; lines stay apart.

    Most texts have no host, code or run of blanks: what each pattern cannot do without is looked for first, as it is cheaper.
    """
    m = F.col("masked")
    has = lambda *parts: reduce(operator.or_, [m.contains(x) for x in parts])
    step = lambda df, first, pattern, mask: df.withColumn("masked", F.when(first, F.regexp_replace(m, pattern, mask)).otherwise(m))
    hosts = step(values.withColumn("masked", F.lower("text")), has(".example", ".com", ".org", ".net"), r"(?<![\w-])(?:[\w-]++\.)+(?:example|com|org|net)\b", "host")
    numbers = hosts.withColumn("masked", F.regexp_replace(m, "[0-9]++", "0"))
    codes = step(numbers, m.rlike("0(?:[a-f]|(?<=[a-f]0))"), r"(?<![a-z0-9])(?:0|[a-f]++0)[0-9a-f]*+(?![a-z0-9])", "0")
    return step(codes, has("  ", "\t", "\r"), r"[ \t\r]{2,}|[\t\r]", " ")


def masked_stretch(stretch) -> F.Column:
    t = F.regexp_replace(F.regexp_replace(stretch, r"[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)*", "A"), r"[A-Z]?[a-z][a-zA-Z_.]*", "a")
    masked = F.regexp_replace(F.regexp_replace(t, r"\d+", "0"), r"A(?: A)+", "A")
    return F.when(stretch.rlike("^[A-Za-z]+$"), stretch).otherwise(masked)


def units_of(values: DataFrame, words: F.Column | None = None) -> DataFrame:
    """values with (kind, unit) of the lines and stretches of its text, and of the words of rows where `words` holds."""
    kept = [c for c in values.columns if c != "text"]
    some = lambda c: F.array_distinct(c).cast("array<string>")
    word = F.when(words if words is not None else F.lit(False), some(F.split(F.lower("text"), r"[^\p{L}]+")))
    raw = masked(values.where("text <> ''")).select(*kept, some(F.split("masked", "\n")).alias("l"), some(F.regexp_extract_all("text", F.lit(STRETCH), 0)).alias("s"), word.alias("w"))
    each = raw.select(*kept, F.stack(F.lit(3), F.lit("line"), "l", F.lit("stretch"), "s", F.lit("word"), "w").alias("kind", "units")).select(*kept, "kind", F.explode("units").alias("unit"))
    return each.withColumn("unit", F.when(F.col("kind") == "stretch", masked_stretch(F.col("unit"))).otherwise(F.trim("unit"))).where("unit <> ''")


def _hash() -> F.Column:
    return F.xxhash64("kind", "unit")


def unit_counts(values: DataFrame) -> DataFrame:
    """(u, kind, unit, proper, improper, on_error, errors): a row a unit; whether proper values have it, copies of improper ones that do, and its errors."""
    some = lambda c: F.when(c, F.lit(1))
    part = units_of(values, words=F.col("trust").isNotNull()).withColumn("u", _hash())
    copy = F.when((F.col("trust") == 1) & (F.col("part") == "text"), F.col("copy"))
    # the text is a key, so that rows are hashed, not sorted; that of proper values is not needed
    text = F.when(F.coalesce("trust", F.lit(1)) == 1, F.col("unit")).alias("unit")
    first = part.groupBy("u", "kind", text, copy.alias("copy")).agg(
        F.max(some(F.col("trust") == 0)).alias("proper"), F.count(some((F.col("part") == "error") & (F.col("trust") == 1))).alias("on_error"), F.count(some(F.col("part") == "error")).alias("errors")
    )
    return first.groupBy("u", "kind").agg(
        F.first("unit", ignorenulls=True).alias("unit"), (F.max("proper") == 1).alias("proper"), F.count("copy").alias("improper"), F.sum("on_error").alias("on_error"), F.sum("errors").alias("errors")
    ).withColumn("proper", F.coalesce("proper", F.lit(False)))


def trusted(counts: DataFrame, values: DataFrame) -> DataFrame:
    """(u, unit, kind) of the units that are residue by the labels of values."""
    spark = counts.sparkSession
    texts, errors = values.where("part = 'text' and text <> ''"), values.where("part = 'error' and text <> ''")
    known = texts.where("trust is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("trust"), F.lit(0)).alias("improper"))
    fetched = errors.agg(F.count("*").alias("n_errors"), F.coalesce(F.sum(F.when(F.col("trust") == 1, 1)), F.lit(0)).alias("n_fetched"))
    tests = counts.where("improper > 1 and not proper").groupBy("kind").agg(F.count("*").alias("n"))
    n, improper, n_errors, n_fetched = (*known.first(), *fetched.first())
    share = min(max(improper / max(n, 1), 1e-6), 0.999999)
    least = {r.kind: max(2, int(np.ceil(np.log(CHANCE / r.n) / np.log(share)))) for r in tests.collect()}  # a row a kind
    enough = lambda n: reduce(operator.or_, [(F.col("kind") == k) & (n >= m) for k, m in least.items()], F.lit(False)) & (F.length("unit") > 1)
    often = lambda on, n: (F.col("kind") == "line") & (on > 0) & (on * F.lit(float(n_errors)) >= n * F.lit(TIMES * n_fetched))
    seeds = units_of(spark.createDataFrame([(s,) for s in SEEDS], "text string")).select(_hash().alias("u"), "unit", "kind")
    known = counts.where(~F.col("proper") & (enough(F.col("improper")) | often(F.col("on_error"), F.col("errors")))).select("u", "unit", "kind")
    return known.unionByName(seeds.join(counts.where("proper").select("u"), "u", "left_anti").join(known.select("u"), "u", "left_anti"))


def simhash(units: list[str]) -> np.ndarray:
    """64 bits of the letter pairs of each unit (padded at both ends), a row of 0 and 1 for each."""
    padded = [f"\x02{u}\x03" for u in units]
    sizes = np.array([len(p) for p in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    last = np.cumsum(sizes)
    keep = np.ones(len(codes), dtype=bool)
    keep[last - 1] = False
    following = np.append(codes[1:], np.zeros(1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = (codes * np.uint64(0x9E3779B97F4A7C15) ^ following * np.uint64(0xC2B2AE3D27D4EB4F))[keep]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    grams = sizes - 1
    begin = np.cumsum(grams) - grams
    # many counts in one word: lanes as wide as the longest unit needs
    wide = 8 if grams.max() < 1 << 8 else 16 if grams.max() < 1 << 16 else 64
    out = np.empty((len(units), 64), dtype=np.uint8)
    ones = np.uint64(sum(1 << lane for lane in range(0, 64, wide)))
    for bit in range(wide):
        sums = np.add.reduceat((h >> np.uint64(bit)) & ones, begin)
        for lane in range(0, 64, wide):
            out[:, lane + bit] = 2 * ((sums >> np.uint64(lane)) & np.uint64((1 << wide) - 1)).astype(np.int64) > grams
    return out


def signed(units: DataFrame, width: int = BITS) -> DataFrame:
    """(u, unit, s, keys): the SimHash of each unit and its key in each partition."""

    powers = np.zeros((64, TABLES))
    for t, chosen in enumerate(_CHOSEN):
        powers[chosen[:width], t] = 2.0 ** np.arange(width)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(pc.utf8_length(batch["unit"]).to_numpy(zero_copy_only=False), kind="stable")  # one long unit widens the lanes of its part only
            for lo in range(0, len(batch), 2_000):
                part = batch.take(pa.array(order[lo : lo + 2_000]))
                bits = simhash(part["unit"].to_pylist())
                keys = (bits @ powers).astype(np.int32).ravel()
                whole = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0]
                ends = np.arange(0, len(keys) + 1, TABLES, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part["u"], part["unit"], pa.array(whole), pa.ListArray.from_arrays(ends, keys)], ["u", "unit", "s", "keys"])

    return units.select("u", "unit").mapInArrow(sign, "u long, unit string, s long, keys array<int>")


def links(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(u1, u): the near-duplicates of the units of `mine` among those of `theirs`; both signed. None of either is met twice."""
    edge = mine.agg(F.min(F.length("unit")), F.max(F.length("unit")), F.count("*")).first()
    # an edit similarity of SIMILARITY bounds the ratio of the lengths
    band = theirs.where(F.length("unit").between(int((edge[0] or 0) * SIMILARITY), int((edge[1] or 0) / SIMILARITY) + 1))
    one = mine.select(F.col("u").alias("u1"), F.col("s").alias("s1"), F.col("unit").alias("unit1"), F.posexplode("keys").alias("t", "k"))
    other = band.select("u", "unit", "s", F.posexplode("keys").alias("t", "k"))
    met = other.join(F.broadcast(one) if edge[2] <= SMALL // TABLES else one, ["t", "k"]).where(F.bit_count(F.col("s").bitwiseXOR(F.col("s1"))) <= HAMMING)
    return met.where(F.levenshtein("unit", "unit1") <= (1 - SIMILARITY) * F.greatest(F.length("unit"), F.length("unit1"))).select("u1", "u").distinct()


def spread(labelled: DataFrame, others: DataFrame) -> DataFrame:
    """(u) of the labelled units and of all that are linked to them, over any number of links; others has u and unit."""
    found, new = labelled.select("u"), materialise(signed(labelled))
    waiting = materialise(signed(others))
    while new.limit(1).count():
        alike = materialise(links(new, waiting).select("u").distinct())
        found = found.unionByName(alike)
        new = materialise(waiting.join(alike, "u", "left_semi"))
        waiting = waiting.join(alike, "u", "left_anti")
    return found


def residue_units(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, trusted) of the lines and stretches that are residue, by their own label or through links; (unit) of the words confined to improper values."""
    counts = materialise(unit_counts(values).where("(kind = 'line' and not proper) or improper > 0 or on_error > 0"))
    seeds = materialise(trusted(counts, values))
    # a line that holds a stretch is residue by the stretch, and near to lines without it
    lines = spread(seeds.where((F.col("kind") == "line") & ~F.col("unit").rlike(STRETCH)), counts.where("kind = 'line' and not proper").join(seeds.select("u"), "u", "left_anti"))
    linked = lines.distinct().join(seeds.select("u"), "u", "left_anti").select("u", F.lit(False).alias("trusted"))
    return materialise(seeds.where("kind <> 'word'").select("u", F.lit(True).alias("trusted")).unionByName(linked)), seeds.where("kind = 'word'").select("unit")


def _sent(df: DataFrame) -> DataFrame:
    """df, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def residue_rows(values: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(tab, id, trusted) of the rows that hold residue: trusted is false where only links to trusted units give the row.

    values has tab, id, part ('text' or 'error'), text, trust (1 known to be improper, 0 to be proper, null) and copy (one
    value for all copies of a page).  Labels come from all values; with `only` (tab, id) just those rows are looked up.
    """
    units, confined = residue_units(values)
    if only is not None:
        values = values.join(_sent(only), ["tab", "id"], "left_semi")
    texts = values.where("text <> '' and coalesce(trust, 1) = 1").select("tab", "id", "text")  # no unit of a proper value is residue
    held = units_of(texts).select("tab", "id", _hash().alias("u")).join(_sent(units), "u").select("tab", "id", "trusted")
    lines = texts.select("tab", "id", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).select("tab", "id", "at", F.filter(F.split("line", r"[^\p{L}]+"), lambda w: w != "").alias("words"))
    words = lines.where(F.size("words") >= FILLER_WORDS).select("tab", "id", "at", F.size("words").alias("n"), F.explode("words").alias("unit"))
    filler = words.join(_sent(confined), "unit").groupBy("tab", "id", "at").agg(F.count("*").alias("k"), F.first("n").alias("n")).where((F.col("k") >= FILLER_WORDS) & (F.col("k") >= FILLER_SHARE * F.col("n")))
    return held.unionByName(filler.select("tab", "id", F.lit(True).alias("trusted"))).groupBy("tab", "id").agg(F.max("trusted").alias("trusted"))


def page_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages and captures and fetch errors, with what is known of them; copies of a page share their title."""
    pages = table(spark, sf_dir, "research_pages")
    labels = page_bodies(spark, sf_dir).select("tab", "id").distinct().withColumn("trust", F.lit(0)).unionByName(pages_without_body(spark, sf_dir).withColumn("trust", F.lit(1)))
    copies = pages.select(F.lit("research_pages").alias("tab"), "id", F.col("id").alias("copy"))
    texts = page_texts(spark, sf_dir).where("text <> ''").select("tab", "id", F.lit("text").alias("part"), "text").join(labels.join(copies, ["tab", "id"], "left"), ["tab", "id"], "left")
    errors = pages.where("error <> ''").select(F.lit("research_pages").alias("tab"), "id", F.lit("error").alias("part"), F.col("error").alias("text"), F.when(F.col("status") == "fetched", 1).alias("trust"), F.lit(None).cast("long").alias("copy"))
    return texts.select("tab", "id", "part", "text", "trust", "copy").unionByName(errors)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_rows(page_values(spark, sf_dir)).select("tab", "id")


def p3_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table and route: units with a trusted label of their own, or only links to such."""
    return residue_rows(page_values(spark, sf_dir)).groupBy("tab", "trusted").agg(F.count("*").alias("rows"))


def p3_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left for analysis, by table."""
    rows = page_texts(spark, sf_dir)
    kept = rows.select("tab", "id").join(p3_found(spark, sf_dir), ["tab", "id"], "left_anti").groupBy("tab").agg(F.count("*").alias("kept"))
    return rows.groupBy("tab").agg(F.count("*").alias("rows")).join(kept, "tab", "left")


QUERIES = {"p3_found": p3_found, "p3_routes": p3_routes, "p3_kept": p3_kept}
SQL: dict[str, str] = {}
