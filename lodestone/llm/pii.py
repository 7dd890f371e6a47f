"""Problem 2: personal information in free text, by information-theoretic sanitisation.

Corpus co-occurrence says how strongly a term reveals a protected entity.  Two tables are counted over all rows:

* terms around numbers: for each term within four words of a candidate number, how much more often than usual the number
  is of an unmistakable protected shape (pointwise mutual information).  Numbers of an ambiguous shape are protected when
  the terms around them disclose a kind beyond a threshold; order, ticket or parcel numbers stand among terms that don't.
* words of names: how much more often than usual a word stands first, or last, in a reviewer field that is plainly a
  person's name (pointwise mutual information, and its share of the word's uses).  Words beyond the thresholds disclose a
  person wherever a first name and a surname (or its initial), or a title and a surname, meet, in any case and order.

What is disclosed is replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID]``, ``[ADDRESS]`` or ``[NAME]``; all else stays as it is.
Null and empty values hold nothing and stay as they are; rows with a null id are kept in the redacted table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, table

#: A term discloses a kind if numbers beside it are of it this often, this many times as often as usual (as a natural logarithm), over so many uses.
DISCLOSURE, LEAST_SHARE, LEAST_USES = 0.7, 0.3, 3
#: Share of a word's uses inside names from which it counts as a word of names.
NAME_SHARE = 0.2
#: Words of names are sent to all tasks up to this number; more are joined to all neighbouring words.
SMALL = 200_000

EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]+"
    r"(?:\s?(?:@|\(@\)|\[@\])\s?[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)+"
    r"|\s?(?:\(at\)|\[at\]|\{at\})\s?[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)+"
    r"|\s(?:AT)\s[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\s(?:dot|DOT)\s)[\w-]+)+"
    r"|\sat\s[\w-]+(?:(?:\s?[\[(]dot[\])]\s?|\sdot\s)[\w-]+)+)",
)
_TOWN = r"(?:,? (?:\d{4,6} )?[A-ZÀ-Þ][\w'’-]+(?: \d{4,6})?)?"
#: The forms of an address, each with a street or a box and its number.
ADDRESS = re.compile(
    r"(?:(?i:apt|flat|unit|apartment)\.? \d+\w?, )?"
    r"(?:\b\d{1,5}[a-z]? (?:[A-ZÀ-Þ][\w'’-]+ ){1,3}(?i:street|lane|road|avenue|blvd|boulevard|drive|court|place|square|way|st|rd|ave|ln|dr)\b\.?(?:,? (?i:suite|flat|apt|unit) \d+\w?)?"
    r"|\b\d{1,5}(?: ?bis)?,? (?i:rue|avenue|boulevard|place|chemin|allée|quai|impasse) (?:(?i:du|de la|de l'|des|de|d') ?)?[A-ZÀ-Þ][\w'’-]+"
    r"|\b(?i:calle|avenida|plaza|paseo|carrera) (?:(?i:de la|del|de) )?[A-ZÀ-Þ][\w'’-]+,? (?:n\.?º ?)?\d{1,5}(?:, \d+º ?[A-Z]?\b)?"
    r"|\b(?i:rua|avenida|travessa|praça|alameda) (?:(?i:de|do|da|dos|das) )?[A-ZÀ-Þ][\w'’-]+,? (?:n\.?º ?)?\d{1,5}(?: -)?"
    r"|\b[A-ZÀ-Þ][\w'’-]*(?i:strasse|straße|str\.|weg|gasse|platz|allee) \d{1,5}[a-z]?\b"
    r"|\b(?i:p\.? ?o\.? ?box|postfach|apartado|boîte postale|caixa postal) \d+"
    r"|\b\d{1,3}-\d{1,3}(?:-\d{1,4})? [A-ZÀ-Þ][\w'’]+-(?i:cho|machi|ku)\b)" + _TOWN
)
#: Shapes that only an identity number has, and shapes that others share.
ID_SURE = re.compile(
    r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-Z]\d{8}|[A-Z]{2}\d{7}|[A-Z]{5}\d{6}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z])(?![\w-])"
)
ID_MAYBE = re.compile(r"(?<![\w.+/-])(?:\d{4} \d{4} \d{4}|\d{2}-\d{7}|\d{9,12}|\d{3} \d{3} \d{3}|[A-Z]{1,3}\d{6,9})(?![\w-])")
#: Shapes of phone numbers, sure and ambiguous.
PHONE_SURE = re.compile(
    r"(?<![\w.-])(?:\+\d{1,3}(?:[ .-]?\(?\d{1,6}\)?){2,6}|\(\d{2,3}\) ?\d{3,5}-\d{4}|1-\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3}-\d{3}-\d{4}"
    r"|0\d{2} \d{4} \d{4}|0\d{4} \d{6}|0\d{3} \d{3} \d{3,4}|0\d{2,4}/\d{6,9}|0\d(?: \d{2}){4}|0\d{1,3}-\d{3,4}-\d{4})(?![\w-])"
)
#: What any written-out address of a mailbox holds: a text without it has none.
MAILBOX = re.compile(r"@|[(\[{]at[)\]}]|\sAT\s|\sat\s(?=.*dot)", re.S)
PHONE_MAYBE = re.compile(r"(?<![\w.+/-])(?:\d{3}-\d{4}|\d{10,11}|\d{4} \d{4}|\d{3} \d{4})(?![\w-])")
#: Other numbers, so that terms are also counted where nothing is protected.
SENTENCE_END = re.compile(r"[.!?]\s|[.!?]$|\n|。")
NUMBER = re.compile(r"(?<![\w.,#-])#?\d[\d.,:/ -]{2,}\d(?![\w-])|\b[A-Z]{2}-\d{4}\b")
WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NAME = r"([^\W\d_]+(?:['’-](?![sS]\b)[^\W\d_]+)*)"
NAME_WORD = re.compile(_NAME)
NAME_PAIR = re.compile(_NAME + r"(\.?\s(?:[^\W\d_]\.\s)?|,\s)" + _NAME + r"(\.?)")
#: Titles before a surname.
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame mme mlle señor señora señorita sr sra srta senhor senhora dona don doña".split())
KINDS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}


def _terms(text: str, begin: int, end: int) -> list[str]:
    """Up to four words of the sentence on either side, with their side, and the sign just before."""
    sign = ["<" + text[begin - 1]] if begin and not text[begin - 1].isspace() else []
    before = WORDS.findall(SENTENCE_END.split(text[max(0, begin - 60) : begin])[-1])[-4:]
    after = WORDS.findall(SENTENCE_END.split(text[end : end + 60])[0])[:4]
    return sign + ["<" + w.lower() for w in before] + [">" + w.lower() for w in after]


def candidates(text: str, names: set[str] | None = None) -> list[tuple]:
    """(kind, state, begin, end, first, last, terms): sure and doubtful spans, other numbers, and pairs of words that may be a name.

    With the words of names known, only pairs with one of them are given.
    """
    taken = bytearray(len(text))
    out = []

    def take(kind: str, state: str, m: re.Match, terms: bool) -> None:
        if not any(taken[m.start() : m.end()]):
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
            out.append((kind, state, m.start(), m.end(), None, None, _terms(text, m.start(), m.end()) if terms else []))

    if MAILBOX.search(text):
        for m in EMAIL.finditer(text):
            take("email", "sure", m, False)
    has_digit = any(c.isdigit() for c in text)
    if has_digit:
        for m in ADDRESS.finditer(text):
            take("address", "sure", m, False)
        for kind, state, pattern in (("id_number", "sure", ID_SURE), ("phone", "sure", PHONE_SURE), ("id_number", "maybe", ID_MAYBE), ("phone", "maybe", PHONE_MAYBE), ("other", "no", NUMBER)):
            for m in pattern.finditer(text):
                take(kind, state, m, True)
    if names is not None and names.isdisjoint(NAME_WORD.findall(text.lower())):
        return out
    at = 0
    while m := NAME_PAIR.search(text, at):
        first, joint, last, dot = m.groups()
        at = m.start(3)
        if (names is None or first.lower() in names or last.lower() in names) and not any(taken[m.start() : m.end()]):
            out.append(("name", "comma" if joint[0] == "," else "pair", m.start(), m.end() if dot and len(last) == 1 else m.end(3), first.lower(), last.lower() + (dot if len(last) == 1 else ""), []))
    return out


def _extract(values: DataFrame, words: DataFrame) -> DataFrame:
    names = {r.word for r in words.select("word").toLocalIterator()} if words.count() <= SMALL else None
    shared = values.sparkSession.sparkContext.broadcast(names)
    columns = ["key", "kind", "state", "begin", "end", "first", "last", "terms"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *c) for k, v in zip(batch["key"], batch["value"], strict=True) for c in candidates(v, shared.value)], columns=columns)

    return values.mapInPandas(run, "key long, kind string, state string, begin int, end int, first string, last string, terms array<string>")


def name_words(values: DataFrame, reviewers: DataFrame) -> DataFrame:
    """(word, is_first, is_last): words that disclose a person; counted over all reviewer fields and texts."""
    shape = F.regexp_extract_all(F.col("value"), F.lit(r"^(\p{Lu}[\p{Ll}'’]+) (?:\p{Lu}\. ?)?(\p{Lu}[\p{Ll}'’]+)?$"), F.lit(0))
    named = reviewers.where((F.size(shape) > 0) & F.col("value").rlike(r"^\S+ \S+( \S+)?$")).select(F.split(F.lower("value"), " ").alias("w"))
    firsts = named.select(F.col("w")[0].alias("word"), F.lit(1).alias("f"), F.lit(0).alias("l"), F.lit(0).alias("n"))
    lasts = named.where(~F.element_at("w", -1).contains(".")).select(F.element_at("w", -1).alias("word"), F.lit(0).alias("f"), F.lit(1).alias("l"), F.lit(0).alias("n"))
    used = values.select(F.explode(F.expr(r"regexp_extract_all(lower(value), '[\\p{L}''’-]+', 0)")).alias("word")).select("word", F.lit(0).alias("f"), F.lit(0).alias("l"), F.lit(1).alias("n"))
    counted = materialise(firsts.unionByName(lasts).unionByName(used).groupBy("word").agg(F.sum("f").alias("f"), F.sum("l").alias("l"), F.sum("n").alias("n")))
    totals = counted.agg(F.sum("f").alias("all_f"), F.sum("l").alias("all_l"), F.sum("n").alias("all_n"))  # one row
    told = counted.where((F.length("word") > 1) & (F.col("f") + F.col("l") > 0)).crossJoin(F.broadcast(totals))
    discloses = lambda k: (F.col(k) >= NAME_SHARE * F.col("n")) & (F.log((F.col(k) / F.col("n")) / (F.col(f"all_{k}") / F.col("all_n"))) >= DISCLOSURE)
    return told.select("word", (discloses("f") & (F.col("f") > F.col("l"))).alias("is_first"), (discloses("l") & (F.col("l") >= F.col("f"))).alias("is_last")).where("is_first or is_last")


def term_disclosure(found: DataFrame) -> DataFrame:
    """(term, kind, pmi): the terms that disclose a kind, with their pointwise mutual information."""
    terms = found.where("kind <> 'name' and size(terms) > 0").select("kind", "state", F.explode(F.array_distinct("terms")).alias("term"))
    counted = terms.groupBy("term").agg(
        F.count("*").alias("n"), F.count_if((F.col("kind") == "phone") & (F.col("state") == "sure")).alias("phone"), F.count_if((F.col("kind") == "id_number") & (F.col("state") == "sure")).alias("id_number")
    )
    totals = counted.agg(F.sum("n").alias("all"), F.sum("phone").alias("all_phone"), F.sum("id_number").alias("all_id_number"))
    both = counted.where(F.col("n") >= LEAST_USES).crossJoin(F.broadcast(totals))  # one row of totals
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("n")).alias("share"), (F.col(f"all_{k}") / F.col("all")).alias("usual")) for k in ("phone", "id_number")])
    told = both.select("term", F.explode(kinds).alias("k")).where(F.col("k.share") >= LEAST_SHARE)
    return told.select("term", "k.kind", F.log(F.col("k.share") / F.col("k.usual")).alias("pmi"), "k.share").where(F.col("pmi") >= DISCLOSURE)


def disclosed(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, field, key) of every non-empty value, and (key, kind, begin, end) of what its distinct values disclose."""
    fields = reviews.select("id", F.explode(F.create_map(F.lit("review_text"), F.col("review_text"), F.lit("reviewer"), F.col("reviewer"))).alias("field", "value")).where("value <> ''")
    fields = fields.withColumn("key", F.xxhash64("value"))
    values = fields.groupBy("key").agg(F.any_value("value").alias("value"))
    words = materialise(name_words(fields.select("value"), fields.where("field = 'reviewer'").select("value")))
    found = materialise(_extract(values, words))
    sure = found.where("state = 'sure'").select("key", "kind", "begin", "end")
    doubtful = found.where("state = 'maybe'").select("key", "begin", "end", F.explode(F.array_distinct("terms")).alias("term"))
    told = doubtful.join(term_disclosure(found), "term")
    shown = told.groupBy("key", "begin", "end").agg(F.max_by("kind", F.struct("share", "kind")).alias("kind")).select("key", "kind", "begin", "end")
    pairs = found.where("kind = 'name'").select("key", "state", "begin", "end", "first", "last")
    firsts = words.where("is_first").select(F.col("word"), F.lit(True).alias("yes"))
    lasts = words.where("is_last").select(F.col("word"), F.lit(True).alias("yes"))
    marked = (
        pairs.join(firsts.select(F.col("word").alias("first"), F.col("yes").alias("ff")), "first", "left")
        .join(lasts.select(F.col("word").alias("last"), F.col("yes").alias("ll")), "last", "left")
        .join(lasts.select(F.col("word").alias("first"), F.col("yes").alias("fl")), "first", "left")
        .join(firsts.select(F.col("word").alias("last"), F.col("yes").alias("lf")), "last", "left")
    )
    names = marked.where(
        ((F.col("state") == "pair") & F.col("ff") & (F.col("ll") | F.col("last").rlike(r"^\p{L}\.$")))
        | (F.col("fl") & F.col("lf"))
        | ((F.col("state") == "pair") & F.col("first").isin(*TITLES) & F.col("ll"))
    ).select("key", F.lit("name").alias("kind"), "begin", "end")
    return fields, sure.unionByName(shown).unionByName(names)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, spans = disclosed(table(spark, sf_dir, "reviews"))
    return fields.select("id", "field", "key").join(spans.select("key", "kind").distinct(), "key").select("id", "field", "kind").distinct()


def _redact(value: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(value, spans, strict=True):
        if own is None or text is None:
            out.append(text)
            continue
        parts, at = [], 0
        for s in sorted(own, key=lambda s: (s["begin"], -s["end"])):
            if s["begin"] >= at:
                parts += [text[at : s["begin"]], KINDS[s["kind"]]]
                at = s["end"]
        out.append("".join(parts) + text[at:])
    return pd.Series(out, dtype=object)


def redacted(reviews: DataFrame) -> DataFrame:
    """The reviews, row for row, with typed placeholders in review_text and reviewer."""
    _, spans = disclosed(reviews)
    lists = materialise(spans.groupBy("key").agg(F.collect_set(F.struct("kind", "begin", "end")).alias("spans")))
    replace = F.pandas_udf(_redact, "string")
    out = reviews
    for c in ("review_text", "reviewer"):
        marked = out.withColumn("__key", F.xxhash64(c)).join(lists.select(F.col("key").alias("__key"), F.col("spans").alias("__spans")), "__key", "left")
        out = marked.withColumn(c, F.when(F.col("__spans").isNull(), F.col(c)).otherwise(replace(F.col(c), F.col("__spans")))).drop("__key", "__spans")
    return out.select(*reviews.columns)


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(table(spark, sf_dir, "reviews").select("id", "scraped_at", "review_text", "reviewer"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
