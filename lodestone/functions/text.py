"""Text expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval ignores.
STOPWORDS = (
    "the and for that this with you your are was were have has had not but all any can could from how its into our out she his her they them their there these those who what when "
    "where which why will would should about does did doing been being than then also just more most some such only other over under use using used get got make made each"
).split()
WORD = r"[a-z0-9][a-z0-9'\-.]*"
#: Words folded into one, and words that don't tell products apart.
PRODUCT_ALIASES = {"headset": "headphones", "earphone": "headphones"}
PRODUCT_NOISE = ("with", "the", "and", "series", "edition", "new", "plus", "model")
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def tokens(text: Column) -> Column:
    """Lower-case words of more than two characters without stopwords, in order; empty for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def sentences(text: Column) -> Column:
    """A text split where a sentence ends and a capital or digit begins the next; empty for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, SENTENCE))


def product_key(name: Column) -> Column:
    """Ordered distinct words of a product name, aliases folded and noise dropped; under two words the plain name."""
    words = F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in PRODUCT_ALIASES.items() for x in pair])
    folded = F.transform(words, lambda w: F.coalesce(table[w], w))
    kept = F.array_distinct(F.filter(folded, lambda w: ~w.isin(*PRODUCT_NOISE)))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "), " +", " "))
    return F.when(F.size(kept) >= 2, F.array_join(kept, " ")).when(plain == "", F.lit("unknown")).otherwise(plain)


def parsed_date(text: Column) -> Column:
    """A date in ISO form (with or without a time, whose own day counts), day/month/year, else month/day/year, or with an English month name; null for anything else."""
    t = F.trim(text)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$", 1)
    formats = ("d/M/yyyy", "M/d/yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")
    return F.coalesce(F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))), *[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in formats])


def rounded(value: Column, digits: int = 4) -> Column:
    """Half-up rounding that engines agree on."""
    return F.floor(value * 10**digits + 0.5) / 10**digits
