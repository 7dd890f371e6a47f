"""URL expressions by regular expressions, so malformed addresses give nulls or themselves and never fail a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "igshid", "ref", "spm", "scm")


def host(url: Column) -> Column:
    """Lower-case host without port and without a leading www.; empty for null or no host."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def _encoded(part: Column) -> Column:
    """A query part decoded and written again in one form: blanks as +, all but letters, digits and _.-~ escaped."""
    plain = F.coalesce(F.try_url_decode(part), part)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Scheme and authority in lower case (https where none is given), path without trailing slashes (/ at least), query
    parameters in order and in one encoding without those that only track; no fragment. Null stays null."""
    part = lambda k: F.regexp_extract(F.trim(url), r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
    scheme, trimmed = F.lower(part(1)), F.regexp_replace(F.regexp_replace(part(3), ";[^/]*$", ""), "/+$", "")
    path_of = F.when(trimmed == "", F.lit("/")).when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.concat_ws("=", _encoded(F.regexp_extract(p, "^([^=]*)", 1)), _encoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))))
    kept = F.filter(pairs, lambda p: ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING))
    whole = F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), F.lower(part(2)), path_of)
    return F.when(F.size(kept) > 0, F.concat(whole, F.lit("?"), F.array_join(kept, "&"))).otherwise(whole)


def host_suffixes(name: Column) -> Column:
    """A host with all its parent domains of two labels or more."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def segment_score(url: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the path segments that are named, less 0.4 for each segment."""
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != "")
    named = reduce(lambda acc, kv: acc + F.when(F.array_contains(parts, kv[0]), kv[1]).otherwise(0.0), weights.items(), F.lit(0.0))
    return named - 0.4 * F.size(parts)
