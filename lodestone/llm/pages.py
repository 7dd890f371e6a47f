"""The lines of captured pages as leaves of a shallow tree (page, block, run, line), with the features of each line.

Nothing here knows any wording: what a word says about a line is learned from labelled pages (``boilerplate``), as weights of
hashed tokens.  The arrays of many pages are worked out at once.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

#: Buckets of hashed tokens and of hashed token pairs.
BUCKETS = 1 << 15
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
BULLET = re.compile(r"[-*•→]\s")
#: A delimited stretch: braces, brackets, angle brackets, twin signs, format signs, the word for no value; with the backticks that quote it.
STRETCH = r"(?=[`$#%{\[<_u])`?(?:[$#%]?\{+[^{}\n]*\}+|\[+[^\[\]\n]*\]+(?!\()|<[%/!]?[A-Za-z=][^<>\n]*>|<%[^<>\n]*%>|(?<![\w$%])([$%_]{1,2})[A-Za-z]\w*?\1(?!\w)|(?<![\w%])%[sd]\b|(?<!\w)undefined(?!\w))`?"
SHAPES = ("heading", "bullet", "table", "sentence", "label", "short")
NAMES = (
    "words", "chars", "ends", "closed", "level", "digits", "capitals", "foreign", "links", "separators", "brackets", "colon", "symbol", *SHAPES,
    "weight", "weight_mean", "weight_min", "weight_max", "first", "last", "pair_mean", "pair_min", "pair_max", "begin", "end",
    "block_lines", "block_words", "block_weight", "block_place", "run_lines", "run_words", "run_weight", "head_weight", "head_distance", "head_level",
    "prev_weight", "next_weight", "prev_words", "next_words", "prev_closed", "next_closed", "prev2_weight", "next2_weight", "before_body", "after_body", "from_top", "from_end", "page_weight", "page_lines",
)
#: Of each character below 255, whether it is one of a class.
_OF = {name: np.isin(np.arange(256), [ord(c) for c in characters]) for name, characters in {"ends": ".!?", "separators": "|/>»·", "brackets": "[](){}"}.items()}


class _Buckets(dict):
    """The token buckets of every word (between blanks) seen, worked out when it is first asked for."""

    def __missing__(self, word: str) -> list[int]:
        found = [xxhash.xxh32_intdigest("0" if t.isdigit() else t) % BUCKETS for t in TOKEN.findall(word)]
        if len(word) <= 40:
            self[word] = found
        return found


_BUCKET = _Buckets()


class Lines(NamedTuple):
    """The non-blank lines of many pages: page, number and text of each, its block and its run, and where each page begins."""

    page: np.ndarray
    number: np.ndarray
    text: list[str]
    block: np.ndarray
    run: np.ndarray
    shape: np.ndarray


def _shape(s: str) -> int:
    if s[0] == "#":
        return 0
    if BULLET.match(s):
        return 1
    if s[0] == "|":
        return 2
    words = s.count(" ") + 1
    if "。" in s or (s[-1] in ".!?" and words >= 6) or words >= 20:
        return 3
    colon = s.find(": ")
    return 4 if 0 < colon <= 20 and s.count(" ", 0, colon) <= 2 else 5


def page_lines(texts: list[str | None]) -> Lines:
    """Blocks lie between blank lines; a run is a stretch of lines of one shape within a block, with the heading above it."""
    page, number, text, block, run, shape = [], [], [], [], [], []
    b = r = -1
    for k, value in enumerate(texts):
        before, blank = -1, True
        for n, line in enumerate((value or "").split("\n")):
            s = line.strip()
            if not s:
                blank = True
                continue
            now = _shape(s)
            if blank:
                b += 1
                r += 1
                blank = False
            elif now != before and before != 0:
                r += 1
            before = now
            page.append(k)
            number.append(n)
            text.append(s)
            block.append(b)
            run.append(r)
            shape.append(now)
    return Lines(np.array(page, dtype=np.int64), np.array(number, dtype=np.int64), text, np.array(block, dtype=np.int64), np.array(run, dtype=np.int64), np.array(shape, dtype=np.int64))


def buckets_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token buckets of all lines, one after another, and how many tokens each line has (one at least)."""
    if len(_BUCKET) > 200_000:
        _BUCKET.clear()
    out: list[int] = []
    sizes = []
    for s in lines:
        before = len(out)
        for word in s.lower().split():  # no token holds a blank
            out += _BUCKET[word]
        if len(out) == before:
            out.append(xxhash.xxh32_intdigest("") % BUCKETS)
        sizes.append(len(out) - before)
    return np.array(out, dtype=np.int64), np.array(sizes, dtype=np.int64)


def pairs_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bucket of each token with the one after it in its line; the last one's is that of the token with the line's end."""
    following = np.append(tokens[1:], 0)
    following[np.cumsum(sizes) - 1] = BUCKETS
    return (tokens * 0x9E3779B1 + following * 0x85EBCA6B) % BUCKETS


def starts_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pair bucket of each line's beginning with its first token."""
    return ((BUCKETS + 1) * 0x9E3779B1 + tokens[np.cumsum(sizes) - sizes] * 0x85EBCA6B) % BUCKETS


def features(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """A row of NAMES for each line; weights holds the log-odds of the token buckets, then those of the pair buckets."""
    count = len(lines.text)
    if not count:
        return np.zeros((0, len(NAMES)))
    tokens, sizes = buckets_of(lines.text)
    begin = np.cumsum(sizes) - sizes
    pair = weights[BUCKETS + pairs_of(tokens, sizes)]
    single = weights[tokens]
    chars = np.array([len(s) for s in lines.text])
    codes = np.frombuffer("".join(lines.text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    start = np.cumsum(chars) - chars
    tally = lambda mask: np.add.reduceat(mask.astype(np.int32), start).astype(np.int64)
    small = np.minimum(codes, 255).astype(np.uint8)
    of = lambda name: _OF[name][small]
    spaces = tally(small == 32) + 1.0
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    own = [
        spaces, chars, tally(of("ends") | (codes == 0x3002)), np.isin(codes[start + chars - 1], [33, 46, 63, 0x3002]), [len(s) - len(s.lstrip("#")) for s in lines.text], tally((codes >= 48) & (codes <= 57)) / chars, tally(upper) / spaces,
        tally(codes > 127) / chars, [s.count("](") for s in lines.text], tally(of("separators") | (codes == 0x2022)), tally(of("brackets")), [s.find(": ") if ": " in s else 99 for s in lines.text],
        ~((codes[start] >= 48) & (codes[start] <= 57) | (codes[start] >= 65) & (codes[start] <= 90) | (codes[start] >= 97) & (codes[start] <= 122) | (codes[start] > 127)), *(lines.shape == k for k in range(len(SHAPES))),
    ]
    total = np.add.reduceat(single, begin)
    mean = total / sizes
    learned = [total, mean, np.minimum.reduceat(single, begin), np.maximum.reduceat(single, begin), single[begin], single[begin + sizes - 1], np.add.reduceat(pair, begin) / sizes, np.minimum.reduceat(pair, begin), np.maximum.reduceat(pair, begin), weights[BUCKETS + starts_of(tokens, sizes)], pair[begin + sizes - 1]]
    place = np.arange(count)
    within = lambda key, x: (np.bincount(key, weights=x) / np.maximum(np.bincount(key), 1))[key]
    first_of = lambda key: np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), place, 0))
    last_of = lambda key: np.minimum.accumulate(np.where(np.append(key[1:] != key[:-1], True), place, count)[::-1])[::-1]
    page_first, page_last = first_of(lines.page), last_of(lines.page)
    closed = np.asarray(own[3], dtype=float)
    head = (lines.shape == 0) | ((lines.shape == 5) & (place == first_of(lines.block)))
    nearest = np.maximum.accumulate(np.where(head, place, -1))
    known = nearest >= page_first
    at = np.maximum(nearest, 0)

    def near(x: np.ndarray, by: int) -> np.ndarray:
        to = place + by
        inside = (to >= page_first) & (to <= page_last)
        return np.where(inside, x[np.clip(to, 0, count - 1)], 0.0)

    body = (lines.shape == 3) & (spaces >= 8)
    before = np.maximum.accumulate(np.where(body, place, -1))
    after = np.minimum.accumulate(np.where(body, place, count)[::-1])[::-1]
    opening, closing = before < page_first, after > page_last
    around = [
        np.bincount(lines.block)[lines.block], within(lines.block, spaces), within(lines.block, mean), place - first_of(lines.block), np.bincount(lines.run)[lines.run], within(lines.run, spaces), within(lines.run, mean),
        np.where(known, mean[at], 0.0), np.where(known, place - nearest, 99), np.where(known, np.asarray(own[4])[at], 0),
        near(mean, -1), near(mean, 1), near(spaces, -1), near(spaces, 1), near(closed, -1), near(closed, 1), near(mean, -2), near(mean, 2),
        np.where(opening, np.minimum(after, page_last + 1) - place, 0), np.where(closing, place - np.maximum(before, page_first - 1), 0), place - page_first, page_last - place, within(lines.page, mean), page_last - page_first + 1,
    ]
    return np.column_stack([np.asarray(x, dtype=np.float64) for x in (*own, *learned, *around)])


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, id, host, scraper, text) of pages and captures."""
    host = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^[a-z]+://([^/?#]+)", 1)
    pages, captures = table(spark, sf_dir, "research_pages"), table(spark, sf_dir, "raw_evidence")
    return pages.select(F.lit("research_pages").alias("tab"), "id", host("url").alias("host"), F.coalesce("scraper", F.lit("")).alias("scraper"), "text").unionByName(
        captures.select(F.lit("raw_evidence").alias("tab"), "id", host("source_url").alias("host"), F.lit("").alias("scraper"), F.col("content").alias("text"))
    )


def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, id, body): the sections of every page that has any, heading and content; such a page is no residue, and the rest of it no body."""
    return table(spark, sf_dir, "research_sections").where("page_id is not null").select(F.lit("research_pages").alias("tab"), F.col("page_id").alias("id"), F.concat_ws("\n", "heading", "content").alias("body"))


def pages_without_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, id) of the pages that were fetched with a text and gave no section."""
    fetched = table(spark, sf_dir, "research_pages").where("status = 'fetched' and text <> ''").select(F.lit("research_pages").alias("tab"), "id")
    return fetched.join(page_bodies(spark, sf_dir).select("tab", "id").distinct(), ["tab", "id"], "left_anti")
