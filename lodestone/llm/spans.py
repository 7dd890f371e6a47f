"""Problem 10: exact spans shared between records, by prefix-partitioned suffix trees.

Suffixes are taken at anchors: the least 16-gram of every window of ``WINDOW`` positions, so any span of at least
``least`` characters holds an anchor in its first ``WINDOW`` positions, the same one in every copy.  Suffixes are
partitioned by their prefix of ``least - WINDOW`` characters; a prefix met in one text only is dropped while still a
64-bit hash.  The rest are grouped with their characters, equal contexts folded into one class, and the deep nodes of
each group's tree (common prefix of neighbours in sorted order, extended to the left) give the repeats.  A group with
more classes than a task should hold is settled by counting its windows of ``least`` characters across the cluster.

Equal texts are folded first.  Lengths count Unicode characters.  Null texts share nothing; their share is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, table

LEAST = 300
WINDOW = 200
GRAM = 16
#: Classes of contexts in one prefix's tree; larger ones are settled by distributed window counts.
MAX_CLASSES = 256
#: Classes that a group of prefixes holds on average.
GROUP_CLASSES = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(codes: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """64-bit hashes of the stretches of each size that begin at each position, by doubling; too short ones at the end are meaningless."""
    level = _mix(codes.astype(np.uint64) + np.uint64(0x1234567))
    power, levels = 1, {1: level}
    while power * 2 <= max(sizes):
        shifted = np.concatenate([level[power:], np.zeros(min(power, len(level)), dtype=np.uint64)])
        level = _mix(level * np.uint64(0xC2B2AE3D27D4EB4F) + shifted)
        power *= 2
        levels[power] = level
    out = {}
    for size in sizes:
        value, at = None, 0
        for power in sorted((p for p in levels if size & p), reverse=True):
            part = levels[power]
            shifted = np.concatenate([part[at:], np.zeros(min(at, len(part)), dtype=np.uint64)])
            value = shifted if value is None else _mix(value * np.uint64(0x165667B19E3779F9) + shifted)
            at += power
        out[size] = value
    return out


def anchors(text_codes: np.ndarray, starts: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in texts laid end to end, and the hash of the prefix there; prefixes don't leave their text."""
    prefix = least - window
    n = len(text_codes)
    if n < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = gram_hashes(text_codes, [GRAM, prefix])
    # the low bits hold the place in the window, so ties go to the leftmost and the least value names its position
    keyed = (hashes[GRAM] & ~np.uint64(0xFFFFFFF)) | (np.arange(n, dtype=np.uint64) & np.uint64(0xFFFFFFF))
    low, span = keyed, 1
    while span < window:
        step = min(span, window - span)
        low = np.minimum(low, np.concatenate([low[step:], np.full(step, np.iinfo(np.uint64).max, dtype=np.uint64)]))
        span += step
    ends = np.concatenate([starts[1:], [n]])
    long = ends - starts >= least
    first, last = starts[long], ends[long] - least
    count = last - first + 1
    whole = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = np.unique((low[whole] & np.uint64(0xFFFFFFF)).astype(np.int64))
    return at, hashes[prefix][at]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return codes, np.cumsum(lengths) - lengths


def _blocks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters together."""
    lo = size = 0
    for n, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, n
            lo, size = n, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _anchor_rows(least: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                codes, starts = _codes(texts[lo:hi])
                at, prefix = anchors(codes, starts, least, window)
                which = np.searchsorted(starts, at, side="right") - 1
                # texts laid end to end: an empty one shares its start with the next, and searchsorted takes the last
                yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(keys[lo:hi][which]), pa.array((at - starts[which]).astype(np.int32))], names=["h", "t", "pos"])

    return run


def _context_rows(least: int, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t, text, places in zip(batch["t"], batch["text"], batch["places"], strict=True):
                rows += [(p["h"], t, p["pos"], text[max(0, p["pos"] - window) : p["pos"]], text[p["pos"] : p["pos"] + least]) for p in places]
            yield pd.DataFrame(rows, columns=["h", "t", "pos", "back", "fore"])

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def tree_spans(backs: list[str], fores: list[str], texts: list, alone: list[bool], least: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a group the stretches around its anchor, as (from, to) beside the anchor, that another text holds too."""
    order = sorted(range(len(fores)), key=fores.__getitem__)
    reverse = [b[::-1] for b in backs]
    out: list[list[tuple[int, int]]] = [[] for _ in fores]
    for i, single in enumerate(alone):
        if not single and len(backs[i]) + len(fores[i]) >= least:
            out[i].append((-len(backs[i]), len(fores[i])))
    for n, i in enumerate(order):
        # neighbours in sorted order: the common prefix with those further on is the least of the steps between
        depth = len(fores[i])
        for j in order[n + 1 :]:
            depth = min(depth, _common(fores[i], fores[j]))
            if depth + max(len(backs[i]), 0) < least:
                break
            if texts[i] == texts[j] and alone[i] and alone[j]:
                continue
            left = _common(reverse[i], reverse[j])
            if left + depth >= least:
                out[i].append((-left, depth))
                out[j].append((-left, depth))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _tree_group(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """A memory-sized group of prefixes, one tree each."""
        group = group.sort_values("h", kind="stable")
        h, c, lo, hi = (group[k].to_numpy() for k in ("h", "c", "lo_t", "hi_t"))
        backs, fores = group["back"].tolist(), group["fore"].tolist()
        edges = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
        rows = []
        for x, y in zip(edges, edges[1:], strict=False):
            spans = tree_spans(backs[x:y], fores[x:y], lo[x:y].tolist(), (lo[x:y] == hi[x:y]).tolist(), least)
            rows += [(h[x], c[x + n], a, b) for n, own in enumerate(spans) for a, b in merged(own)]
        return pd.DataFrame(rows, columns=["h", "c", "a", "b"])

    return run


def shared_spans(docs: DataFrame, least: int = LEAST, window: int = WINDOW, text: str = "text", max_classes: int = MAX_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(t, first, end): stretches of the text with hash t found in another text; and (t, n, copies) of each distinct text of that length."""
    window = min(window, least - GRAM)
    long = docs.where(F.length(text) >= least).select(F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    found = materialise(long.mapInArrow(_anchor_rows(least, window), "h long, t long, pos int"))
    shared = found.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("h")
    places = found.join(shared, "h").groupBy("t").agg(F.collect_set(F.struct("h", "pos")).alias("places"))
    distinct = long.groupBy("t").agg(F.any_value("text").alias("text"))
    contexts = materialise(places.join(distinct, "t").select("t", "text", "places").mapInPandas(_context_rows(least, window), "h long, t long, pos int, back string, fore string"))
    contexts = contexts.withColumn("c", F.xxhash64("back", "fore"))
    classes = contexts.groupBy("h", "c").agg(F.min("t").alias("lo_t"), F.max("t").alias("hi_t"), F.any_value("back").alias("back"), F.any_value("fore").alias("fore"))
    sizes = contexts.groupBy("h").agg(F.approx_count_distinct("c").alias("n"))
    sized = classes.join(sizes, "h")
    groups = 1 + contexts.count() // GROUP_CLASSES
    trees = sized.where(F.col("n") <= max_classes).drop("n").groupBy(F.pmod(F.xxhash64("h"), F.lit(groups)).alias("g")).applyInPandas(_tree_group(least), "h long, c long, a int, b int")
    # the same for a large group, without holding it: windows that begin up to `window` before the anchor, counted by their hash
    windows = sized.where(F.col("n") > max_classes).select(
        "h", "c", "lo_t", "hi_t",
        F.explode(F.expr(f"transform(filter(sequence(0, length(back)), k -> length(fore) >= {least} - k), k -> struct(k, xxhash64(substring(back, length(back) - k + 1, k), substring(fore, 1, {least} - k), k) as g))")).alias("w"),
    ).select("h", "c", "lo_t", "hi_t", "w.k", "w.g")
    twice = windows.groupBy("h", "g").agg(F.min("lo_t").alias("x"), F.max("hi_t").alias("y")).where("x <> y").select("h", "g")
    settled = windows.join(twice, ["h", "g"]).select("h", "c", (-F.col("k")).alias("a"), (F.lit(least) - F.col("k")).alias("b"))
    spans = contexts.select("h", "c", "t", "pos").join(trees.unionByName(settled), ["h", "c"]).select("t", (F.col("pos") + F.col("a")).alias("first"), (F.col("pos") + F.col("b")).alias("end"))
    copies = long.groupBy("t").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n")).where("copies > 1")
    return spans, copies


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans, copies = shared_spans(docs)
    hit = spans.select("t").unionByName(copies.select("t")).distinct()
    keys = docs.where(F.length("text") >= LEAST).select("doc_id", F.xxhash64("text").alias("t"))
    return keys.join(hit, "t", "left_semi").select("doc_id")


def shares(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every row; a null text has n_chars 0 and share 0."""
    spans, copies = shared_spans(docs, least, text=text, **options)
    within = F.expr(
        "aggregate(array_sort(collect_set(struct(first, end))), named_struct('n', 0, 'at', 0), "
        "(x, s) -> named_struct('n', x.n + greatest(0, s.end - greatest(s.first, x.at)), 'at', greatest(x.at, s.end)), x -> x.n)"
    )
    covered = spans.groupBy("t").agg(within.alias("covered"))
    whole = copies.select("t", F.col("n").alias("whole"))
    keyed = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), F.when(F.length(text) >= least, F.xxhash64(text)).alias("t"))
    return (
        keyed.join(covered.join(whole, "t", "full"), "t", "left")
        .select("doc_id", "n_chars", F.coalesce("whole", "covered", F.lit(0)).alias("shared_chars"))
        .withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
    )


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_share": p10_share}
SQL: dict[str, str] = {
    "p10_found": """WITH w AS (SELECT doc_id, substring(text, i, 300) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))
SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)""",
}
