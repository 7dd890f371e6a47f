"""Problem 5: records that share most of their content, by a chosen-path join.

A record is the set of its runs of ``shingle`` words, hashed.  In every run it follows the least of its tokens under a
hash seeded by the path so far, so two records take the same step with the chance of their similarity, whatever their
tokens are.  A path ends in a bucket as soon as it holds a token that few records have (counted over all rows in a
fixed-size sketch), or at ``MAX_DEPTH``, so buckets are small.  A record makes as many runs as the worst pair that its
share of common tokens allows needs to meet at least once with a chance of ``recall``; one meeting is enough for a pair
to be compared exactly.

Records of equal sets are folded first and only spelled out in the pairs.  Records under ``least_words`` words, null or
empty texts are in no pair.  Equal rows under one id give one pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import materialise, table

WORD = re.compile(r"\w+")
#: Records that may hold a token for it to end a path, over what other tokens put into its counter.
SMALL_BUCKET = 14
#: Counters of the sketch; fixed, so what is broadcast (a bit for each) is 512 KB at any input size.
SKETCH_BITS = 22
CHUNKS = 64
MAX_DEPTH = 4
RECALL = 0.9995
#: Steps in which the share of a record's common tokens is told, from 0 to 1.
SHARES = 50
#: Longs in the parities of a set, which bound how many tokens two sets differ in.
PARITIES = 8
_U, _V = np.uint64, np.uint32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Words(dict):
    """Hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: list[str | None], shingle: int, least_words: int, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Flat sorted distinct 32-bit shingle hashes of each text, and its count (0: too short)."""
    counts = np.zeros(len(texts), dtype=np.int64)
    split = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    split = [w for w in split if len(w) >= max(least_words, shingle)]
    kept = np.flatnonzero(sizes >= max(least_words, shingle))
    if not len(kept):
        return np.zeros(0, dtype=np.uint32), counts
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=int(sizes[kept].sum()))
    value = ids
    for k in range(1, shingle):
        value = _mix(value[:-1] * _U(0x9E3779B97F4A7C15) + ids[k:])
    owner = np.repeat(np.arange(len(kept), dtype=np.uint64), sizes[kept])
    within = owner[: len(value)] == owner[len(ids) - len(value) :]
    keyed = np.sort((owner[: len(value)][within] << _U(32)) | (_mix(value[within]) >> _U(32)))
    keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    counts[kept] = np.bincount((keyed >> _U(32)).astype(np.int64), minlength=len(kept))
    return (keyed & _U(0xFFFFFFFF)).astype(np.uint32), counts


def met_in_a_run(threshold: float, common: float, depth: int) -> float:
    """Chance that a pair at the threshold takes one path; common: common tokens that both have, as a share of all that either has."""
    return sum((threshold - common) * common**d for d in range(depth)) + common**depth


def runs_needed(threshold: float, recall: float, depth: int = MAX_DEPTH) -> np.ndarray:
    """Runs of a record by the share of its common tokens, in steps of 1 / SHARES.

    Two records never have more common tokens in common than either has, so both make at least the runs that their pair
    needs.  A step stands for the shares up to its end, and no step needs fewer runs than the one before.
    """
    shares = np.minimum((np.arange(SHARES + 1) + 1) / SHARES, threshold)
    runs = [math.ceil(math.log(1 - recall) / math.log(1 - met_in_a_run(threshold, float(c), depth))) if threshold < 1 else 1 for c in shares]
    return np.maximum.accumulate(np.array(runs))


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _V(16))) * _V(0x85EBCA6B)
    x = (x ^ (x >> _V(13))) * _V(0xC2B2AE35)
    return x ^ (x >> _V(16))


def chosen_paths(tokens: np.ndarray, counts: np.ndarray, common: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, path) of every run's end; common: whether many records have the token; needed: as of runs_needed."""
    begins = np.cumsum(counts) - counts
    full = np.flatnonzero(counts)
    share = np.add.reduceat(common, begins[full], dtype=np.int64) / counts[full] if len(full) else np.zeros(0)
    runs = needed[np.minimum((share * SHARES).astype(np.int64), SHARES)]
    owners, leaves = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]

    def taken(record: np.ndarray) -> np.ndarray:
        """The places of the tokens of these records."""
        size = counts[record]
        return np.arange(int(size.sum())) + np.repeat(begins[record] - (np.cumsum(size) - size), size)

    for run in range(int(runs.max(initial=0))):
        record = full[runs > run]
        path = np.full(len(record), _mix(np.array([run + 1], dtype=np.uint64))[0])
        for depth in range(MAX_DEPTH):
            at, size = taken(record), counts[record]
            # the last bit of a hash tells a common token
            hashes = (_mix32(tokens[at] ^ np.repeat(path.astype(np.uint32), size)) & ~_V(1)) | common[at]
            least = np.minimum.reduceat(hashes, np.cumsum(size) - size)
            path = _mix(path * _U(0x9E3779B97F4A7C15) + least)
            ended = ((least & _V(1)) == 0) | (depth + 1 == MAX_DEPTH)
            owners.append(record[ended])
            leaves.append(path[ended])
            record, path = record[~ended], path[~ended]
            if not len(record):
                break
    return np.concatenate(owners), np.concatenate(leaves)


def _parities(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each of 64 * PARITIES slots holds an odd number of a set's tokens: sets differ in at least as many tokens as slots."""
    slots = 64 * PARITIES
    at = np.repeat(np.arange(len(counts)), counts) * slots + _mix32(tokens) % _V(slots)
    odd = (np.bincount(at, minlength=len(counts) * slots) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _set_ids(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    raw = tokens.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], dtype=np.uint64).view(np.int64)


def _sketch(shingle: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, known = np.zeros(1 << SKETCH_BITS, dtype=np.int64), Words()
        for batch in batches:
            tokens, _ = shingle_sets(batch.column(2).to_pylist(), shingle, least_words, known)
            counters += np.bincount(tokens >> np.uint32(32 - SKETCH_BITS), minlength=1 << SKETCH_BITS)
        small = np.minimum(counters, 255).astype(np.uint8).reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c.tobytes() for c in small], pa.binary())], names=["chunk", "counters"])

    return run


def _common_bits(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.uint8).astype(np.uint32) for c in group["counters"])
    usual = float(total.mean())
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "bits": [np.packbits(total > SMALL_BUCKET + usual + 3 * usual**0.5).tobytes()]})


def _records(shingle: int, least_words: int, needed: np.ndarray, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        bits = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                tokens, counts = shingle_sets(part.column(2).to_pylist(), shingle, least_words, known)
                if not len(tokens):
                    continue
                owner, leaf = chosen_paths(tokens, counts, bits[tokens >> np.uint32(32 - SKETCH_BITS)], needed)
                tabs = np.array([xxhash.xxh64_intdigest(t) for t in part.column(0).to_pylist()], dtype=np.uint64)
                leaf = _mix(leaf ^ tabs[owner])
                order = np.argsort(owner, kind="stable")
                kept = np.flatnonzero(counts)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts))[kept])]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf[order].view(np.int64)))
                parities = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * PARITIES), pa.array(_parities(tokens, counts[kept])))
                took = pa.array(kept)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(took), part.column(1).take(took), pa.array(_mix(_set_ids(tokens, counts).view(np.uint64) ^ tabs)[kept].view(np.int64)), pa.array(counts[kept].astype(np.int32)), leaves, parities], names=["tab", "id", "set", "n", "leaves", "parities"]
                )

    return run


def _tokens(shingle: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            tokens, counts = shingle_sets(batch.column(1).to_pylist(), shingle, least_words, known)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int32)))], names=["set", "tokens"])

    return run


def similar_sets(records: DataFrame, threshold: float = 0.8, shingle: int = 5, least_words: int = 1, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(tab, id, set) of every record, and (a, b, similarity) of distinct similar sets of one table; records has tab, id and text."""
    spark = records.sparkSession
    kind = records.schema["id"].dataType.simpleString()
    texts = records.where("text <> ''").select("tab", "id", "text")
    chunks = texts.mapInArrow(_sketch(shingle, least_words), "chunk int, counters binary").groupBy("chunk").applyInPandas(_common_bits, "chunk int, bits binary").orderBy("chunk").collect()
    bits = b"".join(bytes(r["bits"]) for r in chunks) or bytes(1 << SKETCH_BITS >> 3)
    needed = runs_needed(threshold, recall)
    shared_bits = spark.sparkContext.broadcast(bits)
    found = materialise(texts.mapInArrow(_records(shingle, least_words, needed, shared_bits), f"tab string, id {kind}, set long, n int, leaves array<long>, parities array<long>"))
    members = found.select("tab", "id", "set").distinct()
    # the set's hash holds the table's; equal sets are folded before anything is spread by path
    classes = found.groupBy("set").agg(F.any_value("n").alias("n"), F.any_value("leaves").alias("leaves"), F.any_value("parities").alias("parities"))
    leaves = classes.select("set", "n", F.explode("leaves").alias("path")).repartition("path")  # one shuffle for both sides of the join
    left, right = leaves.select("path", F.col("set").alias("a"), F.col("n").alias("na")), leaves.select("path", F.col("set").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, "path").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    side = lambda k: classes.select(F.col("set").alias(k), F.col("n").alias(f"n{k}"), F.col("parities").alias(f"p{k}"))
    apart = sum((F.bit_count(F.col("pa")[k].bitwiseXOR(F.col("pb")[k])) for k in range(PARITIES)), F.lit(0))
    # at the threshold sets differ in this share of their sizes' sum; those that surely differ in more are not spelled out
    near = met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where(apart <= (1 - threshold) / (1 + threshold) * (F.col("na") + F.col("nb")) + 1e-6)
    pairs = materialise(near.select("a", "b"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    first = found.select("tab", "id", "set").join(wanted, "set").groupBy("set").agg(F.min(F.struct("tab", "id")).alias("r")).select("r.tab", "r.id", "set")
    tokens = materialise(texts.join(first, ["tab", "id"]).select("set", "text").mapInArrow(_tokens(shingle, least_words), "set long, tokens array<int>").dropDuplicates(["set"]))
    both = pairs.join(tokens.select(F.col("set").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("set").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    similar = both.select("a", "b", (shared / (F.size("ta") + F.size("tb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold)
    return members, similar


def similar_pairs(records: DataFrame, **options) -> DataFrame:
    """(tab, id_a, id_b): all pairs of similar records, the smaller id first; equal texts too."""
    members, similar = similar_sets(records, **options)
    x, y = members.select("tab", F.col("id").alias("x"), F.col("set").alias("a")), members.select("tab", F.col("id").alias("y"), F.col("set").alias("b"))
    across = similar.select("a", "b").join(x, "a").join(y.drop("tab"), "b")
    within = x.join(y.drop("tab").withColumnRenamed("b", "a"), "a")
    pairs = across.select("tab", "x", "y").unionByName(within.select("tab", "x", "y")).where("x <> y")
    return pairs.select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = table(spark, sf_dir, "research_pages"), table(spark, sf_dir, "research_sections")
    return pages.select(F.lit("research_pages").alias("tab"), "id", "text").unionByName(sections.select(F.lit("research_sections").alias("tab"), "id", F.col("content").alias("text")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_tables(spark, sf_dir), threshold=0.7, shingle=3, least_words=40)


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record its class of equal sets and the links of that class to others, at five words and 0.8."""
    members, similar = similar_sets(_tables(spark, sf_dir))
    links = similar.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("links"))
    return members.join(links, "set", "left").select("tab", "id", F.col("set").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_links": p5_links}
SQL: dict[str, str] = {
    "p5_found": r"""WITH r AS (SELECT 'research_pages' AS tab, id, text FROM research_pages UNION ALL SELECT 'research_sections', id, content FROM research_sections),
w AS (SELECT tab, id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM r WHERE text IS NOT NULL),
g AS (SELECT tab, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 40), e AS (SELECT tab, id, len(g) AS n, unnest(g) AS x FROM g)
SELECT tab, id_a, id_b FROM (SELECT a.tab, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.tab = b.tab AND a.x = b.x AND a.id < b.id GROUP BY ALL) WHERE c >= 0.7 * (na + nb - c)""",
}
