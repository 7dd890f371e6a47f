"""Problem 8: byte-level BPE over the whole corpus by a pair occurrence index.

Every partition keeps the distinct pre-tokens it has met.  New ones are laid out in one linked list of byte
tokens; an index maps each mergeable pair to all its positions, and the active ranks are applied in ascending
order, updating only the affected neighbours.  Documents are then gathered from the encoded pre-tokens with numpy.

Null and empty texts give an empty list of ids.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: A vocabulary file is broadcast; one beyond this size is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Encoded pre-tokens kept by a task before its memory of them is emptied.
MAX_CACHED_WORDS = 1_000_000

#: Fixed value: the public pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLOW = regex.compile(PATTERN)
#: The same pattern in the standard library's classes, for texts without the characters on which they differ.
FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")

def _differing() -> frozenset[str]:
    """Characters that the standard library and Unicode properties class differently: other numbers, separators, unassigned."""
    return frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No", "Cn", "Cs")) | {*map(chr, range(0x1C, 0x20)), "\u180e"}


class Pieces:
    """Strings with their ids, in one flat array."""

    def __init__(self) -> None:
        self.places: dict[str | tuple[str], int] = {}
        self.flat, self.lengths = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]

    def add(self, strings: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        for s in strings:
            self.places[s] = len(self.places)
        self.flat.append(flat)
        self.lengths.append(lengths)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, and where each string's ids end, from 0 on."""
        if len(self.flat) > 1:
            self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        lengths = self.lengths[0]
        starts, size = np.cumsum(lengths) - lengths, lengths[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.flat[0][np.repeat(starts[at] - ends[:-1], size) + np.arange(int(ends[-1]))], ends


class PairIndexEncoder:
    """Encodes distinct pre-tokens together; keeps what it has encoded."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        for n, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + n)
        self.byte_ids = [vocab[shown[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[a], vocab[b]] = rank
            self.made.append((vocab[a], vocab[b], vocab[a + b]))
        self.differing = _differing()
        self.forget()

    def forget(self) -> None:
        self.words, self.units = Pieces(), Pieces()

    def split(self, text: str) -> list[str]:
        return FAST.findall(text) if self.differing.isdisjoint(text) else SLOW.findall(text)

    def learn(self, words: list[str]) -> None:
        """Encode new distinct pre-tokens: one linked list, one index of pairs, ranks in ascending order."""
        ids: list[int] = []
        ends = []
        byte_ids = self.byte_ids
        for w in words:
            ids.extend([byte_ids[b] for b in w.encode("utf-8", "surrogatepass")])
            ends.append(len(ids))
        n = len(ids)
        following = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        start = 0
        for e in ends:
            if e > start:
                before[start], following[e - 1] = -1, -1
            start = e
        ranks = self.ranks
        index: dict[int, list[int]] = {}
        for p in range(n):
            q = following[p]
            if q >= 0 and (r := ranks.get((ids[p], ids[q]))) is not None:
                index.setdefault(r, []).append(p)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, new = self.made[rank]
            for p in sorted(index.pop(rank)):
                q = following[p]
                if ids[p] != a or q < 0 or ids[q] != b:
                    continue
                ids[p], ids[q] = new, -1
                after = following[q]
                following[p] = after
                if after >= 0:
                    before[after] = p
                    if (r := ranks.get((new, ids[after]))) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(active, r)
                        index[r].append(p)
                if (left := before[p]) >= 0 and (r := ranks.get((ids[left], new))) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(left)
        flat = np.array(ids, dtype=np.int32)
        live = flat >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        edges = np.concatenate([[0], np.array(ends, dtype=np.int64)])
        self.words.add(words, flat[live], np.diff(counts[edges]))

    def _add(self, units: list[str | tuple[str]]) -> None:
        """Units are stretches of text that begin and end between pre-tokens; a bare string follows a space, a tuple doesn't."""
        split = [self.split(" " + u if isinstance(u, str) else u[0]) for u in units]
        if new := set().union(*split).difference(self.words.places):
            self.learn(sorted(new))
        places = self.words.places
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        flat, ends = self.words.gather(at)
        of_units = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))])]
        self.units.add(units, flat, np.diff(of_units))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts.

        A single space before a non-space always begins a pre-token, so texts are looked up by the stretches
        between such spaces; a text with white space beside one of its spaces is looked up as its pre-tokens.
        """
        if len(self.words.places) + len(self.units.places) > MAX_CACHED_WORDS:
            self.forget()
        split: list[list] = [t.split(" ") if t else [] for t in texts]
        unsafe = {u for u in set().union(*split) if not u or u[0].isspace() or u[-1].isspace()}
        for n, units in enumerate(split):
            if units and not unsafe.isdisjoint(units):
                split[n] = [(w,) for w in self.split(texts[n])]
            elif units:
                units[0] = (units[0],)
        places = self.units.places
        if new := set().union(*split).difference(places):
            self._add([*new])
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        flat, ends = self.units.gather(at)
        return ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))])].astype(np.int32), flat


_ENCODERS: dict[int, PairIndexEncoder] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row; the vocabulary file is read once on the driver and broadcast (its size is checked)."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hash(shared.value)
        if mark not in _ENCODERS:
            _ENCODERS[mark] = PairIndexEncoder(shared.value)
        encoder = _ENCODERS[mark]
        for batch in batches:
            step = 1000
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                offsets, flat = encoder.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters by language tag, to plan token budgets."""
    docs = table(spark, sf_dir, "documents")
    sizes = encode_corpus(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    return (
        docs.select("doc_id", "lang", F.length("text").cast("long").alias("n"))
        .join(sizes, "doc_id")
        .groupBy("lang")
        .agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.coalesce("n", F.lit(0).cast("long"))).alias("characters"))
    )


QUERIES = {"p8_ids": p8_ids, "p8_length_profile": p8_length_profile}
SQL: dict[str, str] = {}
