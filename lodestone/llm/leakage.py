"""Problem 9: evaluation passages inside the corpus, by one Aho-Corasick automaton over normalised windows of the items.

Words are the runs of letters, digits and ``_`` in the lower-cased text.  Every window of ``words`` consecutive words of
an item is a pattern; the normalised document is scanned once, and hits are mapped back to character offsets of the
original text.  Items shorter than the window cannot leak by this definition.  Null and empty texts hold nothing.

The item side is a stated query set: it is gathered in blocks of bounded size, one automaton and one scan a block.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

WORD = re.compile(r"\w+")
#: Windows in one automaton; more windows make more blocks, each scanned over the corpus.
BLOCK_WINDOWS = 500_000
NOT_WORDS = r"[^\p{L}\p{N}_]+"


def normalised(column) -> F.Column:
    """The words, single spaces between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(column), NOT_WORDS, " ")), F.lit(" "))


def item_windows(items: DataFrame, words: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item_ids): distinct windows with the items that hold them."""
    split = F.split(F.trim(normalised(F.col(text))), " ")
    return (
        items.where(F.col(text).isNotNull() & F.col(key).isNotNull())
        .select(F.col(key).alias("item_id"), split.alias("w"))
        .where(F.size("w") >= words)
        .select("item_id", F.explode(F.expr(f"transform(sequence(0, size(w) - {words}), i -> concat(' ', array_join(slice(w, i + 1, {words}), ' '), ' '))")).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )


_AUTOMATA: dict[int, ahocorasick.Automaton] = {}


def _automaton(raw: bytes) -> ahocorasick.Automaton:
    mark = hash(raw)
    if mark not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for window, ids in pickle.loads(raw):
            made.add_word(window, ids)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[mark] = made
    return _AUTOMATA[mark]


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Begin and end of each word in the original text; a character whose lower case is longer counts once."""
    lowered = text.lower()
    if len(lowered) == len(text):
        return [m.span() for m in WORD.finditer(lowered)]
    origin = [n for n, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(lowered)]


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, first_char, end_char, n_words): the stretches of each document that come from an item, at least `words` long."""
    spark = docs.sparkSession
    windows = item_windows(items, words)
    kind = docs.schema[key].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_kind}, doc_id {kind}, first_char int, end_char int, n_words int"
    scanned = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("n"), F.col(text).alias("t"))

    def scan(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(shared.value)
            for batch in batches:
                rows = []
                for doc, norm, original in zip(batch["doc_id"], batch["n"], batch["t"], strict=True):
                    found: dict = {}
                    at = spaces = 0
                    for end, ids in automaton.iter(norm):
                        spaces += norm.count(" ", at, end + 1)  # ends come in order: the text is walked once
                        at = end + 1
                        first = spaces - words - 1
                        for item in ids:
                            spans = found.setdefault(item, [])
                            if spans and first <= spans[-1][1]:
                                spans[-1][1] = first + words
                            else:
                                spans.append([first, first + words])
                    if found:
                        at = word_offsets(original)
                        last = len(at) - 1
                        for item, spans in found.items():
                            rows += [(item, doc, at[min(a, last)][0], at[min(b - 1, last)][1], b - a) for a, b in spans]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "first_char", "end_char", "n_words"])

        return run

    out, block = None, []

    def close(part: list) -> DataFrame:
        hits = scanned.mapInPandas(scan(spark.sparkContext.broadcast(pickle.dumps(part))), schema)
        return hits if out is None else out.unionByName(hits)

    for row in windows.toLocalIterator():  # one block at a time is held here
        block.append((row["window"], row["item_ids"]))
        if len(block) == BLOCK_WINDOWS:
            out, block = close(block), []
    if block:
        out = close(block)
    return spark.createDataFrame([], schema) if out is None else out


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id").distinct()


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each suite: items, items that leaked, and documents that hold one."""
    items = table(spark, sf_dir, "eval_items")
    found = p9_found(spark, sf_dir)
    return (
        items.select("item_id", "suite")
        .join(found, "item_id", "left")
        .groupBy("suite")
        .agg(F.countDistinct("item_id").alias("items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("leaked"), F.countDistinct("doc_id").alias("documents"))
    )


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p9_found": p9_found, "p9_leaked_items": p9_leaked_items, "p9_spans": p9_spans}
_WINDOWS = r"""SELECT k, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS x FROM (SELECT {key} AS k, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 13"""
_FOUND = f"SELECT DISTINCT i.k AS item_id, d.k AS doc_id FROM ({_WINDOWS.format(key='item_id', table='eval_items')}) i JOIN ({_WINDOWS.format(key='doc_id', table='documents')}) d ON i.x = d.x"
SQL: dict[str, str] = {
    "p9_found": _FOUND,
    "p9_leaked_items": f"SELECT suite, count(DISTINCT e.item_id) AS items, count(DISTINCT f.item_id) AS leaked, count(DISTINCT f.doc_id) AS documents FROM eval_items e LEFT JOIN ({_FOUND}) f ON e.item_id = f.item_id GROUP BY suite",
}
