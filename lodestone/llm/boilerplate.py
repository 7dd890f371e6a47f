"""Problem 1: page furniture around the main body, by gradient-boosted trees over line nodes and hierarchical decoding.

Captures hold text, so the tree is read off the text: blocks between blank lines, runs of lines of one shape within a block
(with their heading), and lines.  Labels come from pages whose body is known: their body lines are body, all other lines
furniture.  Of pages known to have no body (error pages, filler), lines that are furniture elsewhere are furniture, and lines
that come again are none.  Features are hashed attribute tokens, weighed by what labelled lines of other folds say about
them, densities of the block and the run, depth, heading and neighbours.  The trees are fitted by Spark on at most
``TRAIN_PAGES`` pages; scoring runs where the pages are.

Decoding gives every node of the tree the label of the best labelling: a block or a run is furniture, body or split; what is
below one that isn't split has its label, and a split costs ``SPLIT``.  So no line contradicts the list or block it stands in.

Null and empty texts have no lines; their main text is as it was.  Without labelled pages of both kinds no line is furniture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.pages import BUCKETS, NAMES, SHAPES, STRETCH, buckets_of, features, page_bodies, page_lines, page_texts, pages_without_body, pairs_of, starts_of
from lodestone.session import materialise

#: Pages with a known body, and pages known to have none, that the trees may learn from.
TRAIN_PAGES, TRAIN_WITHOUT = 1_500, 500
TREES, DEPTH, FOLDS = 30, 5, 5
#: Cost in log-odds of splitting a block, a run of lines of like form (list, table, labels), and any other run.
SPLIT = (0.5, 12.0, 0.5)
TOGETHER = 500


class Model:
    """Token weights, and the fitted trees as arrays: feature, threshold, children and value of every node."""

    def __init__(self, weights: np.ndarray, roots: list[tuple]):
        self.weights = weights
        self.trees = [(w, *(np.array(x) for x in zip(*nodes, strict=True))) for w, nodes in roots]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for weight, feature, threshold, left, right, value in self.trees:
            leaf = feature < 0  # a leaf leads to itself
            asked, children = np.maximum(feature, 0), np.stack([np.where(leaf, np.arange(len(leaf)), right), np.where(leaf, np.arange(len(leaf)), left)], axis=1).ravel()
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = children.take(2 * at + (flat.take(row + asked.take(at)) <= threshold.take(at)))
            out += weight * value[at]
        return 2 * out


def _flatten(root) -> list[tuple]:
    """Nodes of one tree as (feature or -1, threshold, left, right, prediction); read from the model in the driver."""
    nodes: list = []

    def visit(node) -> int:
        place = len(nodes)
        nodes.append(None)
        if node.subtreeDepth() == 0:
            nodes[place] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            nodes[place] = (split.featureIndex(), split.threshold(), visit(node.leftChild()), visit(node.rightChild()), 0.0)
        return place

    visit(root)
    return nodes


def decode(block: np.ndarray, run: np.ndarray, shape: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Whether each line is furniture in the best labelling of the tree, worked out bottom up and read off top down."""
    if not len(odds):
        return np.zeros(0, dtype=bool)
    runs = np.append(True, run[1:] != run[:-1])
    alike = np.isin(shape[np.append(runs[1:], True)], [SHAPES.index(x) for x in ("bullet", "table", "label")])
    of_run = np.cumsum(runs) - 1
    total = np.bincount(of_run, weights=odds)
    split = np.bincount(of_run, weights=np.abs(odds)) - np.where(alike, SPLIT[1], SPLIT[2])
    best = np.maximum(np.abs(total), split)
    block_of_run = block[runs]
    blocks = np.append(True, block_of_run[1:] != block_of_run[:-1])
    of_block = np.cumsum(blocks) - 1
    whole = np.bincount(of_block, weights=total)
    parts = np.bincount(of_block, weights=best) - SPLIT[0]
    pure = np.abs(whole) >= parts
    run_pure = pure[of_block] | (np.abs(total) >= split)
    run_label = np.where(pure[of_block], whole[of_block] > 0, total > 0)
    return np.where(run_pure[of_run], run_label[of_run], odds > 0)


def _key(line) -> F.Column:
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(line), STRETCH, "0"), r"\d+", "0"))


def labelled_lines(pages: DataFrame, bodies: DataFrame, without: DataFrame) -> DataFrame:
    """(text, labels) of a bounded sample of pages; labels has (number, label, fold) of the lines with a label.

    pages has tab, id and text; bodies has tab, id and body, in one row a page or several; without has tab and id.
    """
    pages = pages.where("text <> ''").select("tab", "id", "text")
    drawn = lambda known, most: known.select("tab", "id").distinct().where(F.pmod(F.xxhash64("tab", "id"), F.lit(1_000_003)) < F.lit(1_000_003 * min(1.0, most / max(known.select("tab", "id").distinct().count(), 1))).cast("long"))
    chosen = drawn(bodies, TRAIN_PAGES).withColumn("kind", F.lit(1)).unionByName(drawn(without, TRAIN_WITHOUT).withColumn("kind", F.lit(0)))
    sample = materialise(pages.join(chosen, ["tab", "id"]))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"^#+\s*", ""))
    lines = sample.select("tab", "id", "kind", F.posexplode(F.split("text", "\n")).alias("number", "line")).withColumn("line", bare("line")).where("line <> ''").withColumn("key", _key(F.col("line")))
    body = bodies.join(chosen, ["tab", "id"], "left_semi").select("tab", "id", F.explode(F.split("body", "\n")).alias("line")).select("tab", "id", bare("line").alias("line")).distinct().withColumn("in_body", F.lit(True))
    known = lines.join(body, ["tab", "id", "line"], "left").withColumn("outside", F.when(F.col("kind") == 1, F.col("in_body").isNull()))
    forms = known.groupBy("key").agg(F.coalesce(F.max("outside"), F.lit(False)).alias("seen_outside"), F.count_distinct(F.when(F.col("kind") == 0, F.struct("tab", "id"))).alias("n_without"))
    label = F.when(F.col("kind") == 1, F.col("outside").cast("int")).when(F.col("seen_outside"), 1).when(F.col("n_without") > 1, 0)
    labels = known.join(forms, "key").withColumn("label", label).where("label is not null")
    entry = F.struct(F.col("number").cast("int").alias("number"), "label", F.pmod("key", F.lit(FOLDS)).cast("int").alias("fold"), "key")
    return materialise(sample.join(labels.groupBy("tab", "id").agg(F.collect_list(entry).alias("labels")), ["tab", "id"]).select("text", "labels"))


def token_counts(sample: DataFrame) -> np.ndarray:
    """Counts (fold, label, bucket) of token and pair buckets; a line counts once however often it comes."""
    lines = sample.select("text", F.explode("labels").alias("l")).select(F.element_at(F.split("text", "\n"), F.col("l.number") + 1).alias("line"), "l.label", "l.fold", "l.key")
    distinct = lines.groupBy("label", "key").agg(F.any_value("line").alias("line"), F.any_value("fold").alias("fold"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, sizes = buckets_of([s.strip() for s in batch["line"]])
            both = np.concatenate([tokens, BUCKETS + pairs_of(tokens, sizes), BUCKETS + starts_of(tokens, sizes)])
            line = np.concatenate([np.tile(np.repeat(np.arange(len(sizes)), sizes), 2), np.arange(len(sizes))])
            once = pd.DataFrame({"line": line, "bucket": both}).drop_duplicates()
            yield pd.DataFrame({"bucket": once["bucket"], "label": batch["label"].to_numpy()[once["line"]], "fold": batch["fold"].to_numpy()[once["line"]]}).value_counts().rename("n").reset_index()

    counts = np.zeros((FOLDS, 2, 2 * BUCKETS))
    found = distinct.mapInPandas(count, "bucket long, label int, fold int, n long").groupBy("bucket", "label", "fold").agg(F.sum("n").alias("n"))
    for r in found.toLocalIterator():  # bounded by the number of buckets and folds
        counts[r.fold, r.label, r.bucket] = r.n
    return counts


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds of furniture for each bucket, shrunk towards none."""
    total = counts.sum(axis=1, keepdims=True) / 2 + 1
    share = (counts + 0.5) / total
    return np.log(share[1]) - np.log(share[0])


def fit_model(pages: DataFrame, bodies: DataFrame, without: DataFrame) -> Model | None:
    """Weights and trees fitted on a bounded sample of the labelled pages; None without lines of both kinds."""
    sample = labelled_lines(pages, bodies, without)
    counts = token_counts(sample)
    if not counts.sum(axis=(0, 2)).all():
        return None
    everything = counts.sum(axis=0)
    by_fold = pages.sparkSession.sparkContext.broadcast([weights_of(everything - counts[k]) for k in range(FOLDS)])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = page_lines(batch["text"].tolist())
            label, fold = np.full(len(lines.text), -1), np.zeros(len(lines.text), dtype=int)
            at = {(p, n): k for k, (p, n) in enumerate(zip(lines.page.tolist(), lines.number.tolist(), strict=True))}
            for p, labels in enumerate(batch["labels"]):
                for entry in labels:
                    if (k := at.get((p, entry["number"]))) is not None:
                        label[k], fold[k] = entry["label"], entry["fold"]
            for f, weights in enumerate(by_fold.value):
                chosen = (fold == f) & (label >= 0)
                if chosen.any():
                    yield pd.DataFrame({"label": label[chosen].astype(float), "features": list(features(lines, weights)[chosen])})

    fitted = materialise(sample.mapInPandas(rows, "label double, features array<double>")).coalesce(4)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, subsamplingRate=0.8, seed=5, maxMemoryInMB=512).fit(fitted.select("label", array_to_vector("features").alias("features")))
    return Model(weights_of(everything), [(w, _flatten(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)])


def furniture_of(texts: list[str | None], model: Model | None) -> Iterator[tuple[int, list[int], list[int]]]:
    """For each text its place, the numbers of its non-blank lines, and those of them outside the body."""
    for lo in range(0, len(texts), TOGETHER):
        part = texts[lo : lo + TOGETHER]
        lines = page_lines(part)
        out = decode(lines.block, lines.run, lines.shape, model.log_odds(features(lines, model.weights))) if model else np.zeros(len(lines.text), dtype=bool)
        edges = np.searchsorted(lines.page, np.arange(len(part) + 1))
        for k in range(len(part)):
            numbers = lines.number[edges[k] : edges[k + 1]]
            yield lo + k, numbers.tolist(), numbers[out[edges[k] : edges[k + 1]]].tolist()


def furniture(pages: DataFrame, bodies: DataFrame, without: DataFrame) -> DataFrame:
    """(tab, id, line_no) of every line outside the body; the tables as in labelled_lines."""
    shared = pages.sparkSession.sparkContext.broadcast(fit_model(pages, bodies, without))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tabs, ids = batch["tab"].tolist(), batch["id"].tolist()
            found = [(tabs[k], ids[k], n) for k, _, outside in furniture_of(batch["text"].tolist(), shared.value) for n in outside]
            yield pd.DataFrame(found, columns=["tab", "id", "line_no"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.where("text <> ''").select("tab", "id", "text").mapInPandas(run, f"tab string, id {kind}, line_no int")


def main_text(pages: DataFrame, bodies: DataFrame, without: DataFrame) -> DataFrame:
    """(tab, id, main_text): the body lines of every row, in order."""
    shared = pages.sparkSession.sparkContext.broadcast(fit_model(pages, bodies, without))

    def strip(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else None for t in texts]
        out = list(values)
        for k, _, numbers in furniture_of(values, shared.value):
            if numbers:
                drop = set(numbers)
                out[k] = "\n".join(x for n, x in enumerate(values[k].split("\n")) if n not in drop).strip("\n")
        return pd.Series(out, dtype=object)

    return pages.select("tab", "id", F.pandas_udf(strip, "string")("text").alias("main_text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(page_texts(spark, sf_dir), page_bodies(spark, sf_dir), pages_without_body(spark, sf_dir)).distinct()


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(page_texts(spark, sf_dir), page_bodies(spark, sf_dir), pages_without_body(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_main_text": p1_main_text}
SQL: dict[str, str] = {}
assert len(NAMES) == 54
