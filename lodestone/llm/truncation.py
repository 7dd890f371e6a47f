"""Problem 6: text cut off by field limits, by discrete length hazards.

For every table, and for every source (table, host and scraper), the hazard of a length is the share of the texts of at
least that length that have exactly it, computed by window functions over the counts of lengths.  Each is tested against the
hazard of its neighbours, and lengths with a false discovery rate under ``FDR`` are field limits.  At a field limit any
incomplete ending is a cut: an open sentence, list item, label or table row.  Two endings are cuts at other lengths too,
each a reason of its own: the mark of a cut (``mark``), and a body sentence left open after other body lines (``transfer``),
as a transfer that broke off has no length of its own.  Whether the last line is body is decided by the trees of problem 1;
at a limit or with a mark, a line that they take for furniture must also recur at texts of several lengths.
Rows of residue (problem 3), null and empty texts are no cases.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.boilerplate import TOGETHER, Model, decode, fit_model
from lodestone.llm.pages import SHAPES, features, page_bodies, page_lines, page_texts, pages_without_body
from lodestone.llm.residue import page_values, residue_rows
from lodestone.session import materialise

FDR = 0.001
#: Lengths on either side that a length is compared with, and times their hazard that it must have.
NEIGHBOURS, TIMES = 40, 4.0
#: Marks of a cut at the end of a text.
MARK = re.compile(r"(?i)(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\(cont(?:inued|\.|d)?\)?|>+ ?more|\[(?:truncated|cut|more)\]|\(truncated\)|�|\*\*|\[\+\d+ chars\])\s*$")
ENDS = re.compile(r"[.!?。:;][\"'”’»)\]]*$")


#: Blanks of a line that is a sentence, though no body line stands before it.
LONG = 7
#: Different text lengths at which the same last line (numbers and names apart) must stand to be a footer that recurs.
RECURS = 3


def tails_of(texts: list[str | None], model: Model | None) -> list[tuple[str, bool, str | None]]:
    """How each text ends, whether the trees take its last line for furniture, and that line without numbers and names (null if closed).

    'closed', 'mark', 'open' (a sentence, or any line after body sentences), or 'item', 'label', 'table', 'line' (unclosed, of that form).
    """
    out: list = [("closed", False, None)] * len(texts)
    doubtful = []
    for k, text in enumerate(texts):
        t = (text or "").rstrip()
        last = t[t.rfind("\n") + 1 :].strip()
        if last and last[0] != "#" and (MARK.search(last) or not (ENDS.search(last) or last[0] == last[-1] == "|") or re.match(r"[-*•→]\s", last)):
            doubtful.append(k)
    for lo in range(0, len(doubtful), TOGETHER):
        part = doubtful[lo : lo + TOGETHER]
        lines = page_lines([texts[k] for k in part])
        outside = decode(lines.block, lines.run, lines.shape, model.log_odds(features(lines, model.weights))) if model else np.zeros(len(lines.text), dtype=bool)
        edges = np.searchsorted(lines.page, np.arange(len(part) + 1))
        for n, k in enumerate(part):
            at = edges[n + 1] - 1
            last, form = lines.text[at], SHAPES[lines.shape[at]]
            if MARK.search(last):
                end = "mark"
            elif form in ("bullet", "table", "label"):
                end = {"bullet": "item"}.get(form, form)
            else:
                after_body = (lines.shape[edges[n] : at][~outside[edges[n] : at]] == SHAPES.index("sentence")).any()
                end = "open" if after_body or last.count(" ") >= LONG else "line"
            out[k] = (end, bool(outside[at]), re.sub(r"(?<=\s)[A-ZÀ-Þ]\S*|\d+", "0", last))
    return out


def _upper_tail(seen: pd.Series, expected: pd.Series) -> pd.Series:
    """Chance of at least so many where so many are expected (Poisson)."""

    def chance(k: int, mu: float) -> float:
        if k <= mu:
            return 1.0
        term = math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) if mu > 0 else 0.0
        total, n = term, k
        while term > total * 1e-12 and n < k + 10_000:
            n += 1
            term *= mu / n
            total += term
        return min(1.0, total)

    return pd.Series([chance(int(k), float(m)) for k, m in zip(seen, expected, strict=True)])


def field_limits(lengths: DataFrame) -> DataFrame:
    """(source, n) of the lengths with a significant hazard; lengths has source and n, a row for each text."""
    counts = lengths.groupBy("source", "n").agg(F.count("*").alias("k"))  # one row a length: windows below hold lengths, not texts
    by_length = W.partitionBy("source").orderBy("n")
    around = by_length.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    risk = counts.withColumn("risk", F.sum("k").over(by_length.rangeBetween(W.currentRow, W.unboundedFollowing)))
    usual = risk.withColumn("near", (F.sum("k").over(around) - F.col("k")) / F.lit(2.0 * NEIGHBOURS))
    # where the neighbours are empty, half a text is taken for them all
    tested = usual.withColumn("p", F.pandas_udf(_upper_tail, "double")("k", F.greatest("near", F.lit(0.5 / NEIGHBOURS)))).where(F.col("k") > 1)
    ranked = tested.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("p"))).withColumn("tests", F.count("*").over(W.partitionBy("source")))
    cut = ranked.where(F.col("p") <= FDR * F.col("rank") / F.col("tests")).groupBy("source").agg(F.max("rank").alias("last"))
    significant = (F.col("rank") <= F.col("last")) & (F.col("k") >= TIMES * F.col("near")) & (F.col("k") >= 4)
    return ranked.join(cut, "source").where(significant).select("source", "n", "k", (F.col("k") / F.col("risk")).alias("hazard"))


def _source(*columns: str) -> F.Column:
    return F.xxhash64(*[F.coalesce(c, F.lit("")) for c in columns])


def judged(rows: DataFrame, values: DataFrame, model: Model | None) -> DataFrame:
    """The rows with text, with how they end (`tail`), whether their length is a field limit (`limit`) and why they count as cut (`reason`, or null); rows has tab, id, host, scraper and text, values those of residue_rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def ends(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(tails_of(texts.tolist(), shared.value), columns=["tail", "furniture", "last"])

    scored = rows.where("text <> ''").select("tab", "id", "host", "scraper", F.length("text").alias("n"), F.pandas_udf(ends, "tail string, furniture boolean, last string")("text").alias("end"))
    tails = materialise(scored.select("tab", "id", "host", "scraper", "n", "end.tail", "end.furniture", F.xxhash64("end.last").alias("last")))
    footers = tails.where("furniture").groupBy("last").agg(F.count_distinct("n").alias("lengths")).where(F.col("lengths") >= RECURS).select("last", F.lit(True).alias("footer"))
    sources = F.explode(F.array(_source("tab"), _source("tab", "host", "scraper"))).alias("source")
    limits = field_limits(tails.select(sources, "n")).select("source", "n").distinct()
    at_limit = tails.select("tab", "id", "n", sources).join(limits, ["source", "n"], "left_semi").select("tab", "id").distinct().withColumn("at", F.lit(True))
    footer = F.coalesce("footer", F.lit(False)) & F.col("furniture")
    reason = F.when(footer | (F.col("tail") == "closed"), None).when(F.col("tail") == "mark", "mark").when(F.col("limit"), "limit").when((F.col("tail") == "open") & ~F.col("furniture"), "transfer")
    marked = tails.join(at_limit, ["tab", "id"], "left").join(footers, "last", "left").withColumn("limit", F.coalesce("at", F.lit(False)))
    found = materialise(marked.select("tab", "id", "host", "scraper", "n", "tail", "furniture", "limit", reason.alias("why")))
    residue = residue_rows(values, found.where("why is not null").select("tab", "id").distinct()).select("tab", "id", F.lit(True).alias("residue"))
    return found.join(residue, ["tab", "id"], "left").withColumn("reason", F.when(F.col("residue").isNull(), F.col("why"))).drop("why", "residue")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_texts(spark, sf_dir)
    return judged(rows, page_values(spark, sf_dir), fit_model(rows, page_bodies(spark, sf_dir), pages_without_body(spark, sf_dir)))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("reason is not null").select("tab", "id").distinct()


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table, host and scraper: all its rows, rows with text, cut rows by reason, and the share of its rows that are cut."""
    key = ["tab", "host", "scraper"]
    cut = lambda why: F.coalesce(F.count_if(F.col("reason") == why), F.lit(0)).alias(why)
    found = _judged(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("with_text"), cut("limit"), cut("mark"), cut("transfer"), F.count_if(F.col("reason").isNotNull()).alias("cut"))
    return page_texts(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("rows")).join(found, key, "left").na.fill(0).withColumn("share", F.col("cut") / F.col("rows"))


QUERIES = {"p6_found": p6_found, "p6_share": p6_share}
SQL: dict[str, str] = {}
