"""Connected components of an edge table, by repeated smallest-neighbour labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the least node of its component.

    Each round every node takes the least label among itself and its neighbours, then the label of its label, so chains
    shrink by about half a round.  Hubs only pass through map-side combined minima.  Rows with a null end are ignored.
    Each round is written to the shared folder, so a lost executor costs one round.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialise(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.x).select("node", "label", F.least("label", "near").alias("new"))
        jumped = materialise(
            lower.join(lower.select(F.col("node").alias("new"), F.col("new").alias("further")), "new", "left")
            .select("node", F.col("label").alias("old"), F.least("new", F.coalesce("further", "new")).alias("label"))
        )
        labels = jumped.select("node", "label")
        if not jumped.where("label <> old").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
