"""Single-linkage clusters from matching pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.session import materialize


def coverage_pairs(
    hits: DataFrame, length: float = 0.9, score: float = 1.75, both_sides: bool = True
) -> DataFrame:
    """(a, b): pairs covering enough of their records and scoring enough bits per residue.

    ``hits`` are the rows of ``similarity.search``.  A ``score`` of 3 or more is a percentage of identities.
    """
    q = (F.col("q_to") - F.col("q_from") + 1) / F.col("q_len")
    d = (F.col("d_to") - F.col("d_from") + 1) / F.col("d_len")
    covered: Column = (F.least(q, d) if both_sides else F.greatest(q, d)) >= length
    span = F.greatest(F.col("q_to") - F.col("q_from"), F.col("d_to") - F.col("d_from")) + 1
    strong = F.col("bits") / span >= score if score < 3 else 100 * F.col("identities") / span >= score
    return hits.where(covered & strong).select(F.col("query_id").alias("a"), F.col("db_id").alias("b"))


def single_linkage(ids: DataFrame, pairs: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, cluster): connected components, named by their smallest id.

    Each round takes the smallest label among the neighbours and then follows
    labels once (pointer jumping), so rounds grow with the logarithm of a
    cluster's diameter.  Neighbour minima are combined map-side; a record linked
    to very many others costs no large group.  Rounds are cut by a written table.
    """
    edges = pairs.where("a <> b").select("a", "b").unionAll(pairs.where("a <> b").select("b", "a")).distinct()
    edges = materialize(edges.toDF("a", "b"), "links")
    labels = materialize(ids.select(F.col(id_column).alias("id"), F.col(id_column).alias("cluster")), "labels")
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["id"])
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("cluster").alias("near"))
        )
        lower = labels.join(near, "id", "left").select(
            "id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("near", "cluster")).alias("mid")
        )
        lower = materialize(lower, "labels")
        if not lower.where("mid < old").limit(1).count():
            return labels.select("id", "cluster")
        # The label of a label; every label is itself an id.
        target = lower.select(F.col("id").alias("mid"), F.col("mid").alias("cluster"))
        labels = materialize(lower.select("id", "mid").join(target, "mid").select("id", "cluster"), "labels")
