"""Connected components of a link table, in rounds of shuffles that are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in a link, the smallest id that it reaches.

    Each round gives an id the smallest label among its neighbours', then the label of its label, so stars need two rounds and
    chains a logarithmic number of them. Ids that no link names have no row.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = materialise(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("component")), "labels")
    while True:
        heard = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, labels["id"] == heard["u"]).select("id", F.least("component", "heard").alias("component"))
        far = nearer.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = materialise(nearer.join(far, "component").select("id", F.col("further").alias("component")), "labels")
        changed = moved.join(labels.withColumnRenamed("component", "before"), "id").filter("component <> before").limit(1).count()
        labels = moved
        if not changed:
            return labels
