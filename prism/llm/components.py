"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prism.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> node, component (the smallest node that it reaches).

    Every round each node takes the smallest label among its own and its neighbours',
    and then the label of that label (pointer jumping), so long chains fold up in a
    logarithmic number of rounds. Minima are combined before each shuffle, so a node
    with very many neighbours costs its tasks one row each; every round is a written table.
    Nodes without an edge to another node are not returned; no edges give no rows.
    """
    both = cut_lineage(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(),
                       "component-edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
                         "component-labels")
    while True:
        e, l = both.alias("e"), labels.alias("l")
        heard = (e.join(l, F.col("e.b") == F.col("l.node")).groupBy(F.col("e.a").alias("node"))
                 .agg(F.min("l.label").alias("heard")))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        n, j = nearer.alias("n"), labels.alias("j")
        labels = cut_lineage(n.join(j, F.col("n.next") == F.col("j.node")).select(
            "n.node", F.least("n.next", "j.label").alias("label"),
            (F.least("n.next", "j.label") < F.col("n.label")).alias("changed")), "component-labels")
        if labels.where("changed").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.drop("changed")
