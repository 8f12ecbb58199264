"""Connected components of a link table by least-label spreading with label jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from timberline.session import materialize


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the least node of each component, for every node of ``links(a, b)``.

    ``labels`` may give labels of an earlier call to start from. Each round takes the least label
    among neighbours (combined before the shuffle), then the label of the label; rounds are about
    the logarithm of the longest chain. Every round is a written table, so lineage stays short.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "links")
    nodes = both.select(F.col("a").alias("node")).distinct()
    if labels is None:
        now = nodes.select("node", F.col("node").alias("label"))
    else:
        now = nodes.join(labels, "node", "full").select("node", F.coalesce("label", "node").alias("label"))
    now = materialize(now, "labels")
    while True:
        near = (
            both.join(now.select(F.col("node").alias("b"), "label").hint("merge"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        # the label of a component's label moves with it
        moved = now.join(near.hint("merge"), "node", "left").select(
            "node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        moved = materialize(moved, "labels")
        hooks = moved.groupBy(F.col("label").alias("root")).agg(F.min("next").alias("hook"))
        step = moved.join(hooks.hint("merge"), moved["next"] == hooks["root"], "left").select(
            "node", "label", F.coalesce("hook", "next").alias("next"))
        step = materialize(step, "labels")
        if step.filter("next <> label").isEmpty():
            return step.select("node", "label")
        now = step.select("node", F.col("next").alias("label"))
