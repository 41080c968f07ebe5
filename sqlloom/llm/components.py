"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    ``links`` has columns a and b.  Labels fall to the smallest among a node's
    neighbours, then to the label's own label, until none changes; each round
    is a written table.  Neighbours' labels are combined before they shuffle.
    Before the first round each edge is led to the smallest neighbour of its
    larger end, which makes one star of the many that share members.  A label
    that many nodes have, and a node with many links, are hot keys of
    sort-merge joins of narrow rows, which adaptive execution splits.
    """
    up = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    least = up.groupBy("b").agg(F.min("a").alias("least"))
    led = up.join(least, "b").select("least", F.explode(F.array("a", "b")).alias("node")).filter("least < node").distinct()
    both = materialize(led.select(F.explode(F.expr("array(named_struct('a', least, 'b', node), named_struct('a', node, 'b', least))")).alias("x")).select("x.a", "x.b"), "links")
    held = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "roots")
    labels = held
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        fell = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = fell.join(jump, F.col("low") == F.col("via")).select("node", "old", F.least("low", "far").alias("root"))
        step = materialize(step, "roots")
        discard(held)
        held, labels = step, step.select("node", "root")
        labels._written = step._written
        if step.filter("root < old").isEmpty():
            discard(both)
            return labels
