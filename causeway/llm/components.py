"""Connected components of a table of links, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of a link.

    Each round a node takes the smallest label among its neighbours and then the label of its label, so
    the rounds grow with the logarithm of a component's breadth. A round is written to the shared folder;
    only the number of changed labels comes to the driver. Null ends, loops and repeated links do no harm.
    """
    one = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "m").alias("to"), F.col("component").alias("was"))
        hooked = written(hooked, "hooked")
        over = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = written(hooked.join(over, "to").select("node", F.col("next").alias("component"), "was"), "labels")
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
