"""Connected components by repeated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import removed, written


def components(nodes: DataFrame, links: DataFrame, key: str = "key", a: str = "a", b: str = "b") -> DataFrame:
    """(key, component): the smallest key that links lead to; a node without links is its own.

    Each round takes the least label among neighbours and then the label of
    the label, so long chains shorten by halves. Rounds are written out, so the
    joins of links and labels read two stored tables and AQE can split a hub's.
    Labels are as many as nodes, but so small as files that they would be
    broadcast; by the hints they never pass through the driver.
    """
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).where("u <> v").distinct(), "links")
    labels, last = nodes.select(key, F.col(key).alias("component")).distinct(), None
    while True:
        near = both.join(labels.where("component IS NOT NULL").hint("merge"), F.col("v") == F.col(key)).groupBy("u").agg(F.min("component").alias("m"))
        low = labels.join(near.hint("merge"), F.col(key) == F.col("u"), "left").select(key, "component", F.least("component", "m").alias("m"))
        jump = labels.select(F.col(key).alias("m"), F.col("component").alias("j"))
        after = written(low.join(jump.hint("merge"), "m", "left").select(key, F.least("m", "j").alias("component"), (F.least("m", "j") != F.col("component")).alias("moved")), "labels")
        removed(*([last] if last is not None else []))
        labels, last = after.select(key, "component"), after
        if after.where("moved").isEmpty():
            removed(both)
            return labels
