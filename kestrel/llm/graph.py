"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the undirected links
    (a, b), for every id that has one. Each round takes the least label among
    the neighbours, then the label of that label; the labels are a table in the
    shared folder, only two sums come to the driver. Repeated links and links
    of an id to itself change nothing."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "labels")
    before = None
    for _ in range(most_rounds):
        now = label.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now is None or now == before:
            return label
        before = now
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = label.join(near, "id").select("id", F.least("component", "near").alias("component"))
        of = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        label = cut_lineage(own.join(of, "component").select("id", F.least("component", "further").alias("component")), "labels")
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
