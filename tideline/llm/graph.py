"""Connected components by contraction, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.store import drop, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``: the smallest node of its component.

    Each round, every node adopts its smallest neighbour (twice over), the links are
    rewritten to the adopters and those inside one node go; at least the larger end of
    each link disappears, so a few rounds do. Hot nodes are aggregated before they are
    shuffled, and joins on them are ones whose partitions Spark can split.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = written(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "roots")
    while not links.isEmpty():
        # written, so that the join reads exchanges and Spark can split a node that many adopt
        adopted = written(links.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("p")), "adopted")
        above = adopted.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parents = written(adopted.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "parents")
        old_roots, old_links = roots, links
        roots = written(
            roots.join(parents.withColumnsRenamed({"a": "root"}), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots"
        )
        left = links.join(parents, "a").select(F.col("p").alias("x"), "b")
        both = left.join(parents.withColumnsRenamed({"a": "b"}), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        links = written(both.where("a <> b").distinct(), "links", release=True)
        drop(adopted, parents, old_roots, old_links)
    drop(links)
    return roots
