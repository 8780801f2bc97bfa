"""Connected components of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of an edge list reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each written to the shared
    folder; both shuffle edges only and converge in a logarithmic number of rounds. An edge is kept
    as (larger, smaller), so a node's least neighbour is an aggregate reduced before its shuffle, and
    it is a table of its own in each join: the planner can split the edges of a node that many
    share. Nodes may be of any orderable type; null nodes are left out.
    """
    work = Workspace(work.spark, "components", work.path)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = work.save(e, "edges-0")
    step, before = 0, None
    while True:
        least = lambda d, name: work.save(d.groupBy("a").agg(F.min("b").alias("m")), name)
        low = least(e, f"low-{step}").withColumnRenamed("a", "b")
        # large star: every larger neighbour of a node meets the least of its neighbours and itself
        large = e.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = work.save(large, f"large-{step}")
        low = least(large, f"low-large-{step}")
        # small star: a node and its smaller neighbours meet the least of them
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b")).distinct()
        for name in (f"edges-{step}", f"low-{step}"):
            work.drop(name)
        step += 1
        e = work.save(small, f"edges-{step}")
        for name in (f"large-{step - 1}", f"low-large-{step - 1}"):
            work.drop(name)
        sums = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if sums == before:
            break
        before = sums
    return e.union(e.select("b", "b")).toDF("node", "component").distinct()
