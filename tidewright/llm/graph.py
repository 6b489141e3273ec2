"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); nodes are linked if and only if roots agree.

    Each round maps every node to the neighbour (or itself) that is first in a pseudorandom
    order and replaces links by links of what their ends are mapped to, so the links shrink by a
    factor a round whatever the shape of the graph. The maps are followed from the last back to
    the first. The heads of hot stars are met only in sums and in joins that Spark can split.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("v"))
    links = written(links.where("a <> b").select("a", "b"), "links")
    maps: list[DataFrame] = []
    for _ in range(most_rounds):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        step = written(step.select(F.col("a").alias("node"), F.least("m", key("a"))["v"].alias("to")), "contraction")
        maps.append(step)
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        nxt = links.join(left, "a").join(right, "b").where("ta <> tb")
        links = written(nxt.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("links are left after the last round")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


#: Parts over which the rows of one component are spread when they are joined with what holds for all of it.
PARTS = 32


def least_of(roots: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least): for each node of ``roots`` (node, root) the smallest value that ``values`` (node, value)
    has in its component.

    A component may hold a third of all nodes: it is summed in parts, and each part meets a copy of the sum.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS).cast("long")).alias("part")
    dealt = roots.join(values, "node").select("node", "root", "value", part)
    sums = dealt.groupBy("root", "part").agg(F.min("value").alias("least")).groupBy("root").agg(F.min("least").alias("least"))
    copies = sums.select("root", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
    return roots.select("node", "root", part).join(copies, ["root", "part"]).select("node", "least")
