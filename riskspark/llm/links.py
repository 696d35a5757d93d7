"""Connected components of a table of links, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b), a stored table; nodes of one component
    have one root, a node of it. Each round hooks every node to the least of its neighbours and
    itself, in the order of a hash, and contracts: so chains of any numbering shrink by a
    constant share per round. All steps are equi-joins and aggregates; nothing is collected."""
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    edges, rounds = links.select("a", "b").filter("a != b"), []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("near"))
                      .select("node", F.least("near", order("node"))["id"].alias("root")), "hooks")
        rounds.append(hook)
        left, right = hook.toDF("a", "x"), hook.toDF("b", "y")
        edges = stored(edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b"), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    done = rounds[-1]
    for hook in reversed(rounds[:-1]):
        later = done.toDF("root", "last")
        done = hook.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return stored(done, "components")


def joined(roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """``components`` after the links ``fresh`` came in: only these, between the components known
    so far, are contracted, and the known roots are renamed."""
    to = lambda c: (roots.toDF(c, f"{c}_root"), c, "left")
    ends = fresh.select("a", "b").join(*to("a")).join(*to("b"))
    new = components(stored(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a != b"), "links"))
    later = new.toDF("root", "last")
    known = roots.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return stored(known.union(new.join(roots.select("node"), "node", "left_anti")), "components")
