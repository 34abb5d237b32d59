"""Connected components of a link table, by joins alone: no node, link or component passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling and contracts the
    links to those ends: what is left links local minima only, so rounds grow with the logarithm of the nodes.  A hub's
    neighbours are only ever reduced by min(), before they are shuffled.  Joins look up a unique key in a written table;
    where many rows look up one key, as all that follow a hub do, Spark's skew join splits them.
    """
    links = written(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        hooks = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hooks = written(hooks, "hooks")
        while True:  # a hook's own hook; one without is a root
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            if hooks.join(above, "up", "left_semi").isEmpty():
                break
            longer = written(hooks.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "hooks")
            dropped(hooks)
            hooks = longer
        lookup = lambda side: hooks.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up"))
        half = written(links.join(lookup("a"), "a", "left").select(F.coalesce("a_up", "a").alias("a"), "b"), "links")
        ends = half.join(lookup("b"), "b", "left").select("a", F.coalesce("b_up", "b").alias("b")).where("a != b")
        next_links = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if roots is None:
            every = links.select("a").union(links.select(F.col("b").alias("a"))).distinct()
            next_roots = written(every.select(F.col("a").alias("node"), F.col("a").alias("root")), "roots")
        else:
            next_roots = roots
        next_roots, before = written(next_roots.join(hooks.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots"), next_roots
        for old in (links, hooks, half, before):
            dropped(old)
        links, roots = next_links, next_roots
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    dropped(links)
    return roots
