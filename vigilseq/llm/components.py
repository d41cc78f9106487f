"""Connected components of a graph given by its links.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
hangs the neighbours of a node on the least of them, until each component is
one star.  A step is a grouped minimum, which is reduced before its shuffle,
and one join, which adaptive execution splits at hub nodes.  Each round is a
written table in the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilseq.sources.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node of its component.

    Direction, repeats and links of a node to itself do not matter; links with a
    null end are ignored.  No links give no rows.
    """
    present = links["a"].isNotNull() & links["b"].isNotNull() & (links["a"] != links["b"])
    ends = links.filter(present).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = stage(ends.distinct(), "links")
    before = None
    while True:
        seen = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == before:
            break
        before = seen
        stars = stage(_small_star(_large_star(stars)), "stars")
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
