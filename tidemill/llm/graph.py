"""Connected components of a graph in a table, by alternating large and small stars; nothing is collected."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import drop_stored, stored


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, which has none itself."""
    if e.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component), for the nodes of the edges (a, b) other than roots.

    Large star: every node sends its larger neighbours to its smallest one; small star: every node sends its
    smaller neighbours and itself to the smallest. Each round is stored; the number of rounds grows with the
    logarithm of the components' diameter.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        before, e = e, stored(joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        drop_stored(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
