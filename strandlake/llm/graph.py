"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import stored


def _pull(pairs: DataFrame) -> DataFrame:
    """Each u's neighbours v get the least of u and its neighbours. Minima are pre-aggregated and no neighbour list is gathered;
    they are written before they are joined back, so that Spark can split the rows of a u with very many neighbours."""
    least = stored(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), pairs.sparkSession)
    return pairs.join(least, "u")


def components(edges: DataFrame, spark: SparkSession, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, root): root is the least node of the component; roots themselves and lone nodes aren't listed."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), spark)
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pull(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pulled = _pull(large)
        small = pulled.select("u", F.col("m").alias("v")).union(pulled.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, spark)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
