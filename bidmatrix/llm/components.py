"""Connected components by alternating stars, for links of any number of nodes.

Each round points every node at the smallest node it sees: first from its larger neighbours (large star),
then from its smaller ones (small star). The number of rounds grows with the logarithm of the longest
chain. Every result of a round is written to the shared folder and the round before is removed, so lineage
stays short and a lost executor costs a re-read. The smallest neighbour of each node is aggregated before it
meets the links, and meets them in a plain join, whose large partitions Spark splits: a node with very many
links needs no task of its own.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.session import release, stored, work_folder


def _kept(df: DataFrame, folders: list[str]) -> DataFrame:
    folders.append(work_folder(df.sparkSession))
    return stored(df, folders[-1])


def connected_components(links: DataFrame, one: str, other: str) -> DataFrame:
    """node, component: every node that has a link, and the smallest node it reaches.

    Links count in both directions; repeated links and links of a node with itself change nothing, and
    links with a null end are dropped.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(one, other).alias("hi"), F.least(one, other).alias("lo"), F.col(one), F.col(other))
    pairs = pairs.where(F.col(one).isNotNull() & F.col(other).isNotNull() & (F.col("hi") > F.col("lo")))
    held: list[str] = []
    edges, before = _kept(pairs.select("hi", "lo").distinct(), held), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if state == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        old, held, before = held, [], state

        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("seen")).unionByName(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("seen"))
        )
        least = _kept(both.groupBy("node").agg(F.least(F.min("seen"), F.first("node")).alias("least")), old)
        large = both.join(least, "node").where(F.col("seen") > F.col("node"))
        large = _kept(large.select(F.col("seen").alias("hi"), F.col("least").alias("lo")).distinct(), old)

        least = _kept(large.groupBy("hi").agg(F.min("lo").alias("least")), old)
        small = large.join(least, "hi").where(F.col("lo") != F.col("least"))
        small = small.select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = small.unionByName(least.select("hi", F.col("least").alias("lo")))
        edges = _kept(small.distinct(), held)
        for folder in old:
            release(spark, folder)
