"""File lists: what a folder holds, and a selection without repeats."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidmatrix.functions.text import basename


def inventory(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Name, path, size and time of the files in a folder. File contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return found.select(basename(F.col("path")).alias("name"), "path", "length", "modificationTime")


def keep_first(files: DataFrame) -> DataFrame:
    """One entry per (session, name, size): the one chosen first.

    A minimum collapses copies before the shuffle, however often a file repeats.
    """
    return files.groupBy("session_id", "name", "size").agg(F.min("pos").alias("pos"))


def add_files(chosen: DataFrame, added: DataFrame) -> DataFrame:
    """Files chosen so far, then newly added ones, without repeats."""
    ordered = chosen.withColumn("pos", F.struct(F.lit(0).alias("batch"), "pos")).unionByName(
        added.withColumn("pos", F.struct(F.lit(1).alias("batch"), "pos"))
    )
    return keep_first(ordered).select("session_id", "name", "size", "pos.batch", "pos.pos")
