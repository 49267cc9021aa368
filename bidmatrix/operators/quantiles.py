"""Approximate quantiles of whole numbers from mergeable sketches, stored per batch and merged to any grain.

A KLL sketch holds a bounded number of values, whatever the number of rows, and Spark combines sketches before
the shuffle, so a group may hold any share of all rows. A group of at most k values is answered exactly. In others,
the rank of an answer is off by at most ``rank_error(k)`` of the group in 99 of 100 cases.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidmatrix.operators.salting import SALTS

K = 400


def rank_error(k: int = K) -> float:
    """The sketch's one-sided rank error at 99 % (published fit of the KLL sketch)."""
    return 2.296 / k**0.9723


def sketches(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """by, sketch and n_values of each group; nulls are no values, and a group of nulls has no row."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_bigint(value, k).alias("sketch"), F.count(value).alias("n_values"))


def merged(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of a coarser grain, or of several batches."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n_values").alias("n_values"))


def quantiles(sketched: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, n_values and ``answers``: for each share, the smallest value seen with at least that share at or below it."""
    return sketched.select(*by, "n_values", F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(s) for s in shares])).alias("answers"))


def ranked(rows: DataFrame, by: list[str], value: str, answers: DataFrame, n_answers: int) -> DataFrame:
    """answers with the exact counts of values ``below`` and ``up_to`` each of them, from one pass over the rows.

    A group's rows meet its answers in SALTS tasks and are counted before they are shuffled again.
    """
    salt = F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")
    spread = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Spark sizes the answers before they are repeated: without the hint all salts' copies may go to every task
    met = rows.where(F.col(value).isNotNull()).select(*by, value).withColumn("salt", salt).join(spread.hint("merge"), [*by, "salt"])
    number = lambda test: F.array(*[F.count_if(test(F.get("answers", F.lit(i)))) for i in range(n_answers)])
    return met.groupBy(*by, "n_values", "answers").agg(
        number(lambda a: F.col(value) < a).alias("below"), number(lambda a: F.col(value) <= a).alias("up_to")
    )
