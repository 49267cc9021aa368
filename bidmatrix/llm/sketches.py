"""Bottom-k sketches of word shingles, as column functions: no Python in any row path.

A sketch is the k smallest distinct hashes of a text's shingles, ascending. Two sketches merge into the
sketch of both texts together, and estimate resemblance (the share of the k smallest of both that each
holds), containment and the number of distinct shingles. Below k distinct shingles all are exact.

Cases: a null or blank text has an empty sketch. A text shorter than a shingle is one shingle. Two empty
sketches are alike (1), an empty and a filled one are not (0). Repeated rows are sketched each; rows with
equal doc_id follow each other in the order of their texts, a null doc_id comes first. Very long texts are
sketched whole, one row at a time. An empty table gives an empty result. Only doc_id and text are read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidmatrix.llm.common import lower_ascii
from bidmatrix.session import stored

SHINGLE = 5
K = 128
_BLANK = " \t\n\u000b\f\r"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    trimmed = F.trim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_BLANK))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        one = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])
        whole = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), one)
        return (
            F.when(F.size(h) >= shingle, whole)
            .when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(hashes, lambda h: F.slice(F.sort_array(F.array_distinct(shingles(h))), 1, k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of what both sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from any number of parts: the k smallest of their hashes, counted before they are shuffled."""
    hashes = sketches.select(*keys, F.explode(column).alias("hash")).groupBy(*keys, "hash").agg(F.lit(1).alias("one"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    kept = hashes.withColumn("place", first).where(F.col("place") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(column))


def _common(a: Column, b: Column, k: int) -> Column:
    """Size of the union's sketch, and how many of it both hold."""
    joint = lambda u: F.struct(
        F.size(u).alias("seen"), F.size(F.array_intersect(F.array_intersect(u, a), b)).alias("both")
    )
    return let(merge(a, b, k), joint)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    return let(_common(a, b, k), lambda c: F.when(c["seen"] == 0, 1.0).otherwise(c["both"] / F.greatest(c["seen"], F.lit(1))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


#: Ranges of doc_id per shuffle partition: more than one, so that partitions come out even.
RANGES = 4


def with_next(rows: DataFrame, name: str, value) -> DataFrame:
    """rows with `name`, value(text) of each, and next_text and next_<name>, those of the row that follows.

    Rows follow each other by doc_id and text, the first follows the last. They are dealt out by ranges of
    doc_id, so that a range is one window; the row after a range is fetched by the ranges' smallest doc_ids,
    whose number is bounded by the shuffle partitions, and only for those few is the value worked out again.
    """
    spark, carried = rows.sparkSession, ["text", name]
    parts = max(2, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("next_range", F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))

    starts = ranged.groupBy("next_range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("at"))
    starts = stored(starts.select("next_range", F.col("at.doc_id").alias("start_id")))
    heads = (
        rows.join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("start_id")))
        .groupBy("next_range").agg(F.min("text").alias("text"))
    )
    heads = stored(heads).select("next_range", F.struct("text", value(F.col("text")).alias(name)).alias("head"))
    ordered = Window.orderBy("next_range")
    around = Window.orderBy("next_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("next_range").alias("head_range"),
        F.coalesce(F.lead("head").over(ordered), F.first("head").over(around)).alias("head"),
    )

    order = Window.partitionBy("next_range").orderBy("doc_id", "text")
    followed = ranged.withColumn(name, value(F.col("text"))).withColumn("next_row", F.lead(F.struct(*carried)).over(order))
    last = (F.col("next_range") == F.col("head_range")) & F.col("next_row").isNull()
    joined = followed.join(heads, last, "left")
    picked = [F.coalesce(F.col(f"next_row.{c}"), F.col(f"head.{c}")).alias(f"next_{c}") for c in carried]
    return joined.select(*rows.columns, name, *picked)


def compare_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the next document's beginning."""
    given = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(given, "own", lambda text: sketch(text, k))
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    rows = rows.withColumn("edited", edited).withColumn("edited_own", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_own")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited_own"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"),
    )
