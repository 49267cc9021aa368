"""The closest entry of a word bank for every label, through trees of the entries' beginnings instead of all pairs.

The entries of each part of the bank are dealt over trees, and labels walk each tree of their part no further than a
radius allows (``trees``), so entries that begin alike are compared once as far as they do, however many they are. The radius
grows from ring to ring: a label that has an entry within a ring is done, as nothing outside can be closer, and only the
others go on. Labels that are far from everything meet all entries of their part of the bank, chunk by chunk.

Labels look in their own category; if the bank has no entry of it, or they have none, in all categories.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidmatrix.functions.text import normalised
from bidmatrix.operators.trees import meet
from bidmatrix.schemas import SERVICE
from bidmatrix.session import stored

#: Edit distances up to which the trees are walked, one after the other, and those for labels that are left then.
RINGS, FURTHER = (1, 2, 4), (5, 6, 8)
#: Entries of one part of the bank that a label far from everything meets at once, about.
CHUNK = 500


def _in_bank(labels: DataFrame, taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct labels and entries with the part of the bank they belong to: a category, or (null) all of it."""
    bank = taxonomy.select(*SERVICE).dropna().distinct()
    known = bank.select("service_category").distinct().withColumn("known", F.lit(True))
    asked = labels.select(*SERVICE).distinct().join(known, "service_category", "left").select(
        *SERVICE, F.when(F.col("known"), F.col("service_category")).alias("part"), normalised(F.col("sub_service")).alias("text")
    )
    entries = bank.select(
        F.col("service_category").alias("snapped_category"), F.col("sub_service").alias("snapped"),
        normalised(F.col("sub_service")).alias("entry"),
        F.explode(F.array(F.col("service_category"), F.lit(None).cast("string"))).alias("part"),
    )
    return stored(asked), stored(entries)


#: Chunks whose entries make up one tree; labels that meet a tree at once with a radius of 1, fewer with a greater one; tasks
#: that these meetings are dealt over, which are few bytes and much work, so Spark may not put them together.
TREE, MET, TASKS = 500, 20_000, 128


def _dealt(texts: DataFrame, text: str, size: int, number: str) -> DataFrame:
    """Distinct texts of each part of the bank with a ``number`` by hash, so that about ``size`` have the same, and their count."""
    sizes = texts.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / size).alias(f"n_{number}"))
    return texts.join(sizes.hint("merge"), "of").withColumn(number, F.pmod(F.xxhash64(text), F.col(f"n_{number}")))


def candidates(labels: DataFrame, entries: DataFrame, radius: int) -> DataFrame:
    """Each label with its closest entries by tree, for labels that have entries within ``radius`` in it.

    The distinct texts of a part of the bank are dealt over trees, its labels over as many tasks per tree as they need.
    Nothing is broadcast: Spark sizes both sides by the files before their rows are repeated.
    """
    part = F.coalesce(F.concat(F.lit("="), F.col("part")), F.lit("")).alias("of")  # null is all of the bank
    asked = _dealt(labels.select(part, "text").distinct(), "text", max(1, MET // radius), "share")
    held = _dealt(entries.select(part, "entry").distinct(), "entry", CHUNK * TREE, "chunk")
    chunks, shares = held.groupBy("of").agg(F.first("n_chunk").alias("n")), asked.groupBy("of").agg(F.first("n_share").alias("n"))
    every = lambda rows, counts, number: rows.join(counts.hint("merge"), "of").withColumn(
        number, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    asked, held = every(asked, chunks, "chunk").select("of", "chunk", "share", "text"), every(held, shares, "share").select("of", "chunk", "share", "entry")
    place = ["of", "chunk", "share"]
    asked, held = asked.repartition(TASKS, *place), held.repartition(TASKS, *place)
    found = asked.groupBy(*place).cogroup(held.groupBy(*place)).applyInArrow(meet(radius), "of string, text string, entry string")
    of_labels = found.join(labels.select(*SERVICE, part, "text").hint("merge"), ["of", "text"])
    return of_labels.join(entries.select(part, "entry", "snapped_category", "snapped").hint("merge"), ["of", "entry"]).select(
        *SERVICE, "text", "snapped_category", "snapped", "entry"
    )


def _best(pairs: DataFrame, distance: Column) -> DataFrame:
    """The closest pair of each label, ties by name and category."""
    scored = pairs.withColumn("distance", distance).where("distance >= 0")
    best = F.min(F.struct("distance", "snapped", "snapped_category"))
    return scored.groupBy(*SERVICE).agg(best.alias("b")).select(*SERVICE, "b.snapped_category", "b.snapped", "b.distance")


def _closest_of_all(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """The closest entry of each label, which meets all entries of its part chunk by chunk: a row per label and chunk, none per pair."""
    sizes = entries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("n_chunks")).withColumnRenamed("part", "sized")
    of_size = lambda rows: rows.join(sizes, F.col("part").eqNullSafe(F.col("sized"))).drop("sized")
    dealt = of_size(entries).withColumn("chunk", F.pmod(F.xxhash64("snapped_category", "snapped"), F.col("n_chunks")))
    held = dealt.groupBy("part", "chunk").agg(F.collect_list(F.struct("entry", "snapped", "snapped_category")).alias("held"))
    asked = of_size(labels).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    met = asked.alias("a").join(held.hint("merge").alias("e"), [F.col("a.part").eqNullSafe(F.col("e.part")), F.col("a.chunk") == F.col("e.chunk")])
    scored = F.transform("held", lambda e: F.struct(F.levenshtein("text", e["entry"]).alias("distance"), e["snapped"], e["snapped_category"]))
    best = met.select(*SERVICE, F.array_min(scored).alias("best"))
    return best.groupBy(*SERVICE).agg(F.min("best").alias("b")).select(*SERVICE, "b.snapped_category", "b.snapped", "b.distance")


def closest(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """service_category, sub_service, snapped_category, snapped, distance of every distinct label.

    A label without text is far from everything as far as its distance goes; a null one, and all labels when
    the bank is empty, snap to null.
    """
    left, entries = _in_bank(labels, taxonomy)
    out = left.where(F.col("sub_service").isNull()).select(*SERVICE)
    out = out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("snapped_category", "string"), ("snapped", "string"), ("distance", "int"))])
    left = left.where(F.col("sub_service").isNotNull())
    done = lambda rest, found: stored(rest.join(found.select(*[F.col(c).alias(f"_{c}") for c in SERVICE]), _same(), "left_anti"))
    for radius in (*RINGS, *FURTHER):
        if radius in FURTHER and left.isEmpty():
            break
        found = stored(_best(candidates(left, entries, radius), F.levenshtein("text", "entry", radius)))
        out, left = out.unionByName(found), done(left, found)
    found = stored(_closest_of_all(left, entries))
    return out.unionByName(found).unionByName(done(left, found).select(*SERVICE), allowMissingColumns=True)


def _same() -> Column:
    return F.col("service_category").eqNullSafe(F.col("_service_category")) & F.col("sub_service").eqNullSafe(F.col("_sub_service"))
