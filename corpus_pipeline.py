"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its
docs. What a stage drops, changes or repeats is what the next one sees. SQL cannot express the trained
network, the 64-bit hashes and the token ids, so ORACLE_SQL is None; tests hold each stage against a
brute-force version.

Cases: an empty table runs through to an empty result. Rows with few letters or none go in the first stage, with
them null and empty texts, also where nothing is labelled. Repeated rows are near-duplicates of each other. Columns beyond those of
documents pass through all stages but the last.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidmatrix.llm import langid, mixing, nearcopies, packing, pii
from bidmatrix.llm.common import table
from bidmatrix.session import stored

def around(docs: DataFrame, names: tuple[str, ...], step) -> DataFrame:
    """step(docs) with docs' columns, those set aside during the step whose names it uses itself."""
    aside = {c: f"aside {c}" for c in docs.columns if c in names}
    return step(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only texts that show a language, by their letters and by what the network makes of them."""
    network = langid.fit(docs)
    return around(docs, ("lang_pred", "score"), lambda d: langid.written(d, network))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 0.8 or more of their five-word shingles in common, the one with the smallest doc_id."""
    return nearcopies.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses under pseudonyms."""
    return around(docs, ("n_found",), pii.pseudonymise)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated, or thinned out, to their target weights."""
    return around(docs, mixing.ADDED, lambda d: mixing.repeat_documents(mixing.mix_documents(d)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near-duplicates", one_of_each),
    ("pseudonyms", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
