"""A training corpus from raw documents: five stages, each an operator of shelfwise.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
returns the columns of documents; the last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import mixing, packing, quality, simhash, suffixes
from shelfwise.llm.common import put, table, written
from shelfwise.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Repeated passages of the corpus: about fifty words.
PASSAGE_BYTES = 256


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents below the threshold go."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    return quality.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: the document with the smallest id of each group stays.

    Groups link fingerprints of three-word shingles that differ in 3 bits or fewer.
    """
    return simhash.first_of_each(docs).select(*COLUMNS)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages that occur more than once go from the texts."""
    cut = suffixes.cut_repeats(docs, length=PASSAGE_BYTES)
    return put(cut, {"n_chars": F.length("text").cast("bigint")}).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents as often as the mix takes them."""
    return mixing.repeated(mixing.mix_sources(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_copies),
    ("repeated_passages", cut_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: Hashing, a trained model and suffix sorting cannot be written as SQL; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
