"""The corpus pipeline: from raw documents to shards of a deduplicated, decontaminated mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents.

Defined results of the stages
-----------------------------
* a null or empty text is neither rejected nor contaminated nor a near duplicate, and has no words to mix: the first
  three stages keep its document, the mix does not take it. Of the sharding stage every row has a shard.
* nulls in other columns are values like any other; rows without an id stay rows of their own.
* texts of any length are read whole.
* rows that are equal in id and text are one document from the near duplicates on; of equal texts the smallest id stays.
* a tie with a threshold of quality is kept; other ties go by id, then by a hash.
* an empty table of documents gives an empty table; without labels that show trusted texts nothing is rejected, and
  items without text contaminate nothing.
* other columns are left as they are, whatever their names, but for those that sharding adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import op2_jaccard_join, op3_quality, op4_mixing, op7_sharding, op8_decontamination
from tidewright.llm.shared import written
from tidewright.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return op3_quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at Jaccard 0.8 over shingles of five words."""
    return op2_jaccard_join.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op8_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights."""
    return op4_mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix with its shard."""
    return op7_sharding.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Perplexities and near duplicates are beyond SQL. Near duplicates, items and sizes are tested against brute force;
#: perplexity, thresholds and toxicity of the first stage against their definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
