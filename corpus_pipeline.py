"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import line_dedup, mixing, ngram_join, packing, store, toxicity

TOKENIZER = "word_bpe_49k.json"
#: Rows of an Arrow batch between the JVM and Python: whole texts are held on both sides, outside the heap.
BATCH = 500


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain does not reject.

    They are scored as they are written, after this function, so the session keeps the size of batches for the stages.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return toxicity.clean(docs, store.read(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those that lose all their words to it go."""
    return line_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in the order of training."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; each source's queue keeps the order of training, which the files of the stage before have."""
    import public_tokenizers

    return packing.pack(packing.in_file_order(docs), public_tokenizers.path(TOKENIZER), order="_place")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier chain or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table."""
    docs = store.read(spark, sf_dir, "documents")
    with store.batches_of(spark, BATCH):
        for name, stage in STAGES:
            docs = store.table(stage(spark, docs, sf_dir), name)
    return docs
