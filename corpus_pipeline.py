"""From raw documents to packed sequences, in five stages.

Every stage takes null and empty texts, null, repeated and tied doc_ids, null sources, very long texts,
empty tables and further columns with whatever names; what it does with them is said below. All but
the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common, mixing, packing, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic: the whole text is scored, null as empty.

    Rows with null or repeated ids are scored one by one; without a toxic label nothing is dropped.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id, before rows without one.

    Empty texts and texts of white space are one group. Of rows with one id in a group one stays;
    rows with one id in different groups all stay.
    """
    return simhash.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and n_chars counted anew; null texts stay null."""
    return secrets.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; the one that a source's target ends in whole.

    Documents without words, and so null texts, are not taken. A null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a document that was taken twice is packed twice."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models are trained on the way: no SQL gives these rows. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stash(docs, f"stage-{number}")
            if number:
                common.release(before)  # the stage's own table has taken its place
    return docs
