"""Corpus pipeline: documents in, token shards out.

Five stages, each on all that its predecessor kept: documents that score as toxic go; of each
group of near-duplicates the document with the least id stays; contaminated documents go; sources are
mixed to target weights; what remains is written as token shards and read back. All stages but the last return
the columns of documents, whatever further columns there are and however their names clash. In every stage
null texts count as empty and stay clean, repeated rows stay together (near-duplicates keep one), rows without a doc_id are
judged like others, and an empty table gives no rows; see the functions called for ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewarden.llm import alike, mixing, store, tokens, toxicity, winnow

#: Share of the tokens that reach the mixing stage which it keeps, and epochs over each source.
MIX_SHARE, MIX_EPOCHS = (4, 5), 1


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled rows that are not held out; rows below the threshold stay (null texts too). Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.mild_rows(docs, toxicity.fit(docs, labels))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles alike by 0.8 or more, by SimHash of 512 bits): the least id (nulls last), of equal ids the least hash. Texts without words are one group."""
    return alike.one_of_each(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth or more go; null texts stay."""
    return winnow.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, within the budget. Null sources and languages are leaves of their own; rows without words cost nothing."""
    return mixing.mixed_rows(docs, MIX_SHARE, MIX_EPOCHS)


def tokens_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32. A null text has the end id alone; null ids come first."""
    return tokens.token_output(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("mixing", mixed),
    ("token-output", tokens_out),
]
#: Segment scores, fingerprints and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again; the tables that a stage worked with go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with store.scope() as tables:
        for name, stage in STAGES[:-1]:
            docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
            store.removed(spark, tables, keep=1)
        return STAGES[-1][1](spark, docs, sf_dir)
