"""A corpus pipeline over ``documents``: toxicity, near-duplicates, repeated passages, mixing, byte-level BPE.

Every stage is written as Parquet and read again, works on all that the stage before kept, and returns the columns of
``documents``; the last one returns the digests of the encoded texts. Which rows and bytes go:

* toxicity: documents whose score reaches the threshold of their language (the classifier is fitted on labelled rows);
* near_duplicates: all but the document with the smallest id of each component of texts whose 5-word shingles have a
  Jaccard similarity of 0.8 or more (simhash, simhash_wide: found by wide fingerprints, verified exactly);
* passages: bytes that a 100-byte string covers which also starts earlier; whole characters only;
* mixing: documents are repeated so that expected token shares of the languages meet the targets; none is dropped;
* encode: nothing goes.

Contract of every stage: null text is empty text, and an empty text is a document like others (several of them are copies of
one another). Rows that repeat an id are one document to the decisions and stay rows of their own; rows without an id are kept,
except where they are toxic. Ties go to the smaller id. Columns beyond those of ``documents`` and of any name stay as they are.
An empty table gives an empty table; without labels no document is toxic and none is repeated.

No stage has an equal in SQL, so ORACLE_SQL is None; the tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaweave.llm import bpe_sql, common, mixing, queries as llm_queries, simhash, suffix_dedup, toxicity

ORACLE_SQL = None
SCOPE = "pipeline"


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage begins when the output of the one before has been written, so that one's scratch tables can go."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, SCOPE)
        with common.scope(SCOPE):
            return f(spark, docs, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@_stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    part = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4")
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels"), part != 2))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs, words=5, similarity=0.8)


@_stage
def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs, llm_queries.domain_labels(docs, common.table(spark, sf_dir, "labels")), llm_queries.TARGETS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_sql.bpe_digests(docs, llm_queries.tokenizer("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", clean), ("near_duplicates", one_of_each), ("passages", without_passages), ("mixing", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        own = f"stage {k} of {uuid.uuid4().hex}"
        with common.scope(own):
            path = common.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.release(spark, before)  # the stage that read it has been written
        before = own
    common.release(spark, SCOPE)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
