"""The corpus pipeline: documents through five stages of :mod:`lakeforge.llm`.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one works on; between stages the rows are written
as Parquet to the shared folder and read again, so a lost executor costs one stage at most.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeforge.llm import bag_minhash, bpe_tree, decontaminate, quality_ledger, suffix_dedup
from lakeforge.llm.common import Scratch, prepare


#: The third stage takes out repeated runs of more than 50 words; strings of 250 bytes (50 words of four letters and a
#: space) mark them.
REPEATED_BYTES, REPEATED_WORDS = 250, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy keeps."""
    prepare(spark)
    return quality_ledger.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates."""
    prepare(spark)
    return bag_minhash.deduplicated(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the runs of more than ``REPEATED_WORDS`` words that repeat elsewhere."""
    prepare(spark)
    return suffix_dedup.removed(docs, REPEATED_BYTES, REPEATED_WORDS)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document (packed little-endian 32-bit integers), and digests of ids and decoded bytes."""
    prepare(spark)
    both = bpe_tree.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_strings),
          ("benchmark decontamination", contamination), ("byte-level BPE", encoded)]

#: No SQL expresses the near-duplicate classes; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(f"stage{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
