"""A corpus pipeline over documents: quality rules, near-dedup, secret scan, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents, the last a row with the tokens' digests for each row of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ohmgraph.llm import op02_mixing, op04_bpe, op06_secrets, op07_quality, op09_minhash
from ohmgraph.llm.common import materialize


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they decode to."""
    return op04_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", op07_quality.stage),
    ("MinHash near-dedup", op09_minhash.stage),
    ("secret scans", op06_secrets.stage),
    ("mixing", op02_mixing.stage),
    ("byte-level BPE", tokens),
]

#: SQL can't express the binomial bounds, the models, the splitting tree or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as a table in the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
