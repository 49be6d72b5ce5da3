"""From raw documents to token ids: the stages of a training corpus.

``STAGES`` names functions of (spark, docs, sf_dir); each result is written as Parquet and read
again as the next stage's documents.  All stages but the last return the columns of documents.
``run`` chains them over the table.  Some of them learn on the documents they are given.

1. ``language``: documents that are identified as no language go.
2. ``quality``: documents that fail the base rules or are anomalous go; thresholds come from
   the labelled documents among them.
3. ``near_dedup``: one document of each group of near copies (five-word shingles, similarity
   of 0.8 or more) stays, that of smallest id.
4. ``mixing``: sources are cut and repeated to their target weights.
5. ``encoding``: the texts' token ids and the bytes they decode to, as counts and digests.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, language_id, mixing, near_copies, quality_rules
from quire.llm.common import table
from quire.llm.queries import language_model, rule_model


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_model(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_by_rules(docs, rule_model(spark, sf_dir, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("encoding", encoding),
]

#: Classifiers, fingerprints and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written below the shared folder once."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or on one machine without it a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return f"{shared}/pipeline-{uuid.uuid4()}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
